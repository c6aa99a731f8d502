"""Mixing sources to target weights by entropy balancing.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all
words by weight; a target stops at CAP times its source's size and the excess is shared
again by weight. That settles where every source below its cap has the same target per
weight, which a few aggregations over the table of sources find.

Rates. Of all ways to take every document at some rate between 0 and CAP, the mix is the one
with the least relative entropy to the corpus whose sources meet their targets in words. In the
entropy a document weighs size ** MEASURE, between counting documents (0) and words (1), so
that neither long documents nor short ones fill the mix. The dual is convex with one lambda a
source, and its solution tilts a document's rate exponentially in x = lambda * size ** (1 - MEASURE):
CAP * exp(x) / (CAP - 1 + exp(x)), which is 1 at 0 and stays below CAP. Newton's
steps run for all sources at once: a pass sums words and their slope under the present lambdas
over the counts of documents by source and size, and a step that leaves the interval known
to hold the root is replaced by its middle.

Rounding. Every document is taken floor(rate) times and some once more. How many of each
size of a source is settled from the largest size down, carrying the rounding error along, and what
is left is made up by one copy more or less of the largest documents that it covers,
so that a source ends within about its smallest documents of the target; which of equal
size is settled by a hash of id and text. Documents of one source and size are ranked in
pieces, whose number grows with the rows, so a hot source or a large group of copies is never
in one task. A source's distinct sizes meet in one task; n of them need n * n / 2 words.

Null texts have size 0 and are taken 0 words, as empty ones. Repeated rows are documents of
their own. A null doc_id stays null. An empty table has an empty mix. Rows out are the rows in; other columns are not read
unless they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Tables, documents, set_aside

WEIGHTS, CAP = (5.0, 2.0, 1.0), 3.0
MEASURE = 0.5
#: Newton's passes at most, and the share of a target that may be open after the last.
PASSES, CLOSE = 60, 1e-9
#: Pieces of the documents of a source and size: BUCKETS at least, and one more for so many rows.
BUCKETS, PIECE_ROWS = 64, 1 << 21


def sized(docs: DataFrame, *keep: Column) -> DataFrame:
    """(doc_id, source, s, size, hash): s stands for the source, null included."""
    source = F.col("source").cast("string")
    return docs.select(
        "doc_id",
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("s"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(1), "doc_id", F.col("text").cast("string")).alias("hash"),
        *keep,
    )


def weighted(sources: DataFrame, tables: Tables) -> DataFrame:
    """sources with ``weight`` by their rank: sorted by ranges, ranked within each, after the ranges before it."""
    order = F.col("source").asc_nulls_last()
    ranged = tables.write(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").count().collect()  # a number for each range
    before, total = {}, 0
    for row in sorted(counts):
        before[row.part] = total
        total += row["count"]
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("part")] if before else F.lit(0)
    rank = start + F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    return tables.write(ranged.withColumn("weight", weight).drop("part"))


def targets(sources: DataFrame, tables: Tables) -> DataFrame:
    """sources (source, s, source_size) with ``target``. There is one row a source."""
    weighed = weighted(sources, tables)
    level, capped = 0.0, -1
    while True:
        full = F.lit(CAP) * F.col("source_size") <= F.col("weight") * level
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, CAP * F.col("source_size")).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.sum(full.cast("long")).alias("capped"),
        ).first()
        if not row["all"] or not row.free or row.capped == capped:
            break
        level, capped = (row["all"] - row.used) / row.free, row.capped
    return weighed.withColumn("target", F.least(CAP * F.col("source_size"), F.col("weight") * level))


def tilted(x: Column) -> Column:
    """The rate at tilt x."""
    return F.lit(CAP) / (F.lit(1.0) + F.lit(CAP - 1) * F.exp(-x))


def balanced(sources: DataFrame, sizes: DataFrame, tables: Tables) -> DataFrame:
    """sources (s, source_size, target) with ``lam``, the root of its dual's slope over ``sizes``
    (s, size, n), and ``scale``: a document's tilt is lam * (size / scale) ** (1 - MEASURE).
    Where the target is all that CAP allows lam is infinite, without a target minus infinite."""
    mean = sizes.where("size > 0").groupBy("s").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"))
    edge = F.when(F.col("target") <= 0, F.lit(float("-inf"))).when(F.col("target") >= CAP * (1 - CLOSE) * F.col("source_size"), F.lit(float("inf")))
    state = sources.join(mean, "s", "left").select(
        *sources.columns, F.coalesce("scale", F.lit(1.0)).alias("scale"), F.coalesce(edge, F.lit(0.0)).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")
    )
    state = tables.write(state)
    for _ in range(PASSES):
        at = F.pow(F.col("size") / F.col("scale"), F.lit(1 - MEASURE))
        rate = tilted(F.col("lam") * at)
        words = F.col("n") * F.col("size") * rate
        open_ = state.where(F.abs("lam") < float("inf"))
        slopes = sizes.where("size > 0").join(open_.select("s", "lam", "scale"), "s").groupBy("s").agg(
            F.sum(words).alias("f"), F.sum(words * at * (1 - rate / CAP)).alias("h")
        )
        over = F.col("f") > F.col("target")
        moved = state.join(slopes, "s", "left").withColumns({"hi": F.when(over, F.col("lam")).otherwise(F.col("hi")), "lo": F.when(~over, F.col("lam")).otherwise(F.col("lo"))})
        step = F.col("lam") - (F.col("f") - F.col("target")) / F.greatest("h", F.lit(1e-300))
        # A step is at most 2 where one side is open still, and the middle where it leaves the interval.
        near = F.greatest(F.col("lam") - 2, F.least(F.col("lam") + 2, step))
        middle = (F.col("lo") + F.col("hi")) / 2
        done = F.col("f").isNull() | (F.abs(F.col("f") - F.col("target")) <= CLOSE * F.col("target"))
        new = F.when(done, F.col("lam")).when((near > F.col("lo")) & (near < F.col("hi")), near).otherwise(middle)
        moved = tables.write(moved.withColumns({"lam": new, "open": ~done}).drop("f", "h"))
        tables.drop(state)
        state = moved.drop("open")
        if moved.where("open").isEmpty():
            break
    return state.drop("lo", "hi")


def _extra(sizes: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
    """How often all n documents of each size of a source are taken, and how many once more: the
    rate's two neighbours, or others where the source would miss its target."""
    sizes = sizes.sort_values("size", ascending=False)
    rows = list(zip(sizes["size"].tolist(), sizes["n"].tolist(), sizes["rate"].tolist()))
    due, taken = 0.0, []
    for size, n, rate in rows:
        due += rate * n * size
        low, high = _bounds(n, rate)
        taken.append(min(high, max(low, round(due / size))) if size else 0)
        due -= taken[-1] * size
    for k, (size, n, rate) in enumerate(rows):
        low, high = 0, n * int(CAP)
        step = min(high, max(low, taken[k] + int(due / size))) - taken[k] if size else 0
        nearer = step + (1 if due > 0 else -1)
        if size and low <= taken[k] + nearer <= high and abs(due - nearer * size) < abs(due - step * size):
            step = nearer
        taken[k] += step
        due -= step * size
    counts = [n for _, n, _ in rows]
    return pd.DataFrame({"s": sizes["s"], "size": sizes["size"], "base": [c // n for c, n in zip(taken, counts)], "extra": [c % n for c, n in zip(taken, counts)]})


def _bounds(n: int, rate: float) -> tuple[int, int]:
    """Times that n documents are taken together at the rate's neighbours."""
    base = int(rate + 1e-9)
    return n * min(int(CAP), base), n * min(int(CAP), base + 1)


def mix(docs: DataFrame, tables: Tables | None = None, whole: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row of docs; ``whole``: with
    all other columns of docs in front, but those that the mix names itself."""
    tables = tables or Tables(docs.sparkSession)
    own = ["size", "source_size", "target", "copies", "taken"]
    plain, names = set_aside(docs.drop(*own))
    keep = [F.struct(*names.values()).alias("row")] if whole else []
    plain = plain.withColumnsRenamed({names[c]: c for c in ("doc_id", "text", "source")}) if not whole else plain.select("*", *[F.col(names[c]).alias(c) for c in ("doc_id", "text", "source")])
    rows = tables.write(sized(plain, *keep))
    # First and last by value: each s has one source.
    sources = tables.write(rows.groupBy("s").agg(F.max("source").alias("source"), F.sum("size").alias("source_size")))
    buckets = max(BUCKETS, rows.count() // PIECE_ROWS)
    piece = F.pmod(F.col("hash"), F.lit(buckets)).cast("int")
    pieces = tables.write(rows.groupBy("s", "size", piece.alias("piece")).agg(F.count("*").alias("m")))
    sizes = tables.write(pieces.groupBy("s", "size").agg(F.sum("m").alias("n")))
    rated = tables.write(balanced(targets(sources, tables).select("s", "source_size", "target"), sizes, tables))
    tilt = F.when(F.abs("lam") < float("inf"), F.col("lam") * F.pow(F.col("size") / F.col("scale"), F.lit(1 - MEASURE))).otherwise(F.col("lam"))
    sizes = sizes.join(rated, "s").select("s", "size", "n", tilted(tilt).alias("rate"))
    extra = tables.write(sizes.groupBy("s").applyInPandas(_extra, "s string, size long, base long, extra long"))
    before = F.sum("m").over(W.partitionBy("s", "size").orderBy("piece")) - F.col("m")
    quota = pieces.withColumn("before", before).join(extra, ["s", "size"]).join(rated.select("s", "source_size", "target"), "s")
    quota = tables.write(quota.select("s", "size", "piece", "source_size", "target", "base", (F.col("extra") - F.col("before")).alias("quota")))
    ranked = rows.withColumn("piece", piece).withColumn("rank", F.row_number().over(W.partitionBy("s", "size", "piece").orderBy("hash", "doc_id")))
    copies = F.col("base") + (F.col("rank") <= F.col("quota")).cast("long")
    first = [F.col(f"row.{n}").alias(c) for c, n in names.items()] if whole else ["doc_id"]
    return ranked.join(quota, ["s", "size", "piece"]).select(*first, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each row with its size and how often the mix takes it. Null and empty texts have size
    0, null sources are a source, null ids stay null, repeated rows are documents of their own, an
    empty table stays empty, and columns named as the mix's own are replaced."""
    return mix(docs, whole=True)
