"""Runs of words: counted dictionaries, plain n-grams and n-grams around an anchor."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexical import ALNUM, bound, col, ngrams

#: Bits of an id by which ``dictionary`` counts at once.
LEVEL = 16
#: Bytes of text whose n-grams one task counts, and the buckets from which they are dealt out.
TASK_BYTES, BUCKETS = 4 << 20, 1 << 20


def counts(tokens: DataFrame, key: str, name: str = "frequency") -> DataFrame:
    return tokens.groupBy(key).agg(F.count("*").alias(name))


def stretches(tokens: Column | str, n: int) -> Column:
    """array of (bucket, run): tokens cut into runs, joined by a space, whose n-grams are those of the tokens.

    Each n-gram's bucket comes from its longest token, the least by hash of equally long ones; neighbours with the
    same one stay in one run. So an n-gram has the same bucket wherever it stands, and a token is in far fewer
    runs than n-grams. Frequent tokens are short and seldom the longest.
    """

    def rank(w: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(w), 8) - F.shiftleft(F.least(F.octet_length(w), F.lit(127)).cast("long"), 56)

    def cut(w: Column, least: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(least) - 1), first)
        run = lambda s, end: F.array_join(F.slice(w, s + 1, end - s + n - 1), " ")
        one = lambda at, s, i: F.struct(
            F.pmod(F.get(least, s), F.lit(BUCKETS)).cast("int").alias("bucket"), run(s, F.coalesce(F.get(at, i + 1), F.size(least))).alias("run")
        )
        return bound(starts, lambda at: F.transform(at, lambda s, i: one(at, s, i)))

    def each(w: Column) -> Column:
        least = lambda r: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.least(*[F.get(r, i + k) for k in range(n)]))
        found = bound(bound(F.transform(w, rank), least), lambda m: cut(w, m))
        return F.when(F.size(w) >= n, found).otherwise(F.array().cast("array<struct<bucket:int,run:string>>"))

    return bound(col(tokens), each)


def ngram_counts(items: DataFrame, tokens: Column | str, n: int) -> DataFrame:
    """(ngram, frequency) of all runs of n tokens of an item."""
    return counts(items.select(F.explode(ngrams(tokens, n)).alias("ngram")), "ngram")


def dealt_ngram_counts(items: DataFrame, tokens: Column | str, n: int, parts: int) -> DataFrame:
    """As ngram_counts, for n > 1 and tokens that are not null and hold no space, as words.

    Most n-grams of three tokens or more occur once, so partial counts save nothing and hold each token n times.
    Runs of tokens are dealt out to ``parts`` tasks instead, each of which makes and counts all n-grams of its buckets.
    """
    dealt = items.select(F.inline(stretches(tokens, n))).repartition(parts, "bucket")
    found = dealt.select("bucket", F.explode(ngrams(F.split("run", " "), n)).alias("ngram"))
    return found.groupBy("bucket", "ngram").agg(F.count("*").alias("frequency")).drop("bucket")


def dictionary(tokens: DataFrame, by: tuple[str, ...] = ("doc_id", "pos"), word: str = "word") -> DataFrame:
    """(word, first_index): words by the order of their first occurrence, from 1.

    An id's words are ranked among themselves and follow the words of smaller ids, which are
    counted level by level over LEVEL bits of the id: no window holds more than 65,536 counts or an
    id's own words, however the ids are spread. ``by`` starts with an integer id.
    """
    first = tokens.groupBy(word).agg(F.min(F.struct(*by)).alias("at"))
    first = first.withColumn("id", F.coalesce(F.col(f"at.{by[0]}").cast("long"), F.lit(-(2**62))))
    level = first.groupBy("id").agg(F.count("*").alias("n"))
    levels = []
    for _ in range(64 // LEVEL - 1):
        level = level.withColumn("up", F.shiftright("id", LEVEL))
        levels.append(level.select("id", "up", (F.sum("n").over(W.partitionBy("up").orderBy("id")) - F.col("n")).alias("before")))
        level = level.groupBy(F.col("up").alias("id")).agg(F.sum("n").alias("n"))
    # What is left of an id are its highest bits.
    before = level.select(F.col("id").alias("up"), (F.sum("n").over(W.orderBy("id")) - F.col("n")).alias("above"))
    for below in reversed(levels):
        before = below.join(before, "up").select(F.col("id").alias("up"), (F.col("before") + F.col("above")).alias("above"))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("at")))
    return ranked.join(before.withColumnRenamed("up", "id"), "id").select(word, (F.col("above") + F.col("rank")).alias("first_index"))


def anchor_words(text: Column | str) -> Column:
    """Words between ASCII white space that begin with a letter or number."""
    return F.filter(F.split(col(text), "[ \\t\\n\\f\\r]+"), lambda w: w.rlike(f"^[{ALNUM}]"))


def window_ngrams(tokens: Column | str, anchor: str, reach: int, n: int) -> Column:
    """n-grams of words that all lie within ``reach`` words of an anchor."""

    def kept(w: Column) -> Column:
        close = lambda i: F.slice(w, F.greatest(F.lit(1), i + 1 - reach), reach + F.least(i, F.lit(reach)) + 1)
        near = F.transform(w, lambda _, i: F.exists(close(i), lambda x: x == anchor))
        return bound(near, lambda ok: F.filter(ngrams(w, n), lambda _, i: F.forall(F.slice(ok, i + 1, n), lambda x: x)))

    return bound(col(tokens), kept)


def compat_runs(words: list[str], anchor: str, reach: int) -> Iterator[list[str]]:
    """The runs that the reading automaton records: an anchor takes the ring of the last
    ``reach`` words as its left side, the right side is forgotten once it is full, and what
    is left at the end is a run too."""
    ring: deque[str] = deque(maxlen=reach)
    held: list[str] = []
    since, right = 0, False
    for word in words:
        ring.append(word)
        if word == anchor:
            held, since, right = list(ring), 0, True
            ring.clear()
            continue
        since += 1
        if right and since == reach:
            yield held
            held, right = [], False
            ring.clear()
    yield held + list(ring)


def anchored_ngrams(text: Column | str, anchor: str, reach: int, n: int, mode: str = "compat") -> Column:
    """array of the n-grams around an anchor word; ``mode`` is compat or window."""
    if mode == "window":
        return window_ngrams(anchor_words(text), anchor, reach, n)

    @F.pandas_udf("array<string>")
    def each(tokens: pd.Series) -> pd.Series:
        grams = lambda run: [" ".join(run[i : i + n]) for i in range(len(run) - n + 1)]
        return tokens.map(lambda t: [g for run in compat_runs([] if t is None else list(t), anchor, reach) for g in grams(run)])

    return each(anchor_words(text))
