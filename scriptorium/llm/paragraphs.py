"""Substring dedup by paragraph MinHash banding.

Two sorts of units are compared, by words as in ``decontaminate``:

* Paragraphs: lines of PARAGRAPH_WORDS or more, the operator's least length (an argument).
  Equal ones are one class. A class has
  BANDS bands of ROWS minima of its 5-word shingles, so that two of similarity 0.8 miss
  each other in all bands once in 10,000 times. Classes that collide are joined and
  verified by exact Jaccard similarity, and components of the links are the groups.
* Passages inside longer paragraphs: words are cut where a word pair's hash is the least
  within REACH words, which depends on nothing farther, so a copied passage is cut alike
  wherever it stands; a text's two ends cut as well, so pieces cover every word. Pieces that
  stand at more than one place, of one document or more, are seeds where SEED_WORDS or more of
  them are in a row; a row of pieces that stand earlier goes on word by word before and behind,
  against the earlier copies of its first and last piece. What has PASSAGE_WORDS or more then is a
  passage; passages are one group with those that hold their first copies.

The first paragraph of a group (smallest doc_id, then a hash of the text, then place) is kept,
the others are removals.
Of passages those words are removals that stand earlier in the group, so each removed word has
a kept copy; two removals may overlap where both go on into what lies between them.

Hot bands: bands of the same members are compared once; a band's classes meet in blocks of at
most BLOCK on either side, and a block leaves a spanning forest of its links, never its pairs. Counts are combined before they are
shuffled and joined back from written tables.

Null and empty texts have no unit; nor have documents of fewer words. A document is known by
doc_id and text: repeated rows are one, and rows of one id (or none) with different texts are
documents of their own. A null doc_id counts as the smallest and is returned as null. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, arrow_limits, documents, keyed, own_id
from .components import connected_components
from .decontaminate import WORDS, U, _parts, mixed, shingle_hashes, word_hashes
from .simhash import _whole_groups, forest

SIMILARITY = 0.8
PARAGRAPH_WORDS, BANDS, ROWS = 20, 12, 3
REACH, PASSAGE_WORDS = 5, 16
#: Words of a run of shared pieces that is looked at: a piece between two cuts has as many.
SEED_WORDS = REACH + 1
BLOCK = 256
#: Shingles that are compared at once.
CHUNK = 1 << 20
_rng = np.random.default_rng(12)
FACTORS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
POSITION = U(0x9E3779B97F4A7C15)


def _words(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of some texts' words their hash, text and line; and each text's first line."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    start, h = word_hashes(data)
    breaks = np.flatnonzero(data == 10)
    return h, np.searchsorted(end, start, side="right"), np.searchsorted(breaks, start), np.searchsorted(breaks, np.r_[0, end[:-1]])


def _runs(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)


def _sequence_hash(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of words, its order included."""
    total = np.zeros(len(first), U)
    if len(first):
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(first, size) + place
        total = np.add.reduceat(mixed(h[at] + place.astype(U) * POSITION), np.cumsum(size) - size)
    return mixed(total + size.astype(U))


def band_keys(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bands of each run of words, which has WORDS of them or more."""
    bands = np.zeros((len(first), BANDS), U)
    if len(first):
        s = shingle_hashes(h)
        m = size - WORDS + 1
        at = np.repeat(first, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        own, cut = s[at], np.cumsum(m) - m
        for band in range(BANDS):
            key = np.full(len(first), U(band + 1))
            for r in range(ROWS):
                f = FACTORS[band * ROWS + r]
                x = own * f
                key = mixed(key + np.minimum.reduceat(x ^ (x >> U(32)), cut))
            bands[:, band] = key
    return bands


def paragraphs(texts: list[bytes], least: int = PARAGRAPH_WORDS) -> tuple[np.ndarray, ...]:
    """Of each paragraph its text, first word in the text, words, class and bands."""
    h, of, line, _ = _words(texts)
    first = _runs(line)
    size = np.diff(np.r_[first, len(h)])
    first, size = first[size >= max(least, WORDS)], size[size >= max(least, WORDS)]
    word0 = np.searchsorted(of, np.arange(len(texts)))
    return of[first], first - word0[of[first]], size, _sequence_hash(h, first, size), band_keys(h, first, size)


def _cut(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each piece between two cuts, and the word behind it; ``of``: each word's text."""
    if len(h) < 2:
        return np.zeros(len(h), np.int64), np.ones(len(h), np.int64)
    pair = mixed(h[:-1] * U(3) + h[1:])
    pair = np.where(of[:-1] == of[1:], pair, U(2**64 - 1))
    gap = 2 * REACH
    place = np.arange(len(pair)) + gap * (of[:-1] + 1)
    wide = np.full(place[-1] + gap + 1, U(2**64 - 1))
    wide[place] = pair
    least = np.lib.stride_tricks.sliding_window_view(wide, REACH).min(1)
    is_cut = (pair < least[place - REACH]) & (pair <= least[place + 1]) & (pair < U(2**64 - 1))
    a = np.union1d(np.flatnonzero(is_cut), _runs(of))  # a text's first word starts a piece
    return a, np.r_[a[1:], len(h)]


def pieces(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each piece between two cuts its text, first word, words and hash."""
    h, of, _, _ = _words(texts)
    a, b = _cut(h, of)
    word0 = np.searchsorted(of, np.arange(len(texts)))
    return of[a], a - word0[of[a]], b - a, _sequence_hash(h, a, b - a)


def beside(texts: list[bytes], text: np.ndarray, at: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words before pieces of some texts (or behind them), the nearest first, and how
    many they are: as many as the neighbouring piece has, and as its far cut depends on beyond it. A
    match that went farther would have that cut too, so that the piece would be shared."""
    h, of, _, _ = _words(texts)
    a, b = _cut(h, of)
    word0, word1 = np.searchsorted(of, np.arange(len(texts))), np.searchsorted(of, np.arange(len(texts)), side="right")
    k = np.searchsorted(a, word0[text] + at)
    prev, after = np.maximum(k - 1, 0), np.minimum(k + 1, len(a) - 1)
    low = np.maximum(a[prev] - REACH, word0[text])
    high = np.minimum(b[after] + REACH + 1, word1[text])
    size = np.where(behind, high - b[k], a[k] - low)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return h[np.where(np.repeat(behind, size), np.repeat(b[k], size) + place, np.repeat(a[k], size) - 1 - place)], size


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]


def _keys(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column("_k").to_numpy(), b.column("_x").to_numpy()]


def _paragraph_rows(least: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = _keys(b), _texts(b)
            for part, first in _parts(texts):
                of, at, n, h, bands = paragraphs(part, least)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(pa.array(k[first + of]) for k in keys), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), lists], ["_k", "_x", "at", "n", "h", "bands"])

    return each


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, texts = _keys(b), _texts(b)
        for part, first in _parts(texts):
            of, at, n, h = pieces(part)
            yield pa.RecordBatch.from_arrays([*(pa.array(k[first + of]) for k in keys), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64))], ["_k", "_x", "at", "n", "h"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted distinct shingles of the wanted paragraphs (list column of at, n, h)."""
    for b in batches:
        for t, want in zip(_texts(b), b.column("want").to_pylist()):
            h, _, _, _ = _words([t])
            sets = [np.unique(shingle_hashes(h[w["at"] : w["at"] + w["n"]])).view(np.int64) for w in want]
            yield pa.RecordBatch.from_arrays([pa.array([w["h"] for w in want], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["h", "shingles"])


def jaccard(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The similarity of sets i and j, pair by pair."""
    size = np.array([len(s) for s in sets])
    out = np.zeros(len(i))
    # Some pairs at a time, by their shingles: long texts have many.
    part = np.cumsum(size[i] + size[j]) // CHUNK
    for lo, hi in zip(_runs(part).tolist(), [*_runs(part)[1:].tolist(), len(i)]):
        a, b = i[lo:hi], j[lo:hi]
        both = np.concatenate([x for p, q in zip(a.tolist(), b.tolist()) for x in (sets[p], sets[q])])
        pair = np.repeat(np.arange(len(a)), size[a] + size[b])
        order = np.lexsort((both, pair))
        both, pair = both[order], pair[order]
        twice = np.flatnonzero((both[1:] == both[:-1]) & (pair[1:] == pair[:-1]))
        shared = np.bincount(pair[twice], minlength=len(a))
        out[lo:hi] = shared / (size[a] + size[b] - shared)
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the links within blocks: rows sorted by band, x and y, of side x or y."""
    for b in _whole_groups(batches, ("band", "x", "y")):
        band, x, y, h, side = (b.column(c).to_numpy(zero_copy_only=False) for c in ("band", "x", "y", "h", "side"))
        ids, first, node = np.unique(h, return_index=True, return_inverse=True)
        column = b.column("shingles")
        sets = [column[int(r)].values.to_numpy() for r in first]
        root = np.arange(len(ids))
        cut = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), True])
        stars, groups = [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if x[lo] == y[lo]:
                left = right = node[lo:hi]
            else:
                left, right = node[lo:hi][side[lo:hi] == 0], node[lo:hi][side[lo:hi] == 1]
            if len(left) and len(right):
                groups.append((left, right))
                every = np.r_[left, right]
                stars.append(np.c_[np.full(len(every), every[0]), every])
        # First everyone with the first of its group, then only pairs not yet tied.
        for pairs in chain([stars], _open_pairs(groups, lambda: root)):
            pairs = np.unique(np.sort(np.concatenate(pairs), 1), axis=0) if pairs else np.zeros((0, 2), np.int64)
            pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
            if len(pairs):
                like = jaccard(sets, pairs[:, 0], pairs[:, 1]) >= SIMILARITY
                root = forest(len(ids), iter([(np.arange(len(ids)), root), (pairs[like, 0], pairs[like, 1])]))
        tied = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[root[tied]])], ["a", "b"])


def _open_pairs(groups, root):
    """Pairs of each group that are not tied yet, some 100,000 at a time."""
    held, size = [], 0
    for left, right in groups:
        i, j = np.nonzero(root()[left][:, None] != root()[right][None])
        held.append(np.c_[left[i], right[j]])
        size += len(i)
        if size > 100_000:
            yield held
            held, size = [], 0
    if held:
        yield held


def paragraph_groups(texts: DataFrame, tables: Tables, least: int = PARAGRAPH_WORDS) -> DataFrame:
    """(_k, _x, at, n, g): paragraphs of groups of two or more; g names the group."""
    units = tables.write(texts.mapInArrow(_paragraph_rows(least), "_k long, _x long, at int, n int, h long, bands array<long>"))
    classes = tables.write(units.groupBy("h").agg(F.min(F.struct("_k", "_x", "at", "n")).alias("u"), F.first("bands").alias("bands"), F.count("*").alias("m")))
    bands = classes.select("h", F.explode("bands").alias("band"))
    members = bands.groupBy("band").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("h")).alias("x"))
    # Bands of the same members are one.
    shared = tables.write(members.where("h0 <> h1").groupBy("h0", "h1", "m", "x").agg(F.min("band").alias("band")).select("band", "m"))
    met = tables.write(bands.join(shared, "band").select("band", "h", "m"))
    want = met.select("h").distinct().join(classes, "h").groupBy("u._k", "u._x").agg(F.collect_list(F.struct("u.at", "u.n", "h")).alias("want"))
    sets = tables.write(texts.join(want, ["_k", "_x"]).mapInArrow(_shingle_rows, "h long, shingles array<long>").dropDuplicates(["h"]))
    # Large bands are cut in parts; each pair of parts is a block.
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.lit(5), "h"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    rows = met.select("band", "h", own.alias("own"), other.alias("other")).select(
        "band", "h", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    rows = rows.join(sets, "h").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    links = tables.write(rows.mapInArrow(_verified, "a long, b long"))
    groups = connected_components(links, tables)
    named = classes.join(groups, classes.h == groups.node, "left").select("h", "m", F.coalesce("component", "h").alias("g"))
    named = tables.write(named)
    large = tables.write(named.groupBy("g").agg(F.sum("m").alias("all")).where("all > 1").select("g"))
    named = tables.write(named.join(large, "g").select("h", "g"))
    return units.join(named, "h").select("_k", "_x", "at", "n", "g")


def _beside_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words beside wanted pieces (list column of at, side): before one (side 0) or behind it."""
    for b in batches:
        keys, texts, want = _keys(b), _texts(b), b.column("want")
        times = want.value_lengths().to_numpy(zero_copy_only=False)
        start = np.r_[0, np.cumsum(times)]
        places = [want.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("at", "side")]
        for part, first in _parts(texts):
            own = slice(start[first], start[first + len(part)])
            text = np.repeat(np.arange(len(part)), times[first : first + len(part)])
            at, side = (p[own] for p in places)
            h, size = beside(part, text, at, side == 1)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(pa.array(k[first + text]) for k in keys), pa.array(at), pa.array(side), lists], ["_k", "_x", "at", "side", "w"])


def _extended(texts: DataFrame, spans: DataFrame, tables: Tables) -> DataFrame:
    """(id, span, before, behind): by how many words the match of each removed span goes on, word by
    word, against the earlier copy of its first and of its last piece."""
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"{c}.at").alias("at"), F.col(f"{c}.u").alias("u")) for k, c in enumerate("lr")])).alias("e")
    ends = tables.write(spans.select("_k", "_x", "id", "span", ends).select("_k", "_x", "id", "span", "e.side", "e.at", F.col("e.u._k").alias("uk"), F.col("e.u._x").alias("ux"), F.col("e.u.at").alias("uat")))
    mine, other = ends.select("_k", "_x", "at", "side"), ends.select(F.col("uk").alias("_k"), F.col("ux").alias("_x"), F.col("uat").alias("at"), "side")
    want = mine.union(other).distinct().groupBy("_k", "_x").agg(F.collect_list(F.struct("at", "side")).alias("want"))
    beside = texts.join(tables.write(want), ["_k", "_x"]).mapInArrow(_beside_rows, "_k long, _x long, at int, side int, w array<long>")
    beside = tables.write(beside.dropDuplicates(["_k", "_x", "at", "side"]))
    earlier = beside.select(F.col("_k").alias("uk"), F.col("_x").alias("ux"), F.col("at").alias("uat"), "side", F.col("w").alias("v"))
    differ = F.array_position(F.zip_with("w", "v", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    more = F.when(differ == 0, F.size("w")).otherwise(differ - 1).cast("int").alias("more")
    met = ends.join(beside, ["_k", "_x", "at", "side"]).join(earlier, ["uk", "ux", "uat", "side"]).select("id", "span", "side", more)
    of = lambda k, name: F.max(F.when(F.col("side") == k, F.col("more"))).alias(name)
    return met.groupBy("id", "span").agg(of(0, "before"), of(1, "behind"))


def passage_groups(texts: DataFrame, tables: Tables) -> DataFrame:
    """(_k, _x, at, n, g, removed): passages that stand earlier, to the word, and their first copies."""
    place = F.struct("_k", "_x", "at")
    rows = tables.write(texts.mapInArrow(_piece_rows, "_k long, _x long, at int, n int, h long"))
    shared = tables.write(rows.groupBy("h").agg(F.min(place).alias("u"), F.max(place).alias("v")).where("u < v").select("h"))
    met = tables.write(rows.join(shared, "h"))
    tables.drop(shared)
    tables.drop(rows)
    # Gaps and islands within a document.
    by = W.partitionBy("_k", "_x").orderBy("at")
    new = F.coalesce((F.lag(F.col("at") + F.col("n")).over(by) < F.col("at")).cast("int"), F.lit(1))
    runs = met.dropDuplicates(["_k", "_x", "at"]).withColumn("run", F.sum(new).over(by))
    of_run = W.partitionBy("_k", "_x", "run")
    runs = runs.select("_k", "_x", "h", "at", "n", F.min("at").over(of_run).alias("run"), F.sum("n").over(of_run).alias("all")).where(F.col("all") >= SEED_WORDS)
    runs = tables.write(runs.select("_k", "_x", "h", "at", "n", F.xxhash64(F.lit(2), "_k", "_x", "run").alias("id")))
    tables.drop(met)
    first = tables.write(runs.groupBy("h").agg(F.min(F.struct("_k", "_x", "at", "id")).alias("u"), F.max(place).alias("v")).where(F.struct("u._k", "u._x", "u.at") < F.col("v")).select("h", "u"))
    # Only a piece that stands earlier goes; what a run adds to the kept ones stays.
    by = W.partitionBy("id").orderBy("at")
    later = runs.join(first, "h").withColumn("removed", place > F.struct("u._k", "u._x", "u.at"))
    turn = F.coalesce(((F.lag("removed").over(by) != F.col("removed")) | (F.lag(F.col("at") + F.col("n")).over(by) < F.col("at"))).cast("int"), F.lit(1))
    later = tables.write(later.withColumn("turn", turn).withColumn("span", F.sum("turn").over(by)).drop("turn"))
    tables.drop(runs)
    end = F.struct("at", "u")
    spans = tables.write(later.where("removed").groupBy("_k", "_x", "id", "span").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"), F.min(end).alias("l"), F.max(end).alias("r")))
    whole = spans.join(_extended(texts, spans, tables), ["id", "span"], "left").select(
        "_k", "_x", "id", "span", (F.col("at") - F.coalesce("before", F.lit(0))).alias("at"), (F.col("n") + F.coalesce("before", F.lit(0)) + F.coalesce("behind", F.lit(0))).alias("n")
    )
    whole = tables.write(whole.where(F.col("n") >= PASSAGE_WORDS))
    # Runs are one group where a passage of one has its first copy in the other.
    gone = tables.write(later.join(whole.select("id", "span"), ["id", "span"], "left_semi").select("id", "h", F.col("u.id").alias("first")))
    groups = connected_components(gone.select(F.col("id").alias("a"), F.col("first").alias("b")), tables)
    kept = later.where("not removed").join(gone.select("h").distinct(), "h").groupBy("_k", "_x", "id", "span")
    kept = kept.agg(F.min("at").alias("at"), (F.max(F.col("at") + F.col("n")) - F.min("at")).cast("int").alias("n"))
    found = whole.withColumn("removed", F.lit(True)).unionByName(kept.withColumn("removed", F.lit(False)))
    return found.join(groups, F.col("id") == F.col("node"), "left").select("_k", "_x", "at", "n", F.coalesce("component", "id").alias("g"), "removed")


def repeats(docs: DataFrame, tables: Tables | None = None, least: int = PARAGRAPH_WORDS) -> DataFrame:
    """(doc_id, kind, first_word, n_words, group_doc_id, removed) of every grouped unit;
    ``least``: words of the shortest paragraph (5 at least, as a shingle has)."""
    tables = tables or Tables(docs.sparkSession)
    arrow_limits(docs.sparkSession, 4)
    texts = keyed(docs, F.col("text").cast("string").alias("text"))
    found = paragraph_groups(texts, tables, least).select("_k", "_x", "at", "n", "g", F.lit(None).cast("boolean").alias("removed"), F.lit("paragraph").alias("kind"))
    found = found.union(passage_groups(texts, tables).withColumn("kind", F.lit("passage"))).distinct()
    found = tables.write(found)
    first = tables.write(found.groupBy("kind", "g").agg(F.min(F.struct("_k", "_x", "at")).alias("u")))
    out = found.join(first, ["kind", "g"])
    return out.select(
        own_id(), "kind", F.col("at").alias("first_word"), F.col("n").alias("n_words"), own_id("u._k").alias("group_doc_id"),
        F.coalesce("removed", F.struct("_k", "_x", "at") != F.col("u")).alias("removed"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))
