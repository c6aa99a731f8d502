"""Benchmark decontamination by size-partitioned MinHash containment search.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. An item
leaks into a document that holds at least CONTAINMENT of the item's distinct 5-word shingles.
An item of one to four words has one shingle, all its words, and leaks where these stand in a row.

Items are partitioned by size, in classes by powers of two; an item of n shingles needs
ceil(0.8 n) of them, so any floor(0.2 n) + 1 of its shingles include one that a leaking
document holds. The MinHash sketch of an item is that many of its smallest shingle hashes. The
index holds sketches alone, by size class: documents are searched by their shingles, a class is
passed over by documents with too few shingles for its smallest item, and each hit makes the
pair a candidate, however long the document. Only candidates are verified, by the exact
containment of all the item's shingles.

The index, not the documents, is sent around: the items are cut into blocks of at most
BLOCK_SHINGLES shingles, each block is broadcast (16 MB at most by that bound) and meets every
document in the scan, so documents are never shuffled. More items mean more blocks, each with a
scan of its own. Items of more than BLOCK_BYTES bytes are neither collected nor broadcast: they
meet the documents that are long enough for them in a join on shingles.

Items without a word leak nowhere; nor do null texts. Repeated documents report alike; of
repeated item_ids each text is held on its own. A null doc_id stays null; items without an id
are not reported, as there is no id to report, but ``clean`` counts them. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, documents, keyed, put_back, row_key, set_aside

WORDS, CONTAINMENT = 5, 0.8
BLOCK_SHINGLES, BLOCK_BYTES = 1 << 20, 1 << 21
U = np.uint64
RESULT = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
#: Bytes that are hashed at once.
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word in the bytes its start and a 64-bit hash."""
    low = _LOWER[data]
    inside = _INSIDE[low]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.zeros(0, U)
    # A polynomial in an odd number over the word's bytes, each mixed by a table.
    size = stop - start
    h = np.zeros(len(start), U)
    padded = np.r_[low, np.zeros(8, np.uint8)]
    lanes = np.ndarray((len(low) + 1,), "<u8", np.ascontiguousarray(padded), strides=(1,))
    live = np.arange(len(start))
    for k in range(0, int(size.max()), 8):
        live = live[size[live] > k]
        left = np.minimum(size[live] - k, 8).astype(U)
        lane = lanes[start[live] + k] & (U(2**64 - 1) >> (U(64) - U(8) * left))
        h[live] = mixed((h[live] + U(0x9E3779B97F4A7C15)) ^ lane * U(0xC2B2AE3D27D4EB4F))
    return start, mixed(h + size.astype(U) * U(0x27D4EB2F165667C5))


def shingle_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, U)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = h * U(0x9FB21C651E98DF25) + words[k : len(words) - n + 1 + k]
        h ^= h >> U(29)
    return mixed(h)


def shingles_of(text: bytes | None) -> tuple[np.ndarray, int]:
    """The distinct sorted shingles of an item, and their words: less than WORDS for a short item."""
    words = word_hashes(np.frombuffer(text or b"", np.uint8))[1]
    n = min(len(words), WORDS)
    return np.unique(shingle_hashes(words, n)) if n else np.zeros(0, U), n


def needed(n: np.ndarray) -> np.ndarray:
    """Shingles of an item of n that a leaking document holds."""
    return np.ceil(CONTAINMENT * n - 1e-9).astype(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The smallest hashes of an item's distinct (sorted) shingles, as many as its size asks for."""
    n = len(shingles)
    return shingles[: n - int(needed(np.array(n))) + 1] if n else shingles


class SizeClass:
    """The sketches of items of like size and their exact shingles."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.size = np.array([len(s) for _, s in items], np.int64)
        self.least = int(needed(self.size).min())  # shingles of the shortest document that may leak
        keys = [sketch(s) for _, s in items]
        order = np.argsort(every := np.concatenate(keys), kind="stable")
        self.owner = np.repeat(np.arange(len(items)), list(map(len, keys)))[order]
        self.keys, self.first, self.times = np.unique(every[order], return_index=True, return_counts=True)
        # A bitmap over low hash bits keeps most shingles from the search.
        self.mask = U((1 << max(16, len(self.keys).bit_length() + 4)) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(self.keys & self.mask).astype(np.int64)] = True

    def candidates(self, doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Distinct pairs (document, item) of which the document holds a sketch hash; ``n``: shingles by document."""
        hit = np.flatnonzero(self.bits[(h & self.mask).astype(np.int64)])
        hit = hit[n[doc[hit]] >= self.least]
        at = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
        same = self.keys[at] == h[hit]
        d, at = doc[hit[same]], at[same]
        times = self.times[at]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item = self.owner[np.repeat(self.first[at], times) + step]
        d = np.repeat(d, times)
        enough = n[d] >= needed(self.size[item])
        return np.unique(np.c_[d[enough], item[enough]], axis=0)

    def leaks(self, doc: np.ndarray, h: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item_id, shared, shingles) of candidates that reach the containment. Rows are
        distinct and sorted by document and hash; those of document d start at ``start[d]``."""
        for d, i in self.candidates(doc, h, np.diff(start)).tolist():
            item_id, want = self.items[i]
            own = h[start[d] : start[d + 1]]
            shared = int((own[np.minimum(np.searchsorted(own, want), len(own) - 1)] == want).sum())
            if shared >= needed(self.size[i]):
                yield d, item_id, shared, len(want)


class Block:
    """Some items (id, shingles, words of a shingle) by words of a shingle and size class."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]]):
        groups: dict[tuple[int, int], list] = {}
        for item_id, s, words in items:
            groups.setdefault((words, len(s).bit_length()), []).append((item_id, s))
        self.classes: dict[int, list[SizeClass]] = {}
        for (words, _), own in sorted(groups.items()):
            self.classes.setdefault(words, []).append(SizeClass(own))

    def leaks(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item_id, shared, shingles) where the containment is reached."""
        words = _words_of(texts)
        for size, classes in self.classes.items():
            doc, h = _shingles(*words, size)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            once = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
            doc, h = doc[once], h[once]
            start = np.searchsorted(doc, np.arange(len(texts) + 1))
            for c in classes:
                yield from c.leaks(doc, h, start)


def item_blocks(items: DataFrame, unnamed: bool = False) -> Iterator[list[tuple[int, np.ndarray, int]]]:
    """Items of up to BLOCK_BYTES bytes with their distinct sorted shingles, in blocks of a bounded
    number of shingles. Rows stream through the driver one partition at a time, and only one block
    is held. Items without an id are left out unless ``unnamed``, where they get id 0."""
    block, size = [], 0
    rows = items.where(F.octet_length("text") <= BLOCK_BYTES).where(F.lit(unnamed) | F.col("item_id").isNotNull())
    for row in rows.select(F.coalesce("item_id", F.lit(0)).alias("item_id"), F.encode("text", "UTF-8").alias("b")).toLocalIterator():
        s, n = shingles_of(bytes(row.b))
        if not len(s):
            continue
        if block and size + len(s) > BLOCK_SHINGLES:
            yield block
            block, size = [], 0
        block.append((row.item_id, s, n))
        size += len(s)
    if block:
        yield block


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text, a row each."""
    for b in batches:
        names = [n for n in b.schema.names if n != "text"]
        for r, t in enumerate(b.column("text").cast(pa.binary())):
            h = np.unique(_shingles(*_words_of([t.as_py() or b""]), WORDS)[1]).view(np.int64)
            for at in range(0, len(h), 1 << 16):
                part = h[at : at + (1 << 16)]
                own = [b.column(n).take(pa.array(np.full(len(part), r))) for n in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(part)], [*names, "h"])


def huge_leaks(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(_k, _x, item, item_id, n_shared, n_shingles) of items above BLOCK_BYTES, if there is one: a
    join on shingles with documents of enough bytes for the smallest of them, counted by document."""
    huge = items.where(F.octet_length("text") > BLOCK_BYTES).select("item_id", F.col("text").cast("string").alias("text"))
    if huge.isEmpty():
        return None
    huge = huge.select("item_id", F.xxhash64("text").alias("item"), "text").mapInArrow(_shingle_rows, "item_id long, item long, h long")
    sizes = huge.groupBy("item", "item_id").agg(F.count("*").alias("n_shingles")).where("n_shingles > 0")
    # A shingle that is new has a byte of its own at least; shorter documents hold too few.
    least = sizes.agg(F.min("n_shingles")).first()[0] or 0
    long = keyed(docs, F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= int(CONTAINMENT * least))
    long = long.dropDuplicates(["_k", "_x"]).mapInArrow(_shingle_rows, "_k long, _x long, h long")
    shared = long.join(huge, "h").groupBy("_k", "_x", "item", "item_id").agg(F.count("*").alias("n_shared"))
    return shared.join(sizes, (shared.item == sizes.item) & shared.item_id.eqNullSafe(sizes.item_id)).where(
        F.col("n_shared") >= F.ceil(CONTAINMENT * F.col("n_shingles") - 1e-9)
    ).select("_k", "_x", shared.item, shared.item_id, "n_shared", "n_shingles")


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of every leak."""
    spark = docs.sparkSession
    arrow_limits(spark, 4)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [texts.mapInArrow(_scan(spark.sparkContext.broadcast(b)), RESULT) for b in item_blocks(items)]
    huge = huge_leaks(docs, items.where("item_id is not null"))
    if huge is not None:
        share = (F.col("n_shared") / F.col("n_shingles")).alias("containment")
        found.append(keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).join(huge, ["_k", "_x"]).select("doc_id", "item_id", "n_shared", "n_shingles", share))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], RESULT)


def _scan(shared):
    """A scan of documents for the items of one broadcast block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            block = block or Block(shared.value)
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            out = [(first + d, *leak) for part, first in _parts(texts) for d, *leak in block.leaks(part)]
            cols = list(zip(*out)) or [[], [], [], []]
            n, size = np.array(cols[2], np.int64), np.array(cols[3], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(n), pa.array(size), pa.array(n / np.maximum(size, 1))],
                ["doc_id", "item_id", "n_shared", "n_shingles", "containment"],
            )

    return each


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that some item leaks into, each judged by its own text: documents
    pass one block of items after the other and are neither shuffled nor joined, unless an item is
    above BLOCK_BYTES."""
    spark = docs.sparkSession
    arrow_limits(spark, 4)
    out, names = set_aside(docs)
    text = names["text"]
    out = out.withColumn(text, F.col(text).cast("string"))
    for b in item_blocks(items, unnamed=True):
        out = out.mapInArrow(_keep(spark.sparkContext.broadcast(b), text), out.schema)
    huge = huge_leaks(docs, items)
    if huge is not None:
        out = out.select("*", *row_key(F.col(names["doc_id"]), F.col(text))).join(huge.select("_k", "_x").distinct(), ["_k", "_x"], "left_anti")
    return out.select(*put_back(names))


def _keep(shared, text: str):
    """The rows of documents that no item of one broadcast block leaks into."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            block = block or Block(shared.value)
            texts = [t or b"" for t in b.column(text).cast(pa.binary()).to_pylist()]
            fine = np.ones(len(texts), bool)
            for part, first in _parts(texts):
                fine[[first + d for d, *_ in block.leaks(part)]] = False
            yield b.filter(pa.array(fine))

    return each


def _parts(texts: list[bytes]) -> Iterator[tuple[list[bytes], int]]:
    """Runs of texts of about PIECE bytes, and each run's first index."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > PIECE:
            yield texts[first : i + 1], first
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:], first


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words of some texts: the text's index and the hash."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    start, words = word_hashes(data)
    return np.searchsorted(end, start, side="right"), words


def _shingles(of: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of n words, each with its text's index."""
    h = shingle_hashes(words, n)
    inside = of[: len(h)] == of[n - 1 : n - 1 + len(h)]
    return of[: len(h)][inside], h[inside]


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') FROM benchmark WHERE item_id IS NOT NULL
), lengths AS (SELECT DISTINCT least(len(w), 5) AS n FROM words WHERE kind = 1 AND len(w) > 0
), shingles AS (
  SELECT DISTINCT kind, id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM words JOIN lengths ON kind = 0 OR n = least(len(w), 5), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), sizes AS (SELECT id AS item_id, count(*) AS n_shingles FROM shingles WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, n_shingles, count(*)::DOUBLE / n_shingles AS containment
FROM shingles d JOIN shingles b ON d.n = b.n AND d.s = b.s JOIN sizes ON sizes.item_id = b.id
WHERE d.kind = 0 AND b.kind = 1
GROUP BY d.id, b.id, n_shingles
HAVING count(*) >= 0.8 * n_shingles
"""


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that some benchmark item leaks into, items without an id included. Rows
    are judged one by one by their own text: null and empty texts stay, repeated rows stay or go
    together, an empty table of either sort changes nothing, columns are as they came."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
