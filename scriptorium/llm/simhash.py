"""SimHash near-duplicates, linked by a binary-trie self-join.

A document's fingerprint takes the majority of each bit over the XXH64 hashes of its
3-word shingles. Documents of one fingerprint are one class; only distinct
fingerprints are joined. Two fingerprints that differ in at most two of 64 bits agree
wholly in two of four 16-bit blocks, so each fingerprint is dealt to the six block
pairs (32 equal bits, the trie's common path), and below each of these the trie over
the other 32 bits is walked in pairs of nodes: differing bits add up, and a pair of
nodes is dropped as soon as it has more than the budget. A fingerprint has at most
529 partners below one path, so work and memory grow with the rows of a path, never
with their square; only a spanning forest of the links leaves a task.

Nulls and empty texts have fingerprint zero and link like others. Rows are the nodes: each
links by its own text, so rows of one id and different texts may be in different groups, and
repeated rows repeat their result. A null doc_id counts as the smallest id and is returned
as null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, arrow_limits, documents, keyed, own_id, put_back, row_key, set_aside
from .components import connected_components

SEED, SHINGLE, BITS, BUDGET = 42, 3, 64, 2
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 18
#: Paths of more rows than the first number are dealt out by so many of their next bits.
SPLITS = ((256, 6), (1 << 14, 10), (1 << 20, 14))
#: Node pairs that are widened at once.
FRONTIER = 1 << 18


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, 0 where it has no word."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    ones, start, stop = np.zeros(BITS, np.int64), (end - size)[: 1 - shingle], end[shingle - 1 :]
    for k in range(0, len(start), CHUNK):
        a, b = start[k : k + CHUNK].tolist(), stop[k : k + CHUNK].tolist()
        h = np.array([xxh64_intdigest(line[i:j], SEED) for i, j in zip(a, b)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    up = np.packbits(2 * ones > len(start), bitorder="little")
    return int(up.view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(_k long, fp long): fp is the fingerprint as a signed long."""
    arrow_limits(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fp = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(fp, pa.int64())], ["_k", "fp"])

    return keyed(docs, F.col("text").cast("string").alias("text")).mapInArrow(each, "_k long, fp long")


def trie_pairs(values: np.ndarray, groups: np.ndarray, budget: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one group whose values differ in at most ``budget`` of ``bits`` bits.

    ``values`` (unsigned) are sorted within each run of equal ``groups``. A trie node is a
    range of rows that share the bits above its level. Pairs of nodes are walked depth first
    in blocks of at most FRONTIER, so memory stays bounded.
    """
    if len(values) < 2:
        return
    cut = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    lo, hi = cut[:-1], cut[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    stack = [(bits - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        level, alo, ahi, blo, bhi, err = stack.pop()
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(level, alo[s], ahi[s], blo[s], bhi[s], err[s]) for s in (slice(half), slice(half, None))]
            continue
        if level < 0:
            yield from _leaves(alo, ahi, blo, bhi)
            continue
        # The first row of each node whose bit at this level is 1.
        bit = ((values >> values.dtype.type(level)) & values.dtype.type(1)).astype(np.int64)
        ones = np.r_[0, np.cumsum(bit)]
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        kids = [
            (alo, amid, blo, bmid, err, np.ones(len(alo), bool)),
            (amid, ahi, bmid, bhi, err, np.ones(len(alo), bool)),
            (alo, amid, bmid, bhi, err + 1, np.ones(len(alo), bool)),
            (amid, ahi, blo, bmid, err + 1, ~same),
        ]
        parts = []
        for a, b, c, d, e, ok in kids:
            ok = ok & (b > a) & (d > c) & (e <= budget) & ~((a == c) & (b - a < 2))
            parts.append((a[ok], b[ok], c[ok], d[ok], e[ok]))
        stack.append((level - 1, *(np.concatenate(x) for x in zip(*parts))))


def _leaves(alo, ahi, blo, bhi):
    """Rows of one leaf are equal below the path; values are distinct, so leaves hold one row."""
    keep = alo != blo
    if keep.any():
        yield np.minimum(alo, blo)[keep], np.maximum(alo, blo)[keep]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the smallest row that the pairs tie it to."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            while True:  # compress
                na, nb = root[ra], root[rb]
                if (na == ra).all() and (nb == rb).all():
                    break
                ra, rb = na, nb
            far = ra != rb
            a, b, ra, rb = a[far], b[far], ra[far], rb[far]
            if len(a):
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


BLOCKS = [list(p) for p in combinations(range(4), 2)]


def _path(p: list[int], inside: bool):
    """The 32 bits of fp in the blocks of p, or in the others."""
    a, b = p if inside else [x for x in range(4) if x not in p]
    part = lambda k: F.shiftrightunsigned(F.col("fp"), 16 * k).bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(part(b), 16).bitwiseOR(part(a))


def near_links(classes: DataFrame, tables: Tables) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``classes`` (fp long), as a spanning forest
    of each path's links."""
    rows = classes.select(
        "fp",
        F.inline(
            F.array(*[F.struct(F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(_path(p, True)).alias("path"), _path(p, False).alias("rest")) for i, p in enumerate(BLOCKS)])
        ),
    )
    # Paths with many rows go on by pairs of nodes: each row joins the node pairs of its next
    # bits and of every value within the budget; the smaller node names the pair.
    sizes = tables.write(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = F.array(F.struct(F.lit(-1).cast("long").alias("x"), F.lit(-1).cast("long").alias("y")))
    for rows_of_path, bits in SPLITS:
        near = [0] + [sum(1 << b for b in c) for k in range(1, BUDGET + 1) for c in combinations(range(bits), k)]
        node = F.shiftrightunsigned("rest", 32 - bits)
        pairs = F.transform(
            F.array(*[F.lit(m).cast("long") for m in near]),
            lambda m, node=node: F.struct(F.least(node, node.bitwiseXOR(m)).alias("x"), F.greatest(node, node.bitwiseXOR(m)).alias("y")),
        )
        dealt = F.when(F.col("n") > rows_of_path, pairs).otherwise(dealt)
    rows = rows.join(sizes, "path").select("path", "rest", "fp", F.inline(dealt))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in _whole_groups(batches, ("path", "x", "y")):
            held = [b]
            t = pa.Table.from_batches(held)
            path, x, y, rest, fp = (t.column(c).to_numpy() for c in ("path", "x", "y", "rest", "fp"))
            group = np.cumsum(np.r_[0, (path[1:] != path[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            root = forest(len(rest), trie_pairs(rest.astype(np.uint64), group, BUDGET, 32))
            tied = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[root[tied]])], ["a", "b"])

    dealt_rows = rows.repartition("path", "x", "y").sortWithinPartitions("path", "x", "y", "rest")
    return dealt_rows.mapInArrow(walk, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a group of sorted rows is never split."""
    rest = None
    for b in batches:
        if rest is not None and rest.num_rows:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for c in by:
            v = b.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last:
            yield b.slice(0, last)
        rest = b.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def near_duplicates(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text)."""
    tables = tables or Tables(docs.sparkSession)
    prints = tables.write(fingerprints(docs))
    classes = tables.write(prints.groupBy("fp").agg(F.min("_k").alias("rep")))
    parts = connected_components(near_links(classes.select("fp"), tables), tables)
    named = tables.write(classes.join(parts, classes.fp == parts.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("part")))
    least = tables.write(named.groupBy("part").agg(F.min("rep").alias("_c")))
    named = tables.write(named.join(least, "part").select("fp", "_c"))
    return prints.join(named, "fp").select(
        own_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), own_id("_c").alias("component_id")
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, find) -> DataFrame:
    """docs without all but the first document (smallest doc_id, null first, then by a hash of
    the text) of each group that ``find`` names: (_k, _x, kept) for every document. Of rows with
    the same doc_id and text one stays, the first by a hash of all its columns. Null and empty
    texts are one group; an empty table stays empty; columns are as they came."""
    tables = Tables(spark)
    gone = tables.write(find(docs.select("doc_id", "text"), tables).where("not kept").select("_k", "_x").distinct())
    plain, names = set_aside(docs)
    own = list(names.values())
    rest = plain.select(*row_key(F.col(names["doc_id"]), F.col(names["text"])), F.struct(*own).alias("row"))
    rest = rest.join(gone, ["_k", "_x"], "left_anti")
    one = rest.groupBy("_k", "_x").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return one.select("row.*").select(*put_back(names))
