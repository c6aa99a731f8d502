"""Exact substring dedup by a depth-limited radix sort of suffixes.

Suffixes are ordered only through DEPTH bytes: two of them are told apart by the passes
below or fall into one group, and a group is exactly a repeated DEPTH-byte window. A row for
every suffix and digit would be many times the text, so two passes first tell apart what needs no order:

1. A window's anchor: the GRAM bytes with the smallest hash in the window (the first of equal
   ones). Equal windows have equal anchors at the same place, and about 35 neighbouring
   windows share one anchor, so one row stands for 35 suffixes.
2. The anchor's reach: all bytes of the windows that share it. Where every occurrence of
   an anchor has the same reach, all its windows repeat alike and need no order; else the
   first occurrence of each reach goes on.
3. The suffixes below one anchor are ordered by most-significant-digit passes, DIGIT bytes at a
   time: each pass orders the members of each group by their next digit and parts the group where it changes,
   and groups of one leave. After the last digit a group is a repeated window.

A hot group is never gathered: passes 1 and 2 are min-aggregations, combined before they are
shuffled, written and joined back on their key, where adaptive execution splits a hot key's
rows over tasks. Pass 3 takes anchors of at most TOGETHER reaches; the windows of the others are
grouped by hash in a min-aggregation as well. Hashes have 64 bits (96 for those windows).

Nulls are empty texts, empty and short texts lose nothing. A document is known by doc_id and
text: of rows with the same doc_id (or none) each is held against smaller ids and itself, so
a repeated row repeats its result. A null doc_id counts as the smallest id. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, arrow_limits, documents, keyed, own_id

DEPTH, GRAM = 100, 40
#: Grams in a window; 64 at most, for a place to fit in six bits.
WIDE = DEPTH - GRAM + 1
DIGIT = 8
#: Runs of one anchor that are ordered in one task.
TOGETHER = 4096
#: Bytes that are hashed at once.
BLOCK = 1 << 19
U = np.uint64
MIX = tuple(map(U, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    n = len(data) - GRAM + 1
    lanes = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out = lanes[:n] * MIX[0]
    for k in range(1, GRAM // 8):
        part = lanes[8 * k : 8 * k + n] * MIX[k]
        part ^= part >> U(31)
        out += part
        out *= MIX[0]
    return mixed(out)


def first_minima(h: np.ndarray) -> np.ndarray:
    """For each window of WIDE neighbours the position of its smallest value, the first of
    equal ones. The lowest 7 bits of h are not compared."""
    n, rows = len(h) - WIDE + 1, -(-len(h) // WIDE)
    pad = np.full(rows * WIDE, U(2**64 - 1))
    pad[: len(h)] = h
    pad = (pad & ~U(127)).reshape(rows, WIDE) | np.arange(WIDE, dtype=U)
    # A window is the end of one row and the start of the next; bit 6 marks the latter.
    least = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    least = np.minimum(least, np.minimum.accumulate(pad, axis=1).ravel()[WIDE - 1 : WIDE - 1 + n] | U(64))
    low = (least & U(127)).astype(np.int64)
    return np.arange(n) // WIDE * WIDE + (low & 63) + (low >> 6) * WIDE


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each run of windows that share an anchor: its text, the anchor's place, the run's
    first and last window, the hash of the anchor and of all bytes of the run."""
    parts = []
    block: list[int] = []
    size = 0
    for k in range(len(texts) + 1):
        if block and (k == len(texts) or size + len(texts[k]) > BLOCK):
            parts += _block(texts, block)
            block, size = [], 0
        if k < len(texts) and len(texts[k]) >= DEPTH:
            block.append(k)
            size += len(texts[k])
    if not parts:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),) * 2
    return tuple(np.concatenate(x) for x in zip(*parts))


def _block(texts: list[bytes], block: list[int]) -> Iterator[tuple[np.ndarray, ...]]:
    data = np.frombuffer(b"".join(texts[k] for k in block), np.uint8)
    size = np.array([len(texts[k]) for k in block])
    end = np.cumsum(size)
    for at in range(0, max(1, len(data) - DEPTH + 1), BLOCK * 2):  # a very long text goes in pieces
        piece = data[at : at + BLOCK * 2 + DEPTH - 1]
        if len(piece) < DEPTH:
            break
        h = grams(piece)
        place = first_minima(h)
        s = np.arange(len(place))
        of = np.searchsorted(end, s + at, side="right")
        inside = s + at + DEPTH <= end[of]
        new = np.r_[True, (place[1:] != place[:-1]) | (of[1:] != of[:-1]) | ~inside[:-1]] & inside
        first = np.flatnonzero(new)
        if not len(first):
            continue
        # A run ends where the next begins or its text ends.
        last = np.minimum(np.r_[first[1:] - 1, len(place) - 1], end[of[first]] - DEPTH - at)
        a = place[first]
        reach = h[first] * MIX[1] + h[first + GRAM] * MIX[2] + h[last + DEPTH - 2 * GRAM] * MIX[3] + h[last + DEPTH - GRAM] * MIX[0]
        reach = mixed(reach + (a - first).astype(U) * U(2654435761) + (last - a + WIDE).astype(U) * U(40503 << 20))
        shift = at - (end - size)[of[first]]
        yield np.array(block)[of[first]], a + shift, first + shift, last + shift, h[a], reach


def _later(key: np.ndarray, k: np.ndarray, x: np.ndarray, at: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Which rows have a row with the same key (and more) at a smaller k, or in the same
    document (k, x) at a smaller place."""
    out = np.zeros(len(key), bool)
    if not len(key):
        return out
    more = np.zeros(len(key), U) if more is None else more
    order = np.lexsort((at, x, k, more, key))
    a, b, c, e, d = key[order], more[order], k[order], x[order], at[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    own = new | np.r_[True, (c[1:] != c[:-1]) | (e[1:] != e[:-1])]
    first, mine = (np.maximum.accumulate(np.where(flag, np.arange(len(a)), 0)) for flag in (new, own))
    out[order] = (c > c[first]) | (d > d[mine])
    return out


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]


ANCHORS = "_k long, _x long, s long, n int, later boolean, ah long, reach long"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of n windows from s on. Of equal runs of one batch only the first goes on; the
    others are known to be later, so a passage that many documents share is combined here."""
    for b in batches:
        k, x = b.column("_k").to_numpy(), b.column("_x").to_numpy()
        of, _, first, last, ah, reach = anchors(_texts(b))
        later = _later(ah, k[of], x[of], first, reach)
        cols = (k[of], x[of], first, (last - first + 1).astype(np.int32), later, ah.view(np.int64), reach.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["_k", "_x", "s", "n", "later", "ah", "reach"])


OPEN = "_k long, _x long, s long, n int, hot boolean, later boolean, key long, data binary"


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs (list column ``runs`` of s, n, ah, hot) of each text: of others the bytes by their
    anchor, of hot ones a row for each window by its hash (n: more of it), known as later where
    the batch shows it."""
    for b in batches:
        k, x, texts = b.column("_k").to_numpy(), b.column("_x").to_numpy(), _texts(b)
        runs = b.column("runs")
        of = np.repeat(np.arange(len(texts)), runs.value_lengths().to_numpy(zero_copy_only=False))
        s, n, ah, hot = (runs.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("s", "n", "ah", "hot"))
        cold = np.flatnonzero(~hot)
        data = [texts[i][j : j + c + DEPTH - 1] for i, j, c in zip(of[cold].tolist(), s[cold].tolist(), n[cold].tolist())]
        no = np.zeros(len(cold), bool)
        cols = (k[of[cold]], x[of[cold]], s[cold], n[cold], no, no, ah[cold])
        yield _open_batch(cols, pa.array(data, pa.binary()))
        parts = []
        for at in range(0, hot.sum(), 2048):
            r = np.flatnonzero(hot)[at : at + 2048]
            m = n[r].astype(np.int64)
            h = grams(np.frombuffer(b"".join(texts[i][j : j + c + DEPTH - 1] for i, j, c in zip(of[r].tolist(), s[r].tolist(), m.tolist())), np.uint8))
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            p = step + np.repeat(np.cumsum(m + DEPTH - 1) - (m + DEPTH - 1), m)
            w = mixed(h[p] * MIX[1] + h[p + GRAM] * MIX[2] + h[p + DEPTH - GRAM] * MIX[3])
            other = (mixed(h[p] * MIX[4] + h[p + GRAM] * MIX[0] + h[p + DEPTH - GRAM] * MIX[1]) >> U(32)).astype(np.uint32).view(np.int32)
            parts.append((np.repeat(of[r], m), np.repeat(s[r], m) + step, w, other))
        if parts:
            o, ss, w, other = (np.concatenate(c) for c in zip(*parts))
            later = _later(w, k[o], x[o], ss, other.astype(U))
            yield _open_batch((k[o], x[o], ss, other, np.ones(len(o), bool), later, w.view(np.int64)), pa.nulls(len(o), pa.binary()))


def _open_batch(cols: tuple[np.ndarray, ...], data: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), data], ["_k", "_x", "s", "n", "hot", "later", "key", "data"])


def radix_groups(lanes: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of groups whose DEPTH bytes from ``at`` on repeat within ``group``, and the groups they
    end in: most-significant digits first, a group of one leaves. ``lanes``: eight bytes from each place on."""
    member = np.arange(len(at))
    for digit in [*range(0, DEPTH - DIGIT, DIGIT), DEPTH - DIGIT]:
        value = lanes[at[member] + digit].astype(U)
        order = np.lexsort((value, group))
        member, value, group = member[order], value[order], group[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])] if len(member) else np.zeros(0, bool)
        label = np.cumsum(new) - 1
        more = np.bincount(label, minlength=1)[label] > 1 if len(member) else new
        member, group = member[more], label[more]
    return member, group


def _ordered_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by their anchor (key) the windows that are later ones, joined where they adjoin."""
    from .simhash import _whole_groups

    for b in _whole_groups(batches, ("key",)):
        k, x, s, n, key = (b.column(c).to_numpy() for c in ("_k", "_x", "s", "n", "key"))
        n = n.astype(np.int64)
        texts = b.column("data").to_pylist()
        data = np.frombuffer(b"".join(texts), np.uint8)
        start = np.cumsum(n + DEPTH - 1) - (n + DEPTH - 1)
        lanes = np.ndarray((len(data) - DIGIT + 1,), ">u8", data, strides=(1,))
        run = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        anchor = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        member, group = radix_groups(lanes, start[run] + step, anchor[run])
        r = run[member]
        found = np.sort(member[_later(group.astype(U), k[r], x[r], s[r] + step[member])])
        head = np.flatnonzero(np.r_[True, (found[1:] != found[:-1] + 1) | (run[found[1:]] != run[found[:-1]])]) if len(found) else found
        first, r = found[head], run[found[head]]
        size = np.diff(np.r_[head, len(found)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(k[r]), pa.array(x[r]), pa.array(s[r] + step[first]), pa.array(size)], ["_k", "_x", "s", "n"])


def repeated_windows(docs: DataFrame, tables: Tables) -> DataFrame:
    """(_k, _x, s, n): runs of n windows from byte s on that also start earlier."""
    arrow_limits(docs.sparkSession)
    texts = keyed(docs, F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_anchor_rows, ANCHORS)
    # Pass 1: anchors that occur more than once.
    seen = rows.where("not later").groupBy("ah").agg(
        F.min("reach").alias("r0"), F.max("reach").alias("r1"), F.min("_k").alias("k0"), F.max("_k").alias("k1")
    )
    seen = tables.write(seen.where("r0 <> r1 or k0 <> k1").select(F.col("ah").alias("key"), (F.col("r0") == F.col("r1")).alias("one"), "k0"))
    # Rows known as later get keys of their own, for a hot anchor's rows not to meet.
    key = F.when(F.col("later"), F.xxhash64("_k", "_x", "s", "ah")).otherwise(F.col("ah"))
    found = rows.withColumn("key", key).drop("ah").join(seen, "key", "left").where("later or k0 is not null")
    sure = F.col("later") | (F.col("one") & (F.col("_k") > F.col("k0")))
    found = tables.write(found.where(sure | ~F.col("one")).select("_k", "_x", "s", "n", sure.alias("sure"), F.col("key").alias("ah"), "reach"))
    # Pass 2: of an anchor with several reaches, the first occurrence of each.
    open_ = found.where("not sure").select("_k", "_x", "s", "n", "ah", "reach")
    reaches = tables.write(open_.groupBy("ah", "reach").agg(F.min("_k").alias("k0")))
    split = tables.write(open_.join(reaches, ["ah", "reach"]).select("_k", "_x", "s", "n", "ah", (F.col("_k") > F.col("k0")).alias("sure")))
    tables.drop(reaches)
    # Pass 3: the windows of these.
    left = split.where("not sure")
    hot = tables.write(left.groupBy("ah").agg(F.count("*").alias("m")).where(F.col("m") > TOGETHER).select("ah", F.lit(True).alias("hot")))
    left = left.join(hot, "ah", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    runs = left.groupBy("_k", "_x").agg(F.collect_list(F.struct("s", "n", "ah", "hot")).alias("runs"))
    rows = tables.write(texts.join(runs, ["_k", "_x"]).select("_k", "_x", "text", "runs").mapInArrow(_open_rows, OPEN))
    last = rows.where("not hot").select("_k", "_x", "s", "n", "key", "data").repartition("key").sortWithinPartitions("key")
    last = tables.write(last.mapInArrow(_ordered_rows, "_k long, _x long, s long, n int"))
    windows = rows.where("hot and not later").select("_k", "_x", "s", "n", "key")
    first = tables.write(windows.groupBy("key", "n").agg(F.min("_k").alias("k0"), F.max("_k").alias("k1")).where("k0 < k1").select("key", "n", "k0"))
    one = lambda df: df.select("_k", "_x", "s", F.lit(1).alias("n"))
    sure = found.where("sure").select("_k", "_x", "s", "n").union(split.where("sure").select("_k", "_x", "s", "n"))
    return sure.union(last).union(one(windows.join(first, ["key", "n"]).where("_k > k0"))).union(one(rows.where("hot and later")))


RESULT = "_k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_bytes(starts: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of bytes that windows from each start on cover."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], (starts + counts)[order] + DEPTH - 1
    e = np.maximum.accumulate(e)
    head = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return list(zip(s[head].tolist(), e[np.r_[head[1:] - 1, len(e) - 1]].tolist()))


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    edge = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2]))


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for k, text, runs in zip(b.column("_k").to_pylist(), _texts(b), b.column("runs")):
            spans = []
            if runs.is_valid and len(runs):
                v = runs.values
                spans = removed_bytes(v.field(0).to_numpy(), v.field(1).to_numpy().astype(np.int64))
            kept = cut_spans(text, spans)
            out.append((k, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["_k", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_runs(docs: DataFrame, tables: Tables) -> DataFrame:
    """docs by key with ``runs``, the list of its repeated windows (null: none)."""
    found = repeated_windows(docs, tables).groupBy("_k", "_x").agg(F.collect_list(F.struct("s", "n")).alias("runs"))
    return keyed(docs, F.col("text").cast("string").alias("text")).join(found, ["_k", "_x"], "left")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(documents(spark, sf_dir), Tables(spark)).mapInArrow(_digest_rows, RESULT)
    return found.select(own_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = """
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT doc_id, c, substr(h, 1024 * c + 1, 1222) AS h FROM t, LATERAL (SELECT unnest(range(0, (length(h) // 2 - 100) // 512 + 1)) AS c) WHERE length(h) >= 200),
w AS (SELECT doc_id, 512 * c + i AS i, md5(substr(h, 2 * i + 1, 200)) AS k FROM p, LATERAL (SELECT unnest(range(0, length(h) // 2 - 99)) AS i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
ends AS (SELECT doc_id, i, coalesce(i > max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM later),
runs AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM ends),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY 1, 2),
edges AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans FROM edges JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)
"""
