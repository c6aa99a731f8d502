"""Line dedup by winnowing over line hashes.

The units are a document's lines that are not blank, compared without the white space at
their ends. Of each window of RUN lines the line with the smallest hash is its fingerprint
(the first of equal ones), so any repeated run of RUN lines is sure to share one.
Fingerprints at positions of more than one document are joined; around them matches are
extended both ways window by window, as far as whole windows agree, and every line of a
window that also starts earlier (smaller doc_id, or same document, earlier start) is
deleted. Fewer than RUN lines count as a run too if they have LONG_WORDS words together, or
if they are a whole document (which repeats only other whole documents). What stays is exactly
the text without its later repeated runs; blank lines stay.

Hot lines: what repeats within an Arrow batch is combined there, counts are combined before
they are shuffled, and joins are on written tables, so adaptive execution can split a key.

Null texts stay null; empty texts stay empty. A document is known by doc_id and text: repeated
rows keep what a single row would keep, and rows of one id (or none) with different texts are
held against smaller ids and themselves, not against each other. A null doc_id counts as the
smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, arrow_limits, documents, keyed, put_back, row_key, set_aside
from .suffix import MIX, U, _later, mixed

RUN = 3
#: Words of a run of fewer lines.
LONG_WORDS = 20
FINGERPRINTS = "_k long, _x long, s int, f long, w array<long>, later array<boolean>"


def line_hashes(text: bytes) -> np.ndarray:
    """Of each line that is not blank."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(x, 7) for x in map(bytes.strip, text.split(b"\n")) if x], U)


def windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of RUN lines its fingerprint's place and its hash."""
    n = len(h) - RUN + 1
    view = np.lib.stride_tricks.sliding_window_view(h, RUN)
    w = np.zeros(n, U)
    for k in range(RUN):
        w = mixed(w * MIX[0] + view[:, k])
    return np.arange(n) + view.argmin(1), w


def _documents(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes | None]]:
    return zip(b.column("_k").to_pylist(), b.column("_x").to_pylist(), b.column("text").cast(pa.binary()).to_pylist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of windows that share a fingerprint. A window that repeats within
    the batch is known as later but for its first occurrence."""
    for b in batches:
        ks, xs, ss, fs, ws, ns = [], [], [], [], [], []
        for k, x, t in _documents(b):
            h = line_hashes(t) if t else ()
            if len(h) < RUN:
                continue
            place, w = windows(h)
            head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            ks.append(np.full(len(head), k, np.int64))
            xs.append(np.full(len(head), x, np.int64))
            ss.append(head)
            fs.append(h[place[head]])
            ws.append(w)
            ns.append(np.diff(np.r_[head, len(w)]))
        if not ks:
            continue
        k, x, s, f, w, n = map(np.concatenate, (ks, xs, ss, fs, ws, ns))
        start = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        later = _later(w, np.repeat(k, n), np.repeat(x, n), start, np.repeat(f, n))
        at = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(k), pa.array(x), pa.array(s.astype(np.int32)), pa.array(f.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(w.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(later))],
            ["_k", "_x", "s", "f", "w", "later"],
        )


def repeated_runs(docs: DataFrame, tables: Tables) -> DataFrame:
    """(_k, _x, s): the starts of a document's windows that also start earlier."""
    arrow_limits(docs.sparkSession)
    rows = tables.write(keyed(docs, F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, FINGERPRINTS))
    shared = tables.write(rows.groupBy("f").agg(F.min("_k").alias("k0"), F.max("_k").alias("k1")).where("k0 < k1").select("f"))
    each = rows.withColumn("x", F.arrays_zip("w", "later"))
    known = each.select("_k", "_x", "s", F.posexplode("x").alias("i", "x")).where("x.later").select("_k", "_x", (F.col("s") + F.col("i")).alias("s"))
    open_ = tables.write(
        each.join(shared, "f").select("_k", "_x", "s", "f", F.posexplode("x").alias("i", "x")).where("not x.later")
        .select("_k", "_x", (F.col("s") + F.col("i")).alias("s"), "f", F.col("x.w").alias("w"))
    )
    first = tables.write(open_.groupBy("f", "w").agg(F.min("_k").alias("k0"), F.max("_k").alias("k1")).where("k0 < k1").select("f", "w", "k0"))
    later = open_.join(first, ["f", "w"]).where("_k > k0").select("_k", "_x", "s")
    return tables.write(known.union(later))


def _short_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of fewer than RUN lines that counts by its words or as a whole document.
    What repeats within the batch is known as later but for its first occurrence."""
    for b in batches:
        rows = []
        for k, x, t in _documents(b):
            h = line_hashes(t) if t else ()
            if not len(h):
                continue
            n = np.array([len(line.split()) for line in t.split(b"\n") if line.strip()])
            for m in range(1, min(RUN - 1, len(h)) + 1):
                words, w = np.zeros(len(h) - m + 1, np.int64), np.full(len(h) - m + 1, U(m))
                for j in range(m):
                    words += n[j : len(n) - m + 1 + j]
                    w = mixed(w * MIX[0] + h[j : len(h) - m + 1 + j])
                long = np.flatnonzero(words >= LONG_WORDS)
                rows += [(k, x, s, m, v) for s, v in zip(long.tolist(), w[long].view(np.int64).tolist())]
                if m == len(h) and words[0] < LONG_WORDS:
                    rows.append((k, x, 0, m, int(mixed(w + MIX[1]).view(np.int64)[0])))
        k, x, s, m, w = np.array(rows, np.int64).reshape(-1, 5).T
        later = _later(w.view(U) if len(w) else w, k, x, s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k), pa.array(x), pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(later), pa.array(w)], ["_k", "_x", "s", "m", "later", "w"]
        )


def repeated_short_runs(docs: DataFrame, tables: Tables) -> DataFrame:
    """(_k, _x, s, m): runs of m < RUN lines that also start earlier."""
    arrow_limits(docs.sparkSession)
    rows = tables.write(keyed(docs, F.col("text").cast("string").alias("text")).mapInArrow(_short_runs, "_k long, _x long, s int, m int, later boolean, w long"))
    open_ = rows.where("not later")
    first = tables.write(open_.groupBy("w").agg(F.min("_k").alias("k0"), F.max("_k").alias("k1")).where("k0 < k1").select("w", "k0"))
    found = open_.join(first, "w").where("_k > k0").select("_k", "_x", "s", "m")
    return rows.where("later").select("_k", "_x", "s", "m").union(found)


def _kept(text: str | None, starts) -> tuple[str | None, int, int]:
    """The text without the lines of these windows (start << 2 | lines), its lines and those removed."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    own = [i for i, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
    if starts is None or not len(starts):
        return text, len(own), 0
    gone = np.zeros(len(own) + 1, np.int64)
    starts = np.asarray(starts)
    np.add.at(gone, starts >> 2, 1)
    np.add.at(gone, (starts >> 2) + (starts & 3), -1)
    gone = np.cumsum(gone)[:-1] > 0
    drop = {i for i, g in zip(own, gone) if g}
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(own), len(drop)


def _kept_rows(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_kept(t, s) for t, s in zip(text, starts)], columns=["text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """docs with ``text`` deduped and counts n_lines and n_removed added, which replace columns
    of these names."""
    tables = tables or Tables(docs.sparkSession)
    runs = repeated_runs(docs, tables).withColumn("m", F.lit(RUN)).union(repeated_short_runs(docs, tables))
    runs = tables.write(runs.groupBy("_k", "_x").agg(F.collect_list(F.shiftleft("s", 2).bitwiseOR(F.col("m"))).alias("starts")))
    cut = F.pandas_udf(_kept_rows, "text string, n_lines long, n_removed long")
    plain, names = set_aside(docs.drop("n_lines", "n_removed"))
    plain = plain.select("*", *row_key(F.col(names["doc_id"]), F.col(names["text"])))
    # The same plan at every size: the runs grow with the documents.
    joined = plain.join(runs.hint("merge"), ["_k", "_x"], "left")
    out = joined.withColumn("new", cut(F.col(names["text"]).cast("string"), F.col("starts")))
    return out.select(*put_back(names | {"text": "new.text"}), "new.n_lines", "new.n_removed")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every document."""
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line, trim(string_split(text, chr(10))[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS x
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)
), own AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, count(*) OVER (PARTITION BY doc_id) AS n,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
  FROM lines WHERE x <> ''
), wins AS (
  SELECT doc_id, p, n, words AS w1, words + lead(words, 1) OVER w AS w2, x AS x1, x || chr(10) || lead(x, 1) OVER w AS x2,
    x || chr(10) || lead(x, 1) OVER w || chr(10) || lead(x, 2) OVER w AS x3
  FROM own WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), runs AS (
  SELECT doc_id, p, 3 AS m, false AS whole, x3 AS run FROM wins WHERE x3 IS NOT NULL
  UNION ALL SELECT doc_id, p, 2, false, x2 FROM wins WHERE w2 >= 20
  UNION ALL SELECT doc_id, p, 1, false, x1 FROM wins WHERE w1 >= 20
  UNION ALL SELECT doc_id, p, 2, true, x2 FROM wins WHERE p = 1 AND n = 2 AND w2 < 20
  UNION ALL SELECT doc_id, p, 1, true, x1 FROM wins WHERE p = 1 AND n = 1 AND w1 < 20
), ranked AS (
  SELECT doc_id, p, m, row_number() OVER (PARTITION BY m, whole, run ORDER BY doc_id, p) AS r FROM runs
), gone AS (
  SELECT DISTINCT doc_id, p + d AS p FROM ranked, (VALUES (0), (1), (2)) AS t(d) WHERE r > 1 AND d < m
), marked AS (
  SELECT l.doc_id, l.i, l.line, o.p, g.p AS gone
  FROM lines l LEFT JOIN own o ON l.doc_id = o.doc_id AND l.i = o.i LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.p = g.p
)
SELECT d.doc_id, count(p) AS n_lines, count(gone) AS n_removed,
  CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL), '') END AS text
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without their later repeated runs of lines; n_chars follows the text. Null texts stay
    null and empty ones empty; of equal runs the one of the smallest doc_id (null first) stays,
    repeated rows keep the same, an empty table stays empty, other columns are as they came."""
    plain, names = set_aside(docs)
    own = {names["doc_id"]: "doc_id", names["text"]: "text"}
    out = dedup_lines(plain.withColumnsRenamed(own))
    size = {"n_chars": F.length("text").cast("long").alias("n_chars")}
    return out.select(*[size.get(c, F.col(own.get(n, n)).alias(c)) for c, n in names.items()])
