"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds
one row for each (blob, rule version) that was ever scanned, with its findings; a scan
reads only pairs that the ledger lacks, one text per blob, and then findings are joined
back to all paths by content address. Copies cost a hash, not a scan. The ledger is a table in a
folder that ``scan_into`` reads and appends to: versions that were scanned in an earlier run, or
under another path, are not scanned again, and a new rule version scans everything anew.

Beside the contract's three base rules there are spans of private keys in PEM blocks (whole, or
the opening line of one that is cut off), of service tokens by their fixed beginnings and lengths, and of
signed web tokens. They add spans and change none of the base.

Nulls are empty texts. Repeated rows get the same findings each; a null doc_id stays null.
Empty texts have no spans. Extra columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, arrow_limits, documents, keyed, own_id

#: Changes with RULES: pairs of a blob and another version count as unseen.
RULE_VERSION = "3"
#: Kind, pattern, the group that is measured, its least length. Offsets are of the whole match.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a maximal run, as [0-9a-f]+ with a least length
    ("pem", re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z0-9 ]*PRIVATE KEY-----)?"), 0, 0),
    ("service", re.compile(r"(?:gh[opsru]_[A-Za-z0-9]+|github_pat_[A-Za-z0-9_]+|glpat-[A-Za-z0-9_-]+|xox[abeoprs]-[A-Za-z0-9-]+|sk_live_[A-Za-z0-9]+|AIza[A-Za-z0-9_-]+)"), 0, 24),
    ("signed", re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 40),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob binary, rule_version string, spans array<struct<kind:string,start:int,end:int>>"


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every finding in code points, by start, then kind as listed."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(RULES):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for b in batches:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(spans, pa.list_(span))], ["blob", "spans"])


def with_blobs(docs: DataFrame, *keep: str) -> DataFrame:
    """docs by ``_k`` with their content address."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return keyed(docs, *keep, text.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, tables: Tables) -> DataFrame:
    """The ledger's new rows for versions (text, blob): unseen pairs of blob and RULE_VERSION.

    Of each unseen blob the text of its smallest doc_id is shuffled and scanned; rows that
    repeat id and text are scanned once each, as one of them."""
    spark = versions.sparkSession
    arrow_limits(spark, 4)
    unseen = versions.groupBy("blob").agg(F.min("_k").alias("_k"))
    if ledger is not None:
        done = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        unseen = unseen.join(done, "blob", "left_anti")
    texts = versions.join(tables.write(unseen), ["_k", "blob"]).select("blob", "text")
    found = texts.mapInArrow(_scan_rows, "blob binary, spans array<struct<kind:string,start:int,end:int>>")
    return tables.write(found.select("blob", F.lit(RULE_VERSION).alias("rule_version"), "spans").dropDuplicates(["blob"]))


def findings(docs: DataFrame, ledger: DataFrame | None = None, tables: Tables | None = None, complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings of every path: _k, blob, spans), (the ledger with what was scanned now);
    ``complete``: the ledger lacks nothing."""
    tables = tables or Tables(docs.sparkSession)
    versions = with_blobs(docs)
    new = None if complete else scan_unseen(versions, ledger, tables)
    known = ledger if complete else new if ledger is None else ledger.unionByName(new)
    # Only blobs with findings are joined back; the others have none.
    hits = tables.write(known.where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"]))
    return versions.select("_k", "blob").join(hits, "blob", "left"), known


def scan_into(docs: DataFrame, path: str, tables: Tables | None = None) -> DataFrame:
    """findings of docs (_k, blob, spans) by the ledger in a folder that all nodes share: what it
    lacks is scanned and appended. Two runs at once may scan a blob twice; its findings are the same."""
    spark = docs.sparkSession
    tables = tables or Tables(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    before = spark.read.schema(LEDGER).parquet(path) if there else None
    scan_unseen(with_blobs(docs), before, tables).write.mode("append").parquet(path)
    # All that docs hold is known by now.
    return findings(docs, spark.read.schema(LEDGER).parquet(path), tables, complete=True)[0]


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    found = scan_into(documents(spark, sf_dir), f"{tables.root}/ledger", tables)
    spans = F.coalesce("spans", F.expr("array()").cast("array<struct<kind:string,start:int,end:int>>"))
    base = F.filter(spans, lambda s: s.kind.isin(*BASE))
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(own_id(), *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


#: The rules again, as RE2 reads them; letters of the first in either case.
SQL_RULES = (
    ("assign", """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z0-9 ]*PRIVATE KEY-----)?", 0, 0),
    ("service", "(?:gh[opsru]_[A-Za-z0-9]+|github_pat_[A-Za-z0-9_]+|glpat-[A-Za-z0-9_-]+|xox[abeoprs]-[A-Za-z0-9-]+|sk_live_[A-Za-z0-9]+|AIza[A-Za-z0-9_-]+)", 0, 24),
    ("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)


def _oracle() -> str:
    """Matches and the gaps between them give each match its place."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {group})) AS part, "
        f"unnest(regexp_split_to_array(text, '{p}')[1:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i, {least} AS least FROM d"
        for k, (kind, p, group, least) in enumerate(SQL_RULES)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{kind}" for k, kind in enumerate(BASE))
    all_spans, base = (f"string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k){only}" for only in ("", f" FILTER (WHERE k < {len(BASE)})"))
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({found}), "
        "placed AS (SELECT *, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS s FROM found WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)), "
        "kept AS (SELECT doc_id, k, kind, s, s + length(m) AS e FROM placed WHERE length(part) >= least), "
        f"l AS (SELECT doc_id, {counts}, {all_spans} AS spans, {base} AS base FROM kept GROUP BY doc_id) "
        f"SELECT d.doc_id, {', '.join(f'coalesce(n_{kind}, 0) AS n_{kind}' for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN l USING (doc_id)"
    )


ORACLE = _oracle()
