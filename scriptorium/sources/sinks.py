"""Reports and labelled texts out of DataFrames."""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked(report: DataFrame, key: str, value: str = "frequency") -> DataFrame:
    """A report by falling frequency; equal ones by their key."""
    return report.orderBy(F.desc(value), F.asc(key))


def write_csv(report: DataFrame, path: str, key: str, value: str = "frequency") -> None:
    ranked(report, key, value).write.mode("overwrite").csv(path, header=True)


def write_pairs(report: DataFrame, path: str, key: str, value: str = "frequency", separator: str = ", ") -> None:
    """Lines of key and value, as ``word, 12`` or ``name 12``."""
    ranked(report, key, value).select(F.concat_ws(separator, key, F.col(value).cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_lines(texts: DataFrame, path: str, text: str = "text") -> None:
    texts.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_labelled(statements: DataFrame, path: str) -> None:
    """Statements (label, sha256, text) in a folder for each label, each text once."""
    statements.dropDuplicates(["label", "sha256"]).write.mode("overwrite").partitionBy("label").parquet(path)


def write_tar(statements: DataFrame, path: str, mtime: int = 0) -> int:
    """An archive of ``label/sha256.txt`` on the driver's disk, for results that one file holds:
    rows stream one partition at a time. Returns the number of files."""
    n = 0
    rows = statements.dropDuplicates(["label", "sha256"]).select("label", "sha256", "text")
    with tarfile.open(path, "w", format=tarfile.GNU_FORMAT) as tar:
        for row in rows.toLocalIterator():
            data = row.text.encode()
            info = tarfile.TarInfo(f"{row.label}/{row.sha256}.txt")
            info.size, info.mode, info.mtime = len(data), 0o644, mtime
            tar.addfile(info, io.BytesIO(data))
            n += 1
    return n


def marker_label(name: Column | str = "name", tags: Column | str = "tags") -> Column:
    """A marker's name and tags for reading: ``name {'tag', 'tag'}``."""
    name, tags = (F.col(c) if isinstance(c, str) else c for c in (name, tags))
    return F.concat(name, F.lit(" {"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("}"))


def match_sections(matches: DataFrame) -> DataFrame:
    """(doc_id, sent_seq, html): the markers of each sentence (as ``match_documents`` finds them) as a
    section for reading, nested as the markers are by their depth."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(
        F.lit('<p style="margin-left: '), F.col("depth").cast("string"), F.lit('em"><b>'), safe(marker_label()), F.lit("</b> ("), F.col("kind"), F.lit(") "), safe(F.coalesce("text", F.lit(""))), F.lit("</p>")
    )
    rows = matches.groupBy("doc_id", "sent_seq").agg(F.array_sort(F.collect_list(F.struct("match_seq", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("<section><h4>"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(": "), F.col("sent_seq").cast("string"), F.lit("</h4>"))
    return rows.select("doc_id", "sent_seq", F.concat(head, F.array_join(F.transform("lines", lambda r: r.line), ""), F.lit("</section>")).alias("html"))


def write_matches(matches: DataFrame, path: str) -> None:
    """Markers as HTML sections for reading, one a line, in order of documents and sentences."""
    match_sections(matches).orderBy("doc_id", "sent_seq").select(F.col("html").alias("value")).write.mode("overwrite").text(path)


def log_scatter(report: DataFrame, x: str, y: str) -> DataFrame:
    """(x, log2_y), the points of a frequency plot."""
    return report.select(F.col(x).alias("x"), F.log2(y).alias("log2_y"))
