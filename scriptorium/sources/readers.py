"""Corpora as DataFrames: folders of HTML and XHTML files, texts, token-model lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import map_rows
from ..functions.lexical import rebuild_text
from .dom import parse

SUFFIXES = (".html", ".xhtml")
#: Planned tasks over small files that one task takes.
MERGED = 16


def read_corpus(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """(path, doc_id, html) of all files below a folder whose names end in ``extension``, or in
    .html or .xhtml; hidden files are left out. doc_id is a hash of the path."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.input_file_name()
    wanted = name.endswith(extension) if extension else name.endswith(SUFFIXES[0]) | name.endswith(SUFFIXES[1])
    found = files.where(wanted).select(name.alias("path"), F.xxhash64(name).alias("doc_id"), F.col("value").alias("html"))
    # Spark plans a task for a few small files; a task here reads the files of up to MERGED of them.
    planned, cores = files.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    return found.coalesce(max(4 * cores, -(-planned // MERGED)))


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt over all cores where their files have fewer splits than there are cores, as one
    small file has; larger inputs are left as they are scanned."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def checked(docs: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """docs (path, html, ...) with ``_error`` where strict XML cannot be read (null: fine). FAILFAST
    raises instead, DROPMALFORMED drops such rows."""

    @F.pandas_udf("string")
    def error(path: pd.Series, html: pd.Series) -> pd.Series:
        out = []
        for p, h in zip(path, html):
            try:
                parse(h or "", p or "")
                out.append(None)
            except ValueError as e:
                if mode == "FAILFAST":
                    raise ValueError(f"{p}: {e}") from e
                out.append(str(e))
        return pd.Series(out, dtype=object)

    found = docs.withColumn("_error", error("path", "html"))
    return found.where("_error is null").drop("_error") if mode == "DROPMALFORMED" else found


def escaped(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def from_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Plain texts (doc_id, text) as documents of one paragraph each."""
    body = F.concat(F.lit('<html><body><div class="ltx_para">'), F.coalesce(escaped(text), F.lit("")), F.lit("</div></body></html>"))
    return docs.select("doc_id", body.alias("html"))


def from_token_lines(docs: DataFrame, lines: str = "text") -> DataFrame:
    """Normalised token lines as documents of sentences again."""
    return from_texts(docs.select("doc_id", rebuild_text(lines).alias("text")))


def token_model_lines(spark: SparkSession, path: str, containing: str | None = "citationelement") -> DataFrame:
    """(text) lines of token-model files, only those that hold a word where one is given."""
    lines = spark.read.text(path).select(F.col("value").alias("text"))
    return lines.where(F.col("text").contains(containing)) if containing else lines


def map_documents(docs: DataFrame, each, schema: str) -> DataFrame:
    """Rows from any function of a document's tree: ``each(root, doc_id)`` yields tuples."""
    return map_rows(docs.select("doc_id", "html"), lambda doc_id, html: each(parse(html or ""), doc_id), schema)
