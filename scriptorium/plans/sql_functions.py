"""The engine's tables and functions for Spark SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.segment import SPANS, sentence_spans
from ..functions.tagger import tag
from ..operators.dnm import LATEXML, flatten
from ..operators.select import paragraphs
from ..sources.dom import parse

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def register_tables(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> None:
    """Parquet tables of a folder as views of their names."""
    for t in tables:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)


def tokenize_html(html: str | None) -> str:
    """The words of a document's paragraphs, a sentence a line; the plain counterpart of
    ``programs.document_text`` for callers outside DataFrames."""
    out = []
    for p in paragraphs(parse(html or "")):
        text = flatten(p, LATEXML).plaintext
        for a, b in sentence_spans(text):
            out.append(" ".join(w.lower() for w, _, _, _ in tag(text[a:b]) if w[0].isalnum()))
    return "\n".join(out)


def register_functions(spark: SparkSession) -> None:
    """sentence_spans(text), word_tokenize(html) and flat_text(html) for SQL."""

    def spans(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"start": a, "end": b} for a, b in sentence_spans(t)])

    def tokens(html: pd.Series) -> pd.Series:
        return html.map(tokenize_html)

    def flat(html: pd.Series) -> pd.Series:
        return html.map(lambda h: flatten(parse(h or ""), LATEXML).plaintext)

    spark.udf.register("sentence_spans", F.pandas_udf(spans, SPANS))
    spark.udf.register("word_tokenize", F.pandas_udf(tokens, "string"))
    spark.udf.register("flat_text", F.pandas_udf(flat, "string"))
