"""Rows of Python functions in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Of a batch that a worker reads its bytes and rows; of one that it makes its rows and the characters they come from.
READ_BYTES, READ_ROWS, MADE_ROWS, MADE_CHARS = 4 << 20, 10_000, 2_000, 1 << 20


def bounded(spark: SparkSession | None = None) -> None:
    """Bound an Arrow batch by its bytes, so that a worker's memory doesn't grow with the table.

    The session keeps the bounds: they are read when the plan runs, which the caller decides."""
    spark = spark or SparkSession.getActiveSession()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(READ_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(READ_ROWS))


def map_rows(docs: DataFrame, each: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (of ``schema``) that ``each`` yields for the values of a row whose last is a text."""
    shape = to_arrow_schema(StructType.fromDDL(schema))
    bounded(docs.sparkSession)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, chars = [], 0
            for values in zip(*(c.to_pylist() for c in b.columns)):
                chars += len(values[-1] or "")
                for row in each(*values):
                    rows.append(row)
                    if len(rows) >= MADE_ROWS:
                        yield batch(rows)
                        rows, chars = [], 0
                if rows and chars >= MADE_CHARS:
                    yield batch(rows)
                    rows, chars = [], 0
            if rows:
                yield batch(rows)

    return docs.mapInArrow(run, schema)
