"""Catalogs over a growing folder of documents, by Structured Streaming.

Sums of keys merge, so a catalog is a streaming aggregation: every micro-batch reads new
files only, and the state holds one number a key.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_documents(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of Parquet documents that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def catalog(keys: DataFrame, key: str = "key", value: str | None = None) -> DataFrame:
    """(key, frequency) as a running sum of ``value``, or of ones."""
    return keys.groupBy(key).agg((F.sum(value) if value else F.count("*")).alias("frequency"))


def windowed_catalog(keys: DataFrame, time: str, width: str, late: str, key: str = "key") -> DataFrame:
    """(window, key, frequency): a catalog of each span of event time, closed once rows are
    later than the watermark."""
    return keys.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("frequency"))


def run_catalog(keys: DataFrame, name: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a catalog over what is there and stop at its end; into a table in memory, or into
    ``sink`` batch by batch."""
    out = catalog(keys).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (out.foreachBatch(sink) if sink else out.format("memory").queryName(name)).start()


def state_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where it is
    unset, a temporary one on a single machine and an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{named.rstrip('/')}/streams" if named else tempfile.mkdtemp(prefix="streams-")
