"""Helpers shared by the training-data operators.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: space and the ASCII controls TAB to CR.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Stands for a null doc_id inside a plan; it sorts before every other id.
NO_ID = -(2**63)


def arrow_limits(spark: SparkSession, mb: int = 8) -> None:
    """Bound an Arrow batch by its bytes, so that long texts can't fill a worker's memory.

    The session keeps the bounds: they are read when the plan runs, which the caller decides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Where none is named, one is set on a single machine (tests); on a cluster that is an
    error, as no other node would see a folder of the driver's own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


class Tables:
    """Intermediate results as Parquet tables in the shared folder.

    A written table cuts the lineage: a lost executor costs a reread, not a
    recomputation of all that came before. ``drop`` frees a table's disk early.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.made = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        # The table replaces the shuffle files that led to it.
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(key, before)
        if self.made == 1:  # what no one drops goes when the driver ends
            with contextlib.suppress(Exception):
                root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
                root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._table_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_table_path", None)
        if path:
            jvm = self.spark._jvm
            with contextlib.suppress(Exception):  # a table that stays only costs disk
                hadoop = jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """``_k``, doc_id with null as the smallest id, and ``_x``, a hash of the text. Ids may repeat
    or be null; a document is known by both."""
    return [F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("_k"), F.xxhash64(F.lit(6), text.cast("string")).alias("_x")]


def keyed(df: DataFrame, *keep: str | Column) -> DataFrame:
    """The key of each row (doc_id, text) and the asked columns."""
    return df.select(*row_key(F.col("doc_id"), F.col("text")), *keep)


def own_id(col: str = "_k"):
    """doc_id again from ``_k``."""
    return F.when(F.col(col) != NO_ID, F.col(col)).alias("doc_id")


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed, and the new name of each: none clashes with an operator's own."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[docs[f"`{c}`"].alias(n) for c, n in names.items()]), names


def put_back(names: dict[str, str]) -> list[Column]:
    """The columns that ``set_aside`` renamed, under their own names."""
    return [F.col(n).alias(c) for c, n in names.items()]
