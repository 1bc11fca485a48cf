"""What several operators need: the shared folder and tables written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the session names in ``spark.checkpoint.dir``.  Where that is
    unset, a new temporary folder is set if all runs on one machine; on a
    cluster that is an error, as executors do not see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_llm_shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark._llm_shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20
_DEFAULTS = ("64MB", "64m", str(64 << 20), f"{64 << 20}b")


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches between executors and their Python workers by bytes, for the session.

    Texts are long: at the default of 64 MB the buffers on both sides of every
    running task take a good part of an executor's memory.  Results are lazy, so
    the setting cannot be taken back when an operator returns; one that the
    session has of its own stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, *_DEFAULTS):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def discard(table: DataFrame) -> None:
    """Removes a table that ``written`` made, once all that is made from it has been written, too."""
    _delete(table.sparkSession, table._llm_path)
    _made.remove(table._llm_path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are made within, once what is read from them has been written elsewhere."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            _delete(spark, path)
        del _made[before:]


def splittable(df: DataFrame, name: str) -> DataFrame:
    """One row per key, written: joined with rows of frequent keys, it lets Spark split these.

    Adaptive execution splits a join's partitions only if plain shuffles lie on
    either side; an aggregate that feeds the join directly prevents that.
    """
    return written(df, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, so that its lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out
