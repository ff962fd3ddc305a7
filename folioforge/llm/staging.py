"""Shared folder of a session, and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`.  Where the session names none, a local master gets a temporary one; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='folioforge-')}"
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch between the JVM and a Python worker.  Spark's own bound is a number of rows,
#: whatever their size, and every task holds a few batches on both sides.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to `BATCH_BYTES`, unless it has a lower bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that `fresh_path` named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder: a lost executor costs a read, not the lineage.

    Spark removes the files of frames that are gone if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint()
