"""Stage tables: results that a plan writes to the shared folder and reads back, so that lineage ends there."""

from __future__ import annotations

import atexit
import getpass
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNS: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where a local session has none (tests, a laptop) a local folder is used; on a cluster that is an error, because its
    executors would each write to a disk of their own.
    """
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{getpass.getuser()}"


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder path for one run of an operator. It goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    if not _RUNS:
        atexit.register(clean)
    _RUNS[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of stage tables with the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean() -> None:
    """Delete all stage tables of this process; call it before the session stops, or it happens when Python ends."""
    for path, spark in list(_RUNS.items()):
        if spark.sparkContext._jsc is not None:
            try:
                delete(spark, path)
                del _RUNS[path]
            except Exception:  # noqa: BLE001  the JVM has gone first: nothing is left to delete with
                return


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a stage's table to the shared folder and read it back: lineage ends here, and a lost executor costs one read."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
