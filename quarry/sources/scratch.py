"""Places for intermediate tables and checkpoints that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below ``spark.checkpoint.dir``; removed when the driver ends.

    Without that setting a session of one machine uses a folder of its own; on a cluster that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="quarry-"))
        top = _LOCAL[0]
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    try:
        at, fs = file_system(spark, path)
        fs.delete(at, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in a scratch folder, read back: its lineage ends there, and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
