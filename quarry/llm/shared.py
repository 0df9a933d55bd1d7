"""Helpers that every operator of this subpackage uses.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, which driver and executors share. Without that setting a
local folder serves a session on one machine; on a cluster it is an error, as
executors don't see each other's disks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

_LOCAL: list[str] = []
#: Tables written in the current ``passing`` block, in their order; each thread has blocks of its own.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("tables", default=None)
#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only if none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="quarry-"))
    return _LOCAL[0]


def remove(spark: SparkSession, path: str, table: str | None = None) -> None:
    try:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as a write lasts."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors. They are removed by ``drop``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.option("compression", compression).parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    return _noted(out, path, None)


def _noted(out: DataFrame, path: str, table: str | None) -> DataFrame:
    out._own_files = (path, table)
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def bucketed(df: DataFrame, name: str, n: int, key: str, moved: bool = True) -> DataFrame:
    """Write ``df`` as a table bucketed by ``key``: later joins and groups on it move no rows of it.

    With ``moved`` rows of a bucket meet in a file first; without, every task writes its own files,
    which is right where a task has few buckets.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    with setting(spark, _CLEANUP, "true"):
        (df.repartition(n, key) if moved else df).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    atexit.register(remove, spark, path, table)
    out = spark.table(table)
    return _noted(out, path, table)


@contextmanager
def passing() -> Iterator[None]:
    """Of the tables that this thread writes inside, only the last one stays; after an error none does."""
    made: list[DataFrame] = []
    token = _MADE.set(made)
    last = None
    try:
        yield
        last = made[-1] if made else None
    finally:
        _MADE.reset(token)
        drop(*[df for df in made if df is not last])


def drop(*frames: DataFrame) -> None:
    """Remove the files of ``staged`` or ``bucketed`` tables that nothing will read again."""
    for df in frames:
        remove(df.sparkSession, *df._own_files)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch, so that long texts do not fill a worker.

    The setting is read when a query runs, so it stays; a lower one of the caller's holds.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


_KEPT: dict[str, dict] = {}


def kept_in_worker(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task. That of another operator is dropped
    first: workers live as long as the session, and tables of words and models would add up."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
    return _KEPT[owner]


def widened(df: DataFrame, **added: str) -> StructType:
    """The schema of ``df`` with columns added, by name and type."""
    return StructType([*df.schema.fields, *(StructField(n, _parse_datatype_string(k)) for n, k in added.items())])


def parts(n_rows: int, each: int, least: int = 1) -> int:
    """How many parts hold ``n_rows`` at ``each`` rows a part."""
    return max(least, -(-n_rows // each))


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the decimal text of an integer column, modulo ``n`` (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
