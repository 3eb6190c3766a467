"""Tables written between the steps of iterative operators.

They lie in the shared folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs a re-read and not the
lineage. Only a session on ``local[...]`` without that setting gets a folder
of its own on this machine.

Operators drop what nothing reads any more. The tables that a returned
DataFrame still reads stay until ``release`` is called, or the application
ends: each application has a folder of its own and deletes it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: str | None = None
_lock = threading.Lock()
_inside: dict[int, tuple[int, str | None]] = {}
_ends: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on plain ``local`` without it, a temporary one."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="sievework-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def run_folder(spark: SparkSession) -> str:
    """Where this application stages its tables; deleted when it ends."""
    folder = f"{shared_folder(spark)}/sievework/{spark.sparkContext.applicationId}"
    with _lock:
        if folder not in _ends:
            _ends.add(folder)
            atexit.register(_at_end, spark, folder)
    return folder


def _at_end(spark: SparkSession, folder: str) -> None:
    # a session that was stopped before has no file system to ask any more
    if spark.sparkContext._jsc is not None:
        _delete(spark, folder)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has staged; DataFrames that read them can't be used any more."""
    _delete(spark, run_folder(spark))


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Inside, a finished action's shuffle files are deleted at once; the setting comes back when the last thread leaves."""
    session = id(spark)
    with _lock:
        within, before = _inside.get(session, (0, None))
        if not within:
            before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _inside[session] = (within + 1, before)
    try:
        yield
    finally:
        with _lock:
            within, before = _inside.pop(session)
            if within > 1:
                _inside[session] = (within - 1, before)
            elif before is not None:
                spark.conf.set(_CLEANUP, before)
            else:
                spark.conf.unset(_CLEANUP)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder now and return it as a scan of what was written."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffle_files_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def stage_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As ``stage``, with the number of rows, counted while they are written."""
    seen = Observation()
    out = stage(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]


def stage_summed(df: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """As ``stage_counted``, with a checksum of the rows, which are taken to be distinct, in any order."""
    seen = Observation()
    out = stage(df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("sum")), label)
    return out, seen.get["n"], seen.get["sum"]


def drop(*frames: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            _delete(df.sparkSession, path)
