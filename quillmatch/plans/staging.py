"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_FOLDERS: dict[str, str] = {}
_STAGED: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset and all
    runs on this machine. On a cluster executors would not see that, so an error says what is
    missing."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _FOLDERS:
            _FOLDERS[app] = tempfile.mkdtemp(prefix="quillmatch-")
        folder = _FOLDERS[app]
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_STAGED.items()):
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def staged(df: DataFrame, at: str | None = None, by: str | None = None, **seen: Column) -> DataFrame:
    """df written as Parquet in the shared folder and read again: this cuts lineage, and the rows
    survive the loss of any executor. Removed by unstage(), or when Python ends. `seen` are
    aggregates that are made on the way, without a job of their own; the result has them in a dict,
    `seen`. `at`: where it is written instead, to stay; what was there is replaced. `by`: a column of few
    values by which files are parted, so that those of one value are read alone."""
    spark = df.sparkSession
    path = at or f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    watch = Observation() if seen else None
    rows = df.observe(watch, *(c.alias(name) for name, c in seen.items())) if watch is not None else df
    rows.write.mode("overwrite" if at else "error").option("compression", "zstd").parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    out.seen = watch.get if watch is not None else {}
    if at is None:
        _STAGED[path] = spark
    return out


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path and _STAGED.pop(path, None) is not None:
        _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and broadcasts of what is staged by now: it does so when the
    driver's JVM collects the frames that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
