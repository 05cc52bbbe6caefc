"""Session helpers: the shared folder and cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine gets a temporary folder, deleted at its end; on a cluster, whose
    executors would each write to a disk of their own, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="catalith-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[app] = "file://" + folder
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/catalith/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step", **measures: Column) -> DataFrame:
    """Cut the lineage with a written table in the shared folder; losing executors loses nothing.

    measures: aggregates taken while writing, found in the result's `measured`; they cost no further job.
    """
    path = fresh_path(df.sparkSession, name)
    watch = Observation() if measures else None
    (df.observe(watch, *(c.alias(k) for k, c in measures.items())) if watch else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._catalith_path = path
    out.measured = watch.get if watch else {}
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing will read again."""
    path = getattr(df, "_catalith_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
