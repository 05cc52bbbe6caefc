"""Incremental ingest: file snapshots as a stream, applied to the catalogue batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def snapshots(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Snapshot files as they appear, a bounded number of them per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def apply_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run `apply` per batch until what is there now is done; a restart resumes behind the last finished batch."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reject_stale(results: DataFrame, now: DataFrame, key: str = "asset_id", fingerprint: str = "source_fingerprint") -> DataFrame:
    """Results whose fingerprint is still that of the asset; late ones of an earlier content are dropped, so applying twice changes nothing."""
    return results.join(now.select(F.col("id").alias(key), F.col("fingerprint").alias(fingerprint)), [key, fingerprint], "left_semi")
