"""Catalogue tables and their current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Key, the column whose greatest value marks the current row, and what decides between different rows of one version.
VERSIONED = {"libraries": ("id", "scan_generation", ("parent_library_id", "name", "display_order")), "collections": ("id", "updated_at", ("parent_collection_id", "name", "display_order")), "assets": ("id", "last_seen_scan", ())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, version: str, *columns: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-null `key`: that with the greatest `version` (nulls least), between equals the greatest `ties`.

    row_number() = 1 becomes a window group limit that runs before the shuffle, so a key with a third of all
    rows sends one row per map task. Exact copies count once. An empty table gives an empty table.
    """
    columns = columns or tuple(df.columns)
    keep = list(dict.fromkeys([key, version, *ties, *columns]))
    order = [F.col(c).desc_nulls_last() for c in (version, *ties)]
    ranked = df.where(F.col(key).isNotNull()).select(*keep).withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_rank = 1").select(*columns)


def current(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    key, version, ties = VERSIONED[name]
    return latest(table(spark, sf_dir, name), key, version, *columns, ties=ties)


def clean_fingerprint(column: str | Column) -> Column:
    """Lower case, trimmed; null when blank."""
    x = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.when(x != "", x)
