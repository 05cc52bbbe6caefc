"""Normalising free-form times through a dictionary of distinct texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import with_instant
from ..session import fresh_path

DICTIONARY = "raw STRING, zone STRING, source STRING, ms BIGINT, own_zone BOOLEAN"


class TimeDictionary:
    """Distinct (text, zone, source) triples with the instant each one names, kept in a written table.

    A text is parsed once in the life of the table: :meth:`learn` adds only triples that are not there yet, so a later
    batch parses what is new. Unreadable texts stay in the table with a null instant and are not tried again.
    Null texts are never stored. The table lies at `path`, else where spark.catalith.times names a lasting table, else
    in the shared folder for this instance alone (see :meth:`drop`). Loads that run twice or side by side only repeat
    triples, which count once.
    """

    def __init__(self, spark, path: str | None = None):
        lasting = spark.conf.get("spark.catalith.times", None)
        self.spark, self.path, self.fresh = spark, path or lasting or fresh_path(spark, "times"), not (path or lasting)

    def read(self) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(DICTIONARY).parquet(self.path) if there else None

    def drop(self) -> None:
        """Delete the table; a lasting one is kept by its owner, see :attr:`fresh`."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def learn(self, rows: DataFrame, text: str, zone: str, source: str = "-") -> TimeDictionary:
        """Add the triples of `rows` (zone: a column of IANA names, null for UTC)."""
        found = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("raw"), F.coalesce(F.col(zone), F.lit("UTC")).alias("zone"), F.lit(source).alias("source")).distinct()
        known = self.read()
        if known is not None:
            found = found.join(known.select("raw", "zone", "source"), ["raw", "zone", "source"], "left_anti")
        done = with_instant(found, "raw", "zone").select("raw", "zone", "source", "ms", "own_zone")
        done.write.mode("append").parquet(self.path)
        return self

    def join(self, rows: DataFrame, text: str, zone: str, source: str = "-") -> DataFrame:
        """`rows` with instant_ms and own_zone; rows with null or unreadable texts keep nulls.

        Readable texts are joined by the text; AQE splits a text that holds a large part of all rows. The lookup side
        has one row per key, so the join never grows. Clashing columns of `rows` keep their names: the two new
        columns replace columns of the same name.
        """
        known = self.read().where((F.col("source") == source) & F.col("ms").isNotNull())
        # Grouped by the keys of the join, so merging repeated triples costs no shuffle of its own.
        lookup = known.groupBy(F.col("raw").alias("_raw"), F.col("zone").alias("_zone")).agg(F.max("ms").alias("_ms"), F.max("own_zone").alias("_own"))
        left = rows.drop("instant_ms", "own_zone")
        # Nulls would all meet in one task: they are given a spread of keys that no text has.
        key = F.coalesce(F.col(text), F.concat(F.lit("\u0000"), F.pmod(F.hash(*[F.col(c) for c in left.columns]), F.lit(997)).cast("string")))
        left = left.withColumn("_k", key).withColumn("_z", F.coalesce(F.col(zone), F.lit("UTC")))
        joined = left.join(lookup, (F.col("_k") == F.col("_raw")) & (F.col("_z") == F.col("_zone")), "left")
        return joined.withColumns({"instant_ms": F.col("_ms"), "own_zone": F.col("_own")}).drop("_k", "_z", "_raw", "_zone", "_ms", "_own")


def normalise_times(rows: DataFrame, text: str, zone: str, dictionary: TimeDictionary | None = None, source: str = "-") -> DataFrame:
    """`rows` with instant_ms (UTC epoch milliseconds) and own_zone (the text names its zone or is Unix time).

    Learns the texts of `rows`, then joins. An empty table gives an empty table with both columns.
    """
    d = dictionary or TimeDictionary(rows.sparkSession)
    return d.learn(rows, text, zone, source).join(rows, text, zone, source)


def asset_times(assets: DataFrame, clocks: DataFrame, dictionary: TimeDictionary | None = None) -> DataFrame:
    """Assets (capture_time, camera_model) with instant_ms and own_zone. Clocks: one row per camera model, a few dozen at most.

    Repeated or conflicting clock rows of a model count once (the least zone name); the table is broadcast only as
    AQE measures it small.
    """
    zones = clocks.where(F.col("camera_model").isNotNull()).groupBy("camera_model").agg(F.min("time_zone").alias("_clock"))
    rows = assets.join(zones, "camera_model", "left")
    return normalise_times(rows, "capture_time", "_clock", dictionary, "assets.capture_time").drop("_clock")
