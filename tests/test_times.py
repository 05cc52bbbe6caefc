"""Times: every layout against hand-computed instants, the edges of zones, and the dictionary's increments."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from catalith.functions.times import with_instant
from catalith.operators.times import TimeDictionary, asset_times


def ms(*parts, milli=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1000 + milli


CASES = [
    ("2013-10-09T07:29:20", None, ms(2013, 10, 9, 7, 29, 20), False),
    ("2013-10-09T07:29:20", "Asia/Tokyo", ms(2013, 10, 8, 22, 29, 20), False),
    ("2014:01:12 23:59:04", "Europe/Berlin", ms(2014, 1, 12, 22, 59, 4), False),
    ("2013-06-25T23:27:49.2729Z", "Asia/Tokyo", ms(2013, 6, 25, 23, 27, 49, milli=272), True),
    ("2013-02-14 11:18:01.5", None, ms(2013, 2, 14, 11, 18, 1, milli=500), False),
    ("2013-11-03 21:49:47,690900417+02:00", None, ms(2013, 11, 3, 19, 49, 47, milli=690), True),
    ("2013-10-11T17:08:45.797376-0330", None, ms(2013, 10, 11, 20, 38, 45, milli=797), True),
    ("17.05.2012 10:24", "UTC", ms(2012, 5, 17, 10, 24), False),
    ("8/22/2013 12:05:19 AM", None, ms(2013, 8, 22, 0, 5, 19), False),
    ("8/22/2013 12:05:19 PM", None, ms(2013, 8, 22, 12, 5, 19), False),
    ("2010年04月02日 07时41分55秒", None, ms(2010, 4, 2, 7, 41, 55), False),
    ("20140309T095523Z", None, ms(2014, 3, 9, 9, 55, 23), True),
    ("Sun, 19 Dec 2010 13:54:57 +0100", None, ms(2010, 12, 19, 12, 54, 57), True),
    ("2009-12-09 16:49:20 PST", None, ms(2009, 12, 10, 0, 49, 20), True),
    ("2015-07-07 13:48:38 Asia/Kathmandu", "UTC", ms(2015, 7, 7, 8, 3, 38), True),
    ("2014-07-25T20:47:40[America/New_York]", "UTC", ms(2014, 7, 26, 0, 47, 40), True),
    ("1280986297", None, 1280986297000, True),
    ("1344789172214", "Asia/Tokyo", 1344789172214, True),
    ("2013-06-09", "Asia/Tokyo", ms(2013, 6, 8, 15), False),
    (" \t2013-03-01t12:21:37z\n", None, ms(2013, 3, 1, 12, 21, 37), True),
    (" " * 70 + "2020-01-02 03:04:05" + " " * 5000, None, ms(2020, 1, 2, 3, 4, 5), False),
    ("2020-01-02 03:04:05." + "1" * 200 + "Z", None, ms(2020, 1, 2, 3, 4, 5, milli=111), True),
    ("2020-01-02" + " " * 200_000 + "x", None, None, None),
    ("2016-05-24T24:00:00", None, ms(2016, 5, 25), False),
    # An hour that occurs twice is the first; a skipped one keeps the offset before the change.
    ("2014-10-26 02:30:00", "Europe/Berlin", ms(2014, 10, 26, 0, 30), False),
    ("2014-03-30 02:30:00", "Europe/Berlin", ms(2014, 3, 30, 1, 30), False),
    *[(x, None, None, None) for x in ("", "-", "n/a", "unknown", "    :  :     :  :  ", "2020-06-31 25:61:00", "2021:13:05 08:11:09", "2019-02-30T10:00:00", "0000:00:00 00:00:00", "13/13/2013 1:00:00 PM", "8/22/2013 13:05:19 PM", "2013-01-01T24:00:01", "2013-01-01 10:00:00 XQZ", "2013-01-01 10:00:00 Mars/Base", None, "x" * 10_000)],
]


def test_every_layout(spark):
    rows = [(i, t, z) for i, (t, z, _, _) in enumerate(CASES)]
    got = {r.i: (r.ms, r.own_zone) for r in with_instant(spark.createDataFrame(rows, "i INT, t STRING, z STRING"), "t", "z").collect()}
    assert got == {i: (m, o) for i, (_, _, m, o) in enumerate(CASES)}


def test_dictionary_learns_only_what_is_new(spark):
    d = TimeDictionary(spark)
    first = spark.createDataFrame([("2013-06-09", "UTC"), ("2013-06-09", "UTC"), (None, None), ("bad", None)], "t STRING, z STRING")
    d.learn(first, "t", "z")
    d.learn(first.union(spark.createDataFrame([("1280986297", None)], "t STRING, z STRING")), "t", "z")
    held = d.read()
    assert held.count() == 3 and held.where("ms is null").count() == 1
    assert d.join(first, "t", "z").where("instant_ms is not null").count() == 2
    # A retried or concurrent load that appends what is there already changes no answer; sources are kept apart.
    d.read().unionByName(d.read()).write.mode("overwrite").parquet(d.path + "-twice")
    twice = TimeDictionary(spark, d.path + "-twice")
    assert twice.read().count() == 6 and twice.join(first, "t", "z").count() == 4
    d.learn(first, "t", "z", "scanner")
    assert d.read().groupBy("source").count().collect() and {r.source for r in d.read().collect()} == {"-", "scanner"}
    d.drop()
    assert d.read() is None


def test_assets_with_nulls_clashes_and_no_rows(spark):
    schema = "id BIGINT, capture_time STRING, camera_model STRING, instant_ms STRING, zone STRING"
    rows = spark.createDataFrame([(1, "2013-10-09T07:29:20", "A", "old", "x"), (2, "2013-10-09T07:29:20", None, "old", "x"), (3, None, "A", None, None)], schema)
    clocks = spark.createDataFrame([("A", "X", "Asia/Tokyo"), ("A", "X", "Asia/Tokyo"), (None, None, "UTC")], "camera_model STRING, camera_make STRING, time_zone STRING")
    got = {r.id: r.instant_ms for r in asset_times(rows, clocks).collect()}
    assert got == {1: ms(2013, 10, 8, 22, 29, 20), 2: ms(2013, 10, 9, 7, 29, 20), 3: None}
    assert asset_times(rows.limit(0), clocks).count() == 0


@pytest.mark.parametrize("hot", [3000])
def test_one_text_may_hold_most_rows(spark, hot):
    rows = spark.range(hot).select(F.col("id"), F.lit("1280986297").alias("capture_time"), F.lit(None).cast("string").alias("camera_model"))
    clocks = spark.createDataFrame([], "camera_model STRING, camera_make STRING, time_zone STRING")
    assert asset_times(rows, clocks).where("instant_ms = 1280986297000").count() == hot
