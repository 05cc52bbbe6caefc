"""Queries of the core problems."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.hierarchy import descendants, hierarchy
from .operators.references import orphan_references
from .operators.times import TimeDictionary, asset_times
from .session import materialise
from .sources.tables import current, table


TREES = {"library": ("libraries", "parent_library_id"), "collection": ("collections", "parent_collection_id")}


def _trees(spark: SparkSession, d: str, names: bool) -> DataFrame:
    def one(tree: str) -> DataFrame:
        t, parent = TREES[tree]
        return hierarchy(current(spark, d, t, "id", parent, "name"), "id", parent, "name" if names else None).withColumn("tree", F.lit(tree))

    with ThreadPoolExecutor(len(TREES)) as pool:  # their short rounds run side by side
        out = list(pool.map(one, TREES))
    return reduce(DataFrame.unionByName, out)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d, False).select("tree", "node_id", "root_id", "node_depth", "n_below")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d, True).select("tree", "node_id", "path", "on_cycle", "back_edge_to")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    def one(tree: str) -> DataFrame:
        t, parent = TREES[tree]
        return descendants(current(spark, d, t, "id", parent), "id", parent).select(F.lit(tree).alias("tree"), "ancestor", "node")

    with ThreadPoolExecutor(len(TREES)) as pool:
        out = list(pool.map(one, TREES))
    return reduce(DataFrame.unionByName, out)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    assets = current(spark, d, "assets", "id", "capture_time", "camera_model")
    return asset_times(assets, table(spark, d, "camera_clocks")).where("instant_ms is not null").select(F.col("id").alias("asset_id"), F.col("instant_ms").alias("capture_utc_ms"))


def p2_increment(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary after two loads: what it holds per zone, and how much of it the second load had to parse."""
    clocks, dictionary = table(spark, d, "camera_clocks"), TimeDictionary(spark)
    rows = table(spark, d, "assets").join(clocks.select("camera_model", F.col("time_zone").alias("zone")), "camera_model", "left")
    dictionary.learn(rows.where("last_seen_scan <= 150"), "capture_time", "zone")
    first = dictionary.read().groupBy("zone").agg(F.count(F.lit(1)).alias("first_texts"))
    first = spark.createDataFrame(first.collect(), first.schema)  # one row per time zone
    dictionary.learn(rows, "capture_time", "zone")
    return dictionary.read().groupBy("zone").agg(F.count(F.lit(1)).alias("texts"), F.count("ms").alias("readable")).join(first, "zone", "left").select("zone", "texts", "readable", F.coalesce("first_texts", F.lit(0)).alias("first_texts"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    assets = materialise(current(spark, d, "assets", "id", "library_id", "first_seen_at"), "assets", n=n)  # read three times
    libraries = materialise(current(spark, d, "libraries", "id", "created_at"), "libraries", n=n)
    members = table(spark, d, "collection_assets")
    many = assets.measured["n"] + libraries.measured["n"]
    a = orphan_references(assets, libraries, "id", "library_id", "first_seen_at", "id", "created_at", many).withColumn("source_table", F.lit("assets"))
    b = orphan_references(members, assets, "collection_id", "asset_id", "added_at", "id", "first_seen_at", members.count() + assets.measured["n"]).withColumn("source_table", F.lit("collection_assets"))
    return a.unionByName(b)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).select("source_table", "owner_id", "missing_id", "ref_month", "ref_kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    found = _references(spark, d)
    return found.groupBy("source_table", "ref_month", "ref_kind").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("missing_id").alias("missing"), F.count_distinct("owner_id").alias("owners"))


QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "p2_found": p2_found, "p2_increment": p2_increment, "p5_found": p5_found, "p5_report": p5_report}

_NOW = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {1} DESC) AS k FROM {0} WHERE id IS NOT NULL) WHERE k = 1)"
_ASSETS, _LIBRARIES = _NOW.format("assets", "last_seen_scan"), _NOW.format("libraries", "scan_generation")
_ORPHANS = f"""SELECT DISTINCT 'assets' AS source_table, a.id AS owner_id, a.library_id AS missing_id, a.first_seen_at[:7] AS ref_month, CASE WHEN l.id IS NULL THEN 'absent' ELSE 'later' END AS ref_kind
FROM {_ASSETS} a LEFT JOIN {_LIBRARIES} l ON l.id = a.library_id WHERE a.library_id IS NOT NULL AND (l.id IS NULL OR l.created_at > a.first_seen_at)
UNION ALL SELECT DISTINCT 'collection_assets', c.collection_id, c.asset_id, c.added_at[:7], CASE WHEN a.id IS NULL THEN 'absent' ELSE 'later' END
FROM collection_assets c LEFT JOIN {_ASSETS} a ON a.id = c.asset_id WHERE c.asset_id IS NOT NULL AND (a.id IS NULL OR a.first_seen_at > c.added_at)"""

_TREE = """SELECT '{0}' AS tree, id, max(CASE WHEN p IN (SELECT id FROM {1}) THEN p END) AS p FROM (
  SELECT id, {2} AS p, row_number() OVER (PARTITION BY id ORDER BY {3} DESC NULLS LAST, {2} DESC NULLS LAST) AS k FROM {1} WHERE id IS NOT NULL) WHERE k = 1 GROUP BY id"""

_NAMED = """SELECT '{0}' AS tree, id, CASE WHEN p IN (SELECT id FROM {1}) THEN p END AS p, replace(replace(coalesce(name, ''), '\\', '\\\\'), '/', '\\/') AS step FROM (
  SELECT id, {2} AS p, name, row_number() OVER (PARTITION BY id ORDER BY {3} DESC NULLS LAST, {2} DESC NULLS LAST, name DESC NULLS LAST, display_order DESC NULLS LAST) AS k FROM {1} WHERE id IS NOT NULL) WHERE k = 1"""

ORACLES = {
    "p1_found": f"""WITH RECURSIVE n AS ({_TREE.format("library", "libraries", "parent_library_id", "scan_generation")} UNION ALL {_TREE.format("collection", "collections", "parent_collection_id", "updated_at")}),
up AS (SELECT tree, id, p AS a FROM n WHERE p IS NOT NULL UNION SELECT up.tree, up.id, n.p FROM up JOIN n ON n.tree = up.tree AND n.id = up.a WHERE n.p IS NOT NULL),
ring AS (SELECT tree, id FROM up WHERE id = a),
above AS (SELECT up.tree, up.id, count(*) AS depth, max(CASE WHEN n.p IS NULL THEN n.id END) AS root, min(CASE WHEN ring.id IS NOT NULL THEN up.a END) AS low FROM up JOIN n ON n.tree = up.tree AND n.id = up.a LEFT JOIN ring ON ring.tree = up.tree AND ring.id = up.a GROUP BY ALL),
below AS (SELECT tree, a AS id, count(*) FILTER (id <> a) AS c FROM up GROUP BY ALL)
SELECT n.tree, n.id AS node_id, coalesce(above.root, above.low, n.id) AS root_id, CAST(CASE WHEN above.low IS NOT NULL THEN -1 ELSE coalesce(above.depth, 0) END AS BIGINT) AS node_depth, CAST(coalesce(below.c, 0) AS BIGINT) AS n_below
FROM n LEFT JOIN above ON above.tree = n.tree AND above.id = n.id LEFT JOIN below ON below.tree = n.tree AND below.id = n.id""",
    "p1_paths": f"""WITH RECURSIVE n AS ({_NAMED.format("library", "libraries", "parent_library_id", "scan_generation")} UNION ALL {_NAMED.format("collection", "collections", "parent_collection_id", "updated_at")}),
down AS (SELECT tree, id, '/' || step AS path FROM n WHERE p IS NULL UNION ALL SELECT n.tree, n.id, down.path || '/' || n.step FROM down JOIN n ON n.tree = down.tree AND n.p = down.id),
up AS (SELECT tree, id, p AS a FROM n WHERE p IS NOT NULL UNION SELECT up.tree, up.id, n.p FROM up JOIN n ON n.tree = up.tree AND n.id = up.a WHERE n.p IS NOT NULL),
ring AS (SELECT tree, id, min(a) AS low FROM up GROUP BY tree, id HAVING count(*) FILTER (a = id) > 0)
SELECT n.tree, n.id AS node_id, down.path, ring.id IS NOT NULL AS on_cycle, CASE WHEN n.p = ring.low THEN n.p END AS back_edge_to
FROM n LEFT JOIN down ON down.tree = n.tree AND down.id = n.id LEFT JOIN ring ON ring.tree = n.tree AND ring.id = n.id""",
    "p1_descendants": f"""WITH RECURSIVE n AS ({_TREE.format("library", "libraries", "parent_library_id", "scan_generation")} UNION ALL {_TREE.format("collection", "collections", "parent_collection_id", "updated_at")}),
up AS (SELECT tree, id, p AS a FROM n WHERE p IS NOT NULL UNION SELECT up.tree, up.id, n.p FROM up JOIN n ON n.tree = up.tree AND n.id = up.a WHERE n.p IS NOT NULL)
SELECT tree, a AS ancestor, id AS node FROM up WHERE a <> id""",
    "p5_found": _ORPHANS,
    "p5_report": f"SELECT source_table, ref_month, ref_kind, count(*) AS refs, count(DISTINCT missing_id) AS missing, count(DISTINCT owner_id) AS owners FROM ({_ORPHANS}) GROUP BY ALL",
}
