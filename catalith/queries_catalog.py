"""Queries of the catalogue: sources, filters, scopes, joins, aggregates, ranks, pages and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import classify
from .operators.hierarchy import closure, reach, subtree_sums
from .operators.ranking import nearest_rank, numbered, running
from .plans import query as Q
from .plans.catalog import CANONICAL, LABELS, Catalog, with_tables
from .plans.query import AssetFilter, AssetQuery
from .registry import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def count_rows() -> Column:
    return F.count(F.lit(1))



_CANON = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CANONICAL.items()) + " ELSE {0} END"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The resolved view, rebuilt for the check.
_RESOLVED = f""", evidence AS (SELECT l.asset_id, {_CANON.format("l.label")} AS label, l.similarity, l.is_primary FROM labels l JOIN now_assets a ON a.id = l.asset_id AND a.fingerprint = l.source_fingerprint WHERE l.model_version = '2.1'),
ev AS (SELECT asset_id, min({{s: -similarity, l: label}}) FILTER (is_primary) AS p, list(label ORDER BY -similarity, label) FILTER (NOT is_primary) AS auto_tags FROM evidence GROUP BY asset_id),
man AS (SELECT asset_id, max(value) FILTER (field = 'primary_category') AS mp, max(value) FILTER (field = 'tone') AS mt, max(value) FILTER (field = 'saturation') AS ms, max(value) FILTER (field = 'color') AS mc FROM overrides GROUP BY asset_id),
tg AS (SELECT asset_id, coalesce(list(DISTINCT tag_id) FILTER (state = 'add'), []) AS adds, coalesce(list(DISTINCT tag_id) FILTER (state = 'remove'), []) AS removes FROM tag_overrides GROUP BY asset_id),
pal AS (SELECT asset_id, palette, histogram FROM palettes),
res0 AS (SELECT a.*, a.id AS asset_id, t.brightness, t.tone_label, c.saturation, c.saturation_label, c.category, pal.palette, pal.histogram, mc AS manual_color,
  coalesce(ev.p.l, CASE WHEN a.semantic_status = 'completed' THEN 'photo_abstract' END) AS auto_primary, coalesce(ev.auto_tags, []) AS auto_tags, mp, mt, ms, coalesce(tg.adds, []) AS adds, coalesce(tg.removes, []) AS removes
  FROM now_assets a LEFT JOIN tone t ON t.asset_id = a.id LEFT JOIN colour c ON c.asset_id = a.id LEFT JOIN pal ON pal.asset_id = a.id LEFT JOIN ev ON ev.asset_id = a.id LEFT JOIN man ON man.asset_id = a.id LEFT JOIN tg ON tg.asset_id = a.id),
res AS (SELECT *, coalesce(mp, auto_primary) AS effective_primary, coalesce(mt, tone_label) AS effective_tone, coalesce(ms, saturation_label) AS effective_saturation_level,
  list_filter(auto_tags, lambda x: NOT list_contains(removes, x)) || list_filter(adds, lambda x: NOT list_contains(auto_tags, x)) AS effective_tags FROM res0)
"""
_ALL = ("now_assets", "tone", "colour", "labels", "overrides", "tag_overrides", "palettes")


def _res(where: str = "true", columns: str = "asset_id, file_name") -> str:
    return with_tables("", *_ALL).rstrip() + _RESOLVED + f"SELECT {columns} FROM res WHERE {where}"


def _filtered(c: Catalog, **f) -> DataFrame:
    return Q.select(c, AssetQuery(filter=AssetFilter(**f)), "asset_id", "file_name").select("asset_id", "file_name")


# ---- A: scans, sources, sinks


@query("a02_formats", "SELECT lower(extension) AS extension, lower(extension) IN ('jpg', 'jpeg', 'png', 'webp') AS supported, count(*) AS files FROM assets GROUP BY ALL")
def a02(c: Catalog) -> DataFrame:
    return c.raw("assets").groupBy(F.lower("extension").alias("extension")).agg(count_rows().alias("files")).withColumn("supported", F.col("extension").isin("jpg", "jpeg", "png", "webp"))


@query("a03_source_roots", "SELECT DISTINCT library_id, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS directory, CAST(len(string_split(relative_path, '/')) - 1 AS INTEGER) AS depth FROM assets WHERE relative_path IS NOT NULL")
def a03(c: Catalog) -> DataFrame:
    """Image-bearing directories with their depth."""
    d = T.parent_path("relative_path")
    return c.raw("assets").where("relative_path is not null").select("library_id", d.alias("directory"), T.path_depth(d).alias("depth")).distinct()


@query("a04_snapshot", "SELECT DISTINCT absolute_path, relative_path, regexp_extract(relative_path, '([^/]*)$', 1) AS name, lower(regexp_extract(relative_path, '\\.([^./]+)$', 1)) AS ext, file_size, modified_at FROM assets")
def a04(c: Catalog) -> DataFrame:
    p = F.col("relative_path")
    return c.raw("assets").select("absolute_path", "relative_path", F.regexp_extract(p, r"([^/]*)$", 1).alias("name"), F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1)).alias("ext"), "file_size", "modified_at").distinct()


@query("a06_fallback_fingerprint", "SELECT id, sha256('unreadable' || chr(0) || absolute_path || chr(0) || coalesce(CAST(file_size AS VARCHAR), '') || chr(0) || coalesce(CAST(modified_at AS VARCHAR), '')) AS fallback FROM (SELECT DISTINCT id, absolute_path, file_size, modified_at FROM assets WHERE scan_status = 'failed')")
def a06(c: Catalog) -> DataFrame:
    failed = c.raw("assets").where("scan_status = 'failed'").select("id", "absolute_path", "file_size", "modified_at").distinct()
    text = F.concat_ws("\u0000", F.lit("unreadable"), "absolute_path", F.coalesce(F.col("file_size").cast("string"), F.lit("")), F.coalesce(F.col("modified_at").cast("string"), F.lit("")))
    return failed.select("id", F.sha2(text, 256).alias("fallback"))


@query("a11_embedding_scan", with_tables("SELECT DISTINCT s.asset_id, len(s.embedding) AS dimensions, s.embedding IS NOT NULL AND len(s.embedding) = 64 AS decodable FROM semantic_outputs s JOIN now_assets a ON a.id = s.asset_id AND a.fingerprint = s.source_fingerprint WHERE s.model_version = '2.1'", "now_assets"))
def a11(c: Catalog) -> DataFrame:
    """Current embeddings, decodable or not."""
    return embedding_scan(c)


def embedding_scan(c: Catalog, most: int | None = None) -> DataFrame:
    """Current embeddings; with `most` the first so many by id, taken before undecodable rows are rejected, as an interactive search does."""
    now = c.now_assets.select(F.col("id").alias("asset_id"), F.col("fingerprint").alias("source_fingerprint"))
    s = c.raw("semantic_outputs").where("model_version = '2.1'").join(now, ["asset_id", "source_fingerprint"])
    s = s.select("asset_id", F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("bigint")).alias("dimensions"), F.coalesce(F.size("embedding") == 64, F.lit(False)).alias("decodable")).distinct()
    return s if most is None else s.orderBy("asset_id", F.col("dimensions").asc_nulls_last()).limit(most)


@query("a13_csv_lines", """SELECT id, concat_ws(',', CAST(id AS VARCHAR), CASE WHEN regexp_matches(coalesce(name, ''), '[,"\\n\\r]') THEN '"' || replace(coalesce(name, ''), '"', '""') || '"' ELSE coalesce(name, '') END, CASE WHEN regexp_matches(coalesce(source_path, ''), '[,"\\n\\r]') THEN '"' || replace(source_path, '"', '""') || '"' ELSE coalesce(source_path, '') END) AS line FROM (SELECT DISTINCT id, name, source_path FROM libraries)""")
def a13(c: Catalog) -> DataFrame:
    rows = c.raw("libraries").select("id", "name", "source_path").distinct()
    return rows.select("id", F.concat_ws(",", F.col("id").cast("string"), T.csv_field("name"), T.csv_field("source_path")).alias("line"))


@query("a16_detail", with_tables("SELECT id, file_name, file_size, camera_model, rating FROM now_assets WHERE id IN (SELECT max(asset_id) FROM members WHERE collection_id = 1)", "now_assets", "members"))
def a16(c: Catalog) -> DataFrame:
    """Point lookup: the asset of the greatest id among the favourites."""
    last = c.members.where("collection_id = 1").agg(F.max("asset_id").alias("id"))
    return c.now_assets.join(F.broadcast(last), "id", "left_semi").select("id", "file_name", "file_size", "camera_model", "rating")


# ---- B: projections and filters


@query("b01_wide", _res(columns="asset_id, library_id, file_name, file_size, width, height, capture_time, camera_model, rating, color_label, brightness, saturation, effective_primary, effective_tone, effective_saturation_level, list_aggregate(list_sort(list_transform(effective_tags, lambda x: lower(x))), 'string_agg', '|') AS tags"))
def b01(c: Catalog) -> DataFrame:
    x = classify.resolved(c)
    return x.select(
        "asset_id", "library_id", "file_name", "file_size", "width", "height", "capture_time", "camera_model", "rating", "color_label", "brightness", "saturation", "effective_primary", "effective_tone", "effective_saturation_level",
        F.when(F.size("effective_tags") > 0, F.array_join(F.array_sort(F.transform("effective_tags", lambda t: F.lower(t))), "|")).alias("tags"),
    )


@query("b02_grid", with_tables("SELECT id, library_id, file_name, width, height, rating, is_favorite FROM now_assets", "now_assets"))
def b02(c: Catalog) -> DataFrame:
    return c.now_assets.select("id", "library_id", "file_name", "width", "height", "rating", "is_favorite")


@query("b03_exists_flag", with_tables("SELECT id, EXISTS (SELECT 1 FROM semantic_outputs s WHERE s.asset_id = a.id) AS has_embedding FROM now_assets a", "now_assets"))
def b03(c: Catalog) -> DataFrame:
    have = c.raw("semantic_outputs").where("asset_id is not null").select(F.col("asset_id").alias("id"), F.lit(True).alias("f")).distinct()
    return c.now_assets.select("id").join(have, "id", "left").select("id", F.coalesce("f", F.lit(False)).alias("has_embedding"))


@query("b04_conjunction", _res("rating >= 3 AND brightness >= 0.3 AND effective_tone IN ('mid_tone', 'high_key') AND color_label IS NOT NULL AND contains(" + _LOWER.format("file_name") + ", 'jpg')"))
def b04(c: Catalog) -> DataFrame:
    f = AssetFilter(search=" JPG ", ratings=[3], brightness_min=0.3, brightness_max=float("nan"), tones=["mid_tone", "high_key"], color_labels=["red", "yellow", "green", "blue", "purple"])
    return Q.select(c, AssetQuery(filter=f), "asset_id", "file_name").select("asset_id", "file_name")


@query("b06_search", _res(f"contains({_LOWER.format('file_name')}, 'sc_') OR contains({_LOWER.format('relative_path')}, 'sc_')"))
def b06(c: Catalog) -> DataFrame:
    return _filtered(c, search="Sc_")


@query("b07_primary", _res("effective_primary IN ('photo_street', 'photo_macro')"))
def b07(c: Catalog) -> DataFrame:
    return _filtered(c, primary_categories=["photo_urban", "photo_macro"])


@query("b08_tags_any", _res("list_has_any(effective_tags, ['outdoor', 'single_person'])"))
def b08any(c: Catalog) -> DataFrame:
    return _filtered(c, tags=["outdoor", "person"])


@query("b08_tags_all", _res("list_has_all(effective_tags, ['favorite', 'indoor'])"))
def b08all(c: Catalog) -> DataFrame:
    return _filtered(c, tags=["favorite", "indoor"], tag_mode="all")


@query("b09_tone", _res("effective_tone IN ('high_key')"))
def b09(c: Catalog) -> DataFrame:
    return _filtered(c, tones=["high_key"])


_COVER = "len(list_filter(from_json(json_extract(palette, '$.coveragePalette'), '[{\"category\":\"VARCHAR\",\"areaCoverage\":\"DOUBLE\"}]'), lambda x: x.category IN ('orange', 'neutral') AND coalesce(x.areaCoverage, 1.0) >= 0.08)) > 0"


@query("b10_palette", _res(f"CASE WHEN manual_color IS NOT NULL THEN manual_color IN ('orange', 'neutral') WHEN palette IS NOT NULL THEN {_COVER} ELSE category IN ('orange', 'neutral') END"))
def b10(c: Catalog) -> DataFrame:
    return _filtered(c, palette=["orange", "neutral"])


_H = "from_json(histogram, '[\"DOUBLE\"]')"


@query("b11_hue_range", _res(f"list_sum({_H}) > 0 AND {_H}[1] + {_H}[12] + {_H}[2] >= 0.415 * list_sum({_H})"))
def b11(c: Catalog) -> DataFrame:
    return _filtered(c, hue_centre=15, hue_width=30)


@query("b12_hue_bins", "SELECT * FROM (VALUES (0, 15, '0,11'), (45, 30, '0,1,2'), (-30, 15, '10,11')) AS t(centre, width, bins)")
def b12(c: Catalog) -> DataFrame:
    from .functions.colour import hue_bins

    return c.spark.createDataFrame([(x, w, ",".join(map(str, hue_bins(x, w)))) for x, w in ((0, 15), (45, 30), (-30, 15))], "centre INT, width INT, bins STRING")


@query("b13_strictness", "SELECT * FROM (VALUES (NULL, 0.415::DOUBLE), (0.0::DOUBLE, 0.08), (1.0, 0.75), (2.0, 0.75)) AS t(strictness, threshold)")
def b13(c: Catalog) -> DataFrame:
    from .functions.colour import strictness_threshold

    return c.spark.createDataFrame([(s, round(strictness_threshold(s), 9)) for s in (None, 0.0, 1.0, 2.0)], "strictness DOUBLE, threshold DOUBLE")


@query("b14_rating", _res("rating >= 4"))
def b14(c: Catalog) -> DataFrame:
    return _filtered(c, ratings=[2, 4])


@query("b15_color_mark", _res("color_label IN ('red', 'blue')"))
def b15(c: Catalog) -> DataFrame:
    return _filtered(c, color_labels=["red", "blue"])


@query("b16_saturation_level", _res("effective_saturation_level IN ('high')"))
def b16(c: Catalog) -> DataFrame:
    return _filtered(c, saturations=["high"])


@query("b17_bounds", _res("brightness >= 0.4 AND saturation <= 0.35"))
def b17(c: Catalog) -> DataFrame:
    return _filtered(c, brightness_min=0.4, saturation_max=0.35, brightness_max=float("inf"))


@query("b18_captured", _res("capture_time >= '2012-01-01' AND capture_time <= '2014-06-30T23:59:59.999'"))
def b18(c: Catalog) -> DataFrame:
    return _filtered(c, captured_from="2012-01-01", captured_to="2014-06-30")


@query("b19_status", _res("analysis_status = 'failed'"))
def b19(c: Catalog) -> DataFrame:
    return _filtered(c, analysis_status="failed")


@query("b20_v1_query", _res("rating >= 3 AND asset_id IN (SELECT asset_id FROM collection_assets WHERE collection_id = 1)"))
def b20(c: Catalog) -> DataFrame:
    return Q.select(c, Q.from_v1({"favorite_only": True, "library_id": 7, "ratings": [3]}), "asset_id", "file_name").select("asset_id", "file_name")


@query("b23_paging", "SELECT * FROM (VALUES (1, 120), (1, 1), (3, 500), (2, 50)) AS t(page, size)")
def b23(c: Catalog) -> DataFrame:
    return c.spark.createDataFrame([Q.paging(*x) for x in ((None, None), (0, 0), (3, 900), (2, 50))], "page INT, size INT")


@query("b26_present_members", with_tables("SELECT m.collection_id, a.id FROM members m JOIN now_assets a ON a.id = m.asset_id WHERE a.file_status = 'present'", "members", "now_assets"))
def b26(c: Catalog) -> DataFrame:
    return c.members.join(c.now_assets.where("file_status = 'present'").select(F.col("id").alias("asset_id")), "asset_id").select("collection_id", F.col("asset_id").alias("id"))


@query("b27_not_current", with_tables("SELECT id FROM now_assets a WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.asset_id = a.id AND l.source_fingerprint = a.fingerprint AND l.model_version = '2.1' AND l.layer = 'semantic') OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.asset_id = a.id AND l.layer = 'subject' AND l.source_fingerprint = a.fingerprint)", "labels"))
def b27(c: Catalog) -> DataFrame:
    """Work to do: no current label, or no completed subject run."""
    key = [F.col("asset_id").alias("id"), F.col("source_fingerprint").alias("fingerprint")]
    have = c.labels.where("layer = 'subject' or model_version = '2.1'").groupBy(*key).agg(F.max((F.col("layer") == "semantic") & (F.col("model_version") == "2.1")).alias("semantic"), F.max(F.col("layer") == "subject").alias("subject"))
    found = c.now_assets.select("id", "fingerprint").join(have, ["id", "fingerprint"], "left")
    return found.where(~F.coalesce(F.col("semantic") & F.col("subject"), F.lit(False))).select("id")


# ---- C: scopes

_BELOW_SOURCE = "t AS (SELECT id, CASE WHEN parent_relation = 'source' THEN parent_library_id END AS p FROM now_libraries), s AS (SELECT 2 AS id UNION SELECT t.id FROM t JOIN s ON t.p = s.id) "
_BELOW_COLLECTION = "s AS (SELECT 2 AS id UNION SELECT t.id FROM now_collections t JOIN s ON t.parent_collection_id = s.id) "


def _scoped(more: str, where: str, *names: str) -> str:
    return with_tables("", "now_assets", *names).rstrip() + ", " + more + f"SELECT a.id AS asset_id FROM now_assets a WHERE {where}"


def _scope(c: Catalog, **q) -> DataFrame:
    return Q.in_scope(c, AssetQuery(**q), c.now_assets.withColumnRenamed("id", "asset_id")).select("asset_id")


@query("c02_source_subtree", _scoped(_BELOW_SOURCE, "library_id IN (SELECT id FROM s)", "now_libraries"))
def c02(c: Catalog) -> DataFrame:
    return _scope(c, root="source", root_id=2)


@query("c03_source_direct", with_tables("SELECT id AS asset_id FROM now_assets WHERE library_id = 7", "now_assets"))
def c03(c: Catalog) -> DataFrame:
    return _scope(c, root="source", root_id=7, include_descendants=False)


@query("c04_collection_subtree", _scoped(_BELOW_COLLECTION, "EXISTS (SELECT 1 FROM members m JOIN s ON s.id = m.collection_id WHERE m.asset_id = a.id)", "now_collections", "members"))
def c04(c: Catalog) -> DataFrame:
    return _scope(c, root="collection", root_id=2)


@query("c05_collection_direct", with_tables("SELECT id AS asset_id FROM now_assets a WHERE EXISTS (SELECT 1 FROM members m WHERE m.collection_id = 2 AND m.asset_id = a.id)", "now_assets", "members"))
def c05(c: Catalog) -> DataFrame:
    return _scope(c, root="collection", root_id=2, include_descendants=False)


@query("c06_favorites", with_tables("SELECT id AS asset_id FROM now_assets a WHERE id IN (SELECT asset_id FROM members WHERE collection_id = 1)", "now_assets", "members"))
def c06(c: Catalog) -> DataFrame:
    return _scope(c, root="favorites")


_UP = "up AS (SELECT id AS node, id AS ancestor FROM now_collections UNION SELECT up.node, c.parent_collection_id FROM up JOIN now_collections c ON c.id = up.ancestor WHERE c.parent_collection_id IN (SELECT id FROM now_collections)) "


@query("c07_closure", with_tables("", "now_collections").rstrip() + ", " + _UP + "SELECT ancestor, node FROM up")
def c07(c: Catalog) -> DataFrame:
    return closure(c.now_collections, "id", "parent_collection_id").select("ancestor", "node")


@query("c08_descendant_roots", with_tables("", "now_libraries").rstrip() + ", " + _BELOW_SOURCE + "SELECT l.id, CAST(length(l.source_identity_key) AS INTEGER) AS key_length FROM now_libraries l JOIN s ON s.id = l.id WHERE l.id <> 2")
def c08(c: Catalog) -> DataFrame:
    tree = c.now_libraries.select("id", F.when(F.col("parent_relation") == "source", F.col("parent_library_id")).alias("parent"))
    below = reach(tree, "id", "parent", 2).where("distance > 0").select(F.col("node").alias("id"))
    return c.now_libraries.join(below, "id", "left_semi").select("id", F.length("source_identity_key").alias("key_length")).orderBy(F.desc("key_length"))


@query("c09_cycle_check", with_tables("", "now_libraries").rstrip() + ", s AS (SELECT 2 AS id UNION SELECT t.id FROM now_libraries t JOIN s ON t.parent_library_id = s.id) SELECT l.id AS new_parent, l.id IN (SELECT id FROM s) AS makes_cycle FROM now_libraries l")
def c09(c: Catalog) -> DataFrame:
    """For the library 2: which new parents would close a cycle (itself and all below it, whatever the relation)."""
    below = reach(c.now_libraries, "id", "parent_library_id", 2).select(F.col("node").alias("id"), F.lit(True).alias("b"))
    return c.now_libraries.select("id").join(below, "id", "left").select(F.col("id").alias("new_parent"), F.coalesce("b", F.lit(False)).alias("makes_cycle"))


@query("c10_nearest_root", with_tables("SELECT id, max(root_key) AS root_key FROM (SELECT a.id, arg_max(l.source_identity_key, length(l.source_identity_key)) AS root_key FROM now_assets a JOIN now_libraries l ON starts_with(a.asset_identity_key, l.source_identity_key || '/') GROUP BY a.id) GROUP BY id", "now_assets", "now_libraries"))
def c10(c: Catalog) -> DataFrame:
    """Owner = the deepest root whose path holds the file: an equi-join on the file's ancestors instead of a range join."""
    up = c.now_assets.select("id", F.explode(T.ancestors("asset_identity_key")).alias("root_key"))
    roots = c.now_libraries.select(F.col("source_identity_key").alias("root_key")).distinct()
    return up.join(roots, "root_key").groupBy("id").agg(F.max_by("root_key", F.length("root_key")).alias("root_key"))


@query("c12_rebuilt_parents", with_tables("SELECT child, parent FROM (SELECT c.id AS child, p.id AS parent, row_number() OVER (PARTITION BY c.id ORDER BY length(p.source_identity_key) DESC, p.id) AS k FROM now_libraries c JOIN now_libraries p ON p.id <> c.id AND starts_with(c.source_identity_key, p.source_identity_key || '/') WHERE c.parent_relation = 'source') WHERE k = 1", "now_libraries"))
def c12(c: Catalog) -> DataFrame:
    kids = c.now_libraries.where("parent_relation = 'source'").select(F.col("id").alias("child"), F.explode(T.ancestors("source_identity_key")).alias("key"))
    found = kids.join(c.now_libraries.select(F.col("id").alias("parent"), F.col("source_identity_key").alias("key")), "key").where("child <> parent")
    w = Window.partitionBy("child").orderBy(F.length("key").desc(), "parent")
    return found.withColumn("k", F.row_number().over(w)).where("k = 1").select("child", "parent")


@query("c13_cross_source_guard", with_tables("", "now_assets", "now_libraries", "members").rstrip() + ", " + _BELOW_SOURCE + "SELECT m.collection_id, count(*) AS outside FROM members m JOIN now_assets a ON a.id = m.asset_id WHERE a.library_id IS NULL OR a.library_id NOT IN (SELECT id FROM s) GROUP BY ALL")
def c13(c: Catalog) -> DataFrame:
    """Members outside a source's scope, per collection; an empty result lets the operation pass."""
    tree = c.now_libraries.select("id", F.when(F.col("parent_relation") == "source", F.col("parent_library_id")).alias("parent"))
    held = c.members.join(c.now_assets.select(F.col("id").alias("asset_id"), "library_id"), "asset_id")
    outside = held.join(reach(tree, "id", "parent", 2).select(F.col("node").alias("library_id")), "library_id", "left_anti")
    return outside.groupBy("collection_id").agg(count_rows().alias("outside"))


@query("c14_browse_tree", with_tables(f"SELECT 'collection' AS kind, id, parent_collection_id AS parent_id, row_number() OVER (ORDER BY id <> 1, display_order NULLS FIRST, {_LOWER.format('name')} NULLS FIRST, id) AS ordinal FROM now_collections UNION ALL SELECT 'source', id, parent_library_id, (SELECT count(*) FROM now_collections) + row_number() OVER (ORDER BY display_order NULLS FIRST, {_LOWER.format('name')} NULLS FIRST, id) FROM now_libraries", "now_collections", "now_libraries"))
def c14(c: Catalog) -> DataFrame:
    """Collections first, favourites before the others, then sources; ordinals come from a range-partitioned sort, not from one task."""
    a = c.now_collections.select(F.lit("collection").alias("kind"), "id", F.col("parent_collection_id").alias("parent_id"), (F.col("id") != 1).alias("late"), "display_order", T.ascii_lower("name").alias("name"))
    b = c.now_libraries.select(F.lit("source").alias("kind"), "id", F.col("parent_library_id").alias("parent_id"), F.lit(False).alias("late"), "display_order", T.ascii_lower("name").alias("name"))
    rows = a.unionByName(b)
    return numbered(rows, [F.col("kind"), F.col("late"), F.col("display_order"), F.col("name"), F.col("id")], "ordinal").select("kind", "id", "parent_id", "ordinal")


# ---- D: joins that are not among the filters above


@query("d03_fanout_left", with_tables("SELECT l.id, count(a.id) AS assets, count(t.asset_id) AS measured FROM now_libraries l LEFT JOIN now_assets a ON a.library_id = l.id LEFT JOIN tone t ON t.asset_id = a.id GROUP BY l.id", "now_libraries", "now_assets", "tone"))
def d03(c: Catalog) -> DataFrame:
    """Left outer fan-out, aggregated before the outer join so that a library of many assets sends one row."""
    per = c.now_assets.join(c.tone.select(F.col("asset_id").alias("id"), F.lit(1).alias("m")), "id", "left").groupBy("library_id").agg(count_rows().alias("assets"), F.count("m").alias("measured"))
    zero = F.lit(0).cast("bigint")
    return c.now_libraries.select("id").join(per, F.col("id") == F.col("library_id"), "left").select("id", F.coalesce("assets", zero).alias("assets"), F.coalesce("measured", zero).alias("measured"))


@query("d09_anti", with_tables("SELECT id FROM now_assets WHERE id NOT IN (SELECT asset_id FROM members)", "now_assets", "members"))
def d09(c: Catalog) -> DataFrame:
    return c.now_assets.select("id").join(c.members.select(F.col("asset_id").alias("id")), "id", "left_anti")


@query("d10_or_exists", with_tables("SELECT id FROM now_assets a WHERE EXISTS (SELECT 1 FROM members m WHERE m.asset_id = a.id AND m.collection_id = 1) OR (EXISTS (SELECT 1 FROM tone t WHERE t.asset_id = a.id AND t.tone_label = 'low_key') AND NOT EXISTS (SELECT 1 FROM colour c WHERE c.asset_id = a.id))", "now_assets", "members", "tone", "colour"))
def d10(c: Catalog) -> DataFrame:
    flag = lambda df, n: df.select(F.col("asset_id").alias("id"), F.lit(True).alias(n))
    x = c.now_assets.select("id").join(flag(c.members.where("collection_id = 1"), "fav"), "id", "left").join(flag(c.tone.where("tone_label = 'low_key'"), "low"), "id", "left").join(flag(c.colour, "col"), "id", "left")
    return x.where("fav or (low and col is null)").select("id")


@query("d17_null_safe", with_tables("SELECT a.id AS id, count(*) AS siblings FROM now_collections a JOIN now_collections b ON a.parent_collection_id IS NOT DISTINCT FROM b.parent_collection_id GROUP BY a.id", "now_collections"))
def d17(c: Catalog) -> DataFrame:
    """Siblings, with roots as siblings of each other: counted per parent first, then joined null-safely."""
    per = c.now_collections.groupBy("parent_collection_id").agg(count_rows().alias("siblings")).withColumnRenamed("parent_collection_id", "p")
    return c.now_collections.join(per, F.col("parent_collection_id").eqNullSafe(F.col("p"))).select("id", "siblings")


# ---- E: aggregates


@query("e01_library_summary", with_tables("", "now_libraries", "now_assets").rstrip() + ", e AS (SELECT id, parent_library_id AS p FROM now_libraries WHERE parent_relation = 'source' AND parent_library_id IN (SELECT id FROM now_libraries)), up AS (SELECT id AS node, id AS ancestor FROM now_libraries UNION SELECT up.node, e.p FROM up JOIN e ON e.id = up.ancestor) SELECT up.ancestor AS library_id, count(a.id) AS assets, coalesce(sum(CASE WHEN file_status = 'present' THEN 1 ELSE 0 END), 0)::BIGINT AS present, coalesce(sum(CASE WHEN file_status = 'missing' THEN 1 ELSE 0 END), 0)::BIGINT AS missing, coalesce(sum(CASE WHEN semantic_status <> 'completed' THEN 1 ELSE 0 END), 0)::BIGINT AS pending FROM up LEFT JOIN now_assets a ON a.library_id = up.node GROUP BY up.ancestor")
def e01(c: Catalog) -> DataFrame:
    """Counts over each library and all below it: assets are counted per library, and the counts summed up the trees."""
    tree = c.now_libraries.select("id", F.when(F.col("parent_relation") == "source", F.col("parent_library_id")).alias("parent"))
    names = ("assets", "present", "missing", "pending")
    per = c.now_assets.groupBy(F.col("library_id").alias("id")).agg(count_rows().alias("assets"), F.count_if(F.col("file_status") == "present").alias("present"), F.count_if(F.col("file_status") == "missing").alias("missing"), F.count_if(F.col("semantic_status") != "completed").alias("pending"))
    rows = tree.join(per, "id", "left").select("id", "parent", *[F.coalesce(x, F.lit(0).cast("bigint")).alias(x) for x in names])
    return subtree_sums(rows, "id", "parent", names).withColumnRenamed("node_id", "library_id")


@query("e02_count", _res("rating >= 3", "count(*) AS total"))
def e02(c: Catalog) -> DataFrame:
    return Q.select(c, AssetQuery(filter=AssetFilter(ratings=[3])), "asset_id").agg(count_rows().alias("total"))


@query("e03_collection_counts", with_tables("SELECT c.id, count(m.asset_id) AS members FROM now_collections c LEFT JOIN members m ON m.collection_id = c.id GROUP BY c.id", "now_collections", "members"))
def e03(c: Catalog) -> DataFrame:
    per = c.members.groupBy(F.col("collection_id").alias("id")).agg(count_rows().alias("members"))
    return c.now_collections.select("id").join(per, "id", "left").select("id", F.coalesce("members", F.lit(0)).alias("members"))


_DUP = "SELECT fingerprint, count(*) AS copies, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum(file_size) - max(file_size) AS BIGINT) AS reclaimable FROM now_assets WHERE fingerprint <> '' AND file_status = 'present' GROUP BY fingerprint HAVING count(*) > 1 ORDER BY reclaimable DESC NULLS LAST, fingerprint LIMIT 200"


def _duplicates(c: Catalog) -> DataFrame:
    g = c.now_assets.where("fingerprint <> '' and file_status = 'present'").groupBy("fingerprint").agg(count_rows().alias("copies"), F.sum("file_size").alias("bytes"), (F.sum("file_size") - F.max("file_size")).alias("reclaimable"))
    return g.where("copies > 1").orderBy(F.desc_nulls_last("reclaimable"), "fingerprint").limit(200)


@query("e04_duplicates", with_tables(_DUP, "now_assets"))
def e04(c: Catalog) -> DataFrame:
    return _duplicates(c)


_GROUPS = "SELECT fingerprint FROM now_assets WHERE fingerprint <> '' AND file_status = 'present' GROUP BY fingerprint HAVING count(*) > 1"


@query("e05_duplicate_members", with_tables(f"SELECT a.fingerprint, a.id, row_number() OVER (PARTITION BY a.fingerprint ORDER BY is_favorite DESC NULLS LAST, coalesce(rating, 0) DESC, capture_time ASC NULLS FIRST, a.id) AS place FROM now_assets a JOIN ({_GROUPS}) d ON d.fingerprint = a.fingerprint WHERE a.file_status = 'present'", "now_assets"))
def e05(c: Catalog) -> DataFrame:
    """The members of every group of duplicates, the one to keep first."""
    present = c.now_assets.where("fingerprint <> '' and file_status = 'present'").select("fingerprint", "id", "is_favorite", "rating", "capture_time")
    several = present.groupBy("fingerprint").agg(count_rows().alias("n")).where("n > 1").select("fingerprint")
    order = [F.desc_nulls_last("is_favorite"), F.coalesce("rating", F.lit(0)).desc(), F.asc_nulls_first("capture_time"), F.col("id")]
    return running(present.join(several, "fingerprint", "left_semi"), ["fingerprint"], order, place=F.lit(1)).select("fingerprint", "id", "place")


@query("e06_folder_rollup", with_tables("SELECT library_id, folder, count(*) AS assets FROM (SELECT library_id, unnest(list_transform(range(1, len(string_split(relative_path, '/'))), lambda i: list_aggregate(string_split(relative_path, '/')[1:i], 'string_agg', '/'))) AS folder FROM now_assets WHERE file_status = 'present') GROUP BY ALL", "now_assets"))
def e06(c: Catalog) -> DataFrame:
    """Every asset once for each directory above it: counted per directory first, so only distinct directories are exploded."""
    per = c.now_assets.where("file_status = 'present'").groupBy("library_id", T.parent_path("relative_path").alias("directory")).agg(count_rows().alias("n"))
    up = per.select("library_id", F.explode(T.ancestors(F.concat("directory", F.lit("/x")))).alias("folder"), "n")
    return up.groupBy("library_id", "folder").agg(F.sum("n").alias("assets"))


@query("e07_label_groups", _res("true", "effective_primary AS label, 'p' AS kind").replace("SELECT effective_primary", "SELECT label, count(*) AS assets FROM (SELECT effective_primary", 1) + " AND effective_primary IS NOT NULL UNION ALL SELECT unnest(effective_tags), 't' FROM res) GROUP BY label")
def e07(c: Catalog) -> DataFrame:
    """Effective primary and every effective tag, repeated tags counted repeatedly."""
    x = classify.resolved(c, {"effective_primary", "effective_tags"})
    return x.select(F.explode(F.concat(F.filter(F.array("effective_primary"), lambda p: p.isNotNull()), F.col("effective_tags"))).alias("label")).groupBy("label").agg(count_rows().alias("assets"))


@query("e08_distinct", with_tables("SELECT collection_id, count(DISTINCT a.library_id) AS libraries FROM members m JOIN now_assets a ON a.id = m.asset_id GROUP BY ALL", "members", "now_assets"))
def e08(c: Catalog) -> DataFrame:
    return c.members.join(c.now_assets.select(F.col("id").alias("asset_id"), "library_id"), "asset_id").groupBy("collection_id").agg(F.count_distinct("library_id").alias("libraries"))


@query("e09_next_order", with_tables("SELECT parent_collection_id, coalesce(max(display_order) + 1, 0) AS next_order FROM now_collections GROUP BY ALL", "now_collections"))
def e09(c: Catalog) -> DataFrame:
    return c.now_collections.groupBy("parent_collection_id").agg(F.coalesce(F.max("display_order") + 1, F.lit(0)).alias("next_order"))


@query("e15_image_stats", with_tables("SELECT a.camera_make, count(*) AS n, round(avg(brightness), 6) AS mean, round(stddev_pop(brightness), 6) AS deviation, list_sort(list(brightness))[CAST(floor((count(*) - 1) * 0.9 + 0.5) AS INTEGER) + 1] AS p90, round(count(*) FILTER (brightness <= 0.15) / count(*), 6) AS dark, round(count(*) FILTER (brightness >= 0.9) / count(*), 6) AS bright FROM tone t JOIN now_assets a ON a.id = t.asset_id GROUP BY ALL", "tone", "now_assets"))
def e15(c: Catalog) -> DataFrame:
    """Mean, deviation and the nearest-rank percentile round((n - 1) q) per camera make.

    The percentile is found by counting distinct values, running sums over ranges of them and the first value that
    reaches the rank; no list of values is collected.
    """
    x = c.tone.join(c.now_assets.select(F.col("id").alias("asset_id"), "camera_make"), "asset_id")
    stats = x.groupBy("camera_make").agg(F.round(F.avg("brightness"), 6).alias("mean"), F.round(F.stddev_pop("brightness"), 6).alias("deviation"), F.round(F.avg((F.col("brightness") <= 0.15).cast("int")), 6).alias("dark"), F.round(F.avg((F.col("brightness") >= 0.9).cast("int")), 6).alias("bright"))
    p90 = nearest_rank(x, "camera_make", "brightness", {"p90": F.floor((F.col("n") - 1) * 0.9 + 0.5)}).withColumnRenamed("camera_make", "m")
    return stats.join(p90, F.col("camera_make").eqNullSafe(F.col("m"))).drop("m")


@query("e16_hue_histogram", "SELECT * FROM (SELECT CAST(floor(h / 30) AS BIGINT) AS bin, count(*) AS pixels FROM (SELECT CASE WHEN mx = mn THEN 0 WHEN mx = r THEN ((60 * ((g - b) / (mx - mn))) + 360) % 360 WHEN mx = g THEN 60 * ((b - r) / (mx - mn) + 2) ELSE 60 * ((r - g) / (mx - mn) + 4) END AS h FROM (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM (SELECT ('0x' || dominant_color_rgb[2:3])::INT / 255.0 AS r, ('0x' || dominant_color_rgb[4:5])::INT / 255.0 AS g, ('0x' || dominant_color_rgb[6:7])::INT / 255.0 AS b FROM color_features WHERE dominant_color_rgb IS NOT NULL)) WHERE mx > mn) GROUP BY ALL)")
def e16(c: Catalog) -> DataFrame:
    from .functions.colour import channels, hue

    r, g, b = channels(F.col("dominant_color_rgb"))
    x = c.raw("color_features").where("dominant_color_rgb is not null").select(r.alias("r"), g.alias("g"), b.alias("b")).where("greatest(r, g, b) > least(r, g, b)")
    return x.groupBy(F.floor(hue(F.col("r"), F.col("g"), F.col("b")) / 30).alias("bin")).agg(count_rows().alias("pixels"))


@query("e24_latency", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(ceil((count(*) - 1) * 0.5) AS INTEGER) + 1] AS p50, list_sort(list(value))[CAST(ceil((count(*) - 1) * 0.95) AS INTEGER) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY ALL")
def e24(c: Catalog) -> DataFrame:
    """Mean and the percentiles of rank ceil((n - 1) q), by counted distinct values as in e15."""
    x = c.raw("events").where("value is not null")
    mean = x.groupBy(F.col("event_type").alias("t")).agg(F.round(F.avg("value"), 6).alias("mean"))
    ranks = nearest_rank(x, "event_type", "value", {"p50": F.ceil((F.col("n") - 1) * 0.5), "p95": F.ceil((F.col("n") - 1) * 0.95)})
    return ranks.join(mean, F.col("event_type").eqNullSafe(F.col("t"))).drop("t")


@query("e27_group_order", with_tables(f"SELECT coalesce(color_label, 'unset') AS grp, count(*) AS assets, min(k) AS first_place FROM (SELECT *, row_number() OVER (ORDER BY {_LOWER.format('file_name')} NULLS LAST, id) AS k FROM (SELECT id, color_label, file_name FROM now_assets)) GROUP BY ALL", "now_assets"))
def e27(c: Catalog) -> DataFrame:
    """Groups in the order in which a sorted list shows them first."""
    rows = numbered(c.now_assets.select("id", "color_label", T.ascii_lower("file_name").alias("name")), [F.asc_nulls_last("name"), F.col("id")], "k")
    return rows.groupBy(F.coalesce("color_label", F.lit("unset")).alias("grp")).agg(count_rows().alias("assets"), F.min("k").alias("first_place"))


# ---- F: ranks


@query("f01_argmax", with_tables(f"SELECT asset_id, label FROM (SELECT asset_id, {_CANON.format('label')} AS label, row_number() OVER (PARTITION BY asset_id ORDER BY similarity DESC, {_CANON.format('label')}) AS k FROM labels) WHERE k = 1", "labels"))
def f01(c: Catalog) -> DataFrame:
    return c.labels.groupBy("asset_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), classify.canonical(F.col("label")).alias("label")))["label"].alias("label"))


@query("f02_survivor", "SELECT asset_identity_key, id FROM (SELECT asset_identity_key, id, row_number() OVER (PARTITION BY asset_identity_key ORDER BY file_status = 'present' DESC, scan_status = 'indexed' DESC, analysis_status = 'completed' DESC, last_seen_at DESC, last_seen_scan DESC, id DESC) AS k FROM assets) WHERE k = 1")
def f02(c: Catalog) -> DataFrame:
    order = [(F.col("file_status") == "present").desc(), (F.col("scan_status") == "indexed").desc(), (F.col("analysis_status") == "completed").desc(), F.desc("last_seen_at"), F.desc("last_seen_scan"), F.desc("id")]
    return c.raw("assets").withColumn("k", F.row_number().over(Window.partitionBy("asset_identity_key").orderBy(*order))).where("k = 1").select("asset_identity_key", "id")


@query("f03_library_survivor", "SELECT source_identity_key, id FROM (SELECT source_identity_key, id, row_number() OVER (PARTITION BY source_identity_key ORDER BY CASE status WHEN 'ready' THEN 0 WHEN 'scanning' THEN 1 ELSE 2 END, last_scan_at DESC NULLS LAST, scan_generation DESC, id DESC) AS k FROM libraries) WHERE k = 1")
def f03(c: Catalog) -> DataFrame:
    w = Window.partitionBy("source_identity_key").orderBy(F.when(F.col("status") == "ready", 0).when(F.col("status") == "scanning", 1).otherwise(2), F.desc_nulls_last("last_scan_at"), F.desc("scan_generation"), F.desc("id"))
    return c.raw("libraries").withColumn("k", F.row_number().over(w)).where("k = 1").select("source_identity_key", "id")


@query("f04_latest_job", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def f04(c: Catalog) -> DataFrame:
    last = c.raw("events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
    return last.select("user_id", "x.event_id", "x.event_type")


@query("f05_evidence_rank", with_tables("SELECT asset_id, layer, label, row_number() OVER (PARTITION BY asset_id ORDER BY is_primary DESC, similarity DESC, label, layer) - 1 AS place FROM labels", "labels"))
def f05(c: Catalog) -> DataFrame:
    w = Window.partitionBy("asset_id").orderBy(F.desc("is_primary"), F.desc("similarity"), "label", "layer")
    return c.labels.select("asset_id", "layer", "label", (F.row_number().over(w) - 1).cast("bigint").alias("place"))


# ---- G: order and pages


def _page(sort: str, direction: str, oracle_order: str) -> None:
    sql = _res("true", "asset_id, file_name") + f" ORDER BY {oracle_order}, {_LOWER.format('file_name')} NULLS LAST, asset_id LIMIT 100 OFFSET 200"
    query(f"g01_page_{sort}_{direction}", sql)(lambda c: Q.page(c, AssetQuery(sort=sort, direction=direction, page=3, page_size=100), "asset_id", "file_name").select("asset_id", "file_name"))


_page("file_name", "asc", f"{_LOWER.format('file_name')} ASC NULLS LAST")
_page("capture_time", "desc", "capture_time DESC NULLS LAST")
_page("modified_at", "asc", "modified_at ASC NULLS LAST")
_page("brightness", "asc", "brightness ASC NULLS LAST")
_page("saturation", "desc", "saturation DESC NULLS LAST")


@query("g07_libraries", with_tables("SELECT id, row_number() OVER (ORDER BY display_order NULLS FIRST, coalesce(last_scan_at, created_at) DESC NULLS LAST, id DESC) AS place FROM now_libraries", "now_libraries"))
def g07(c: Catalog) -> DataFrame:
    rows = c.now_libraries.select("id", "display_order", F.coalesce("last_scan_at", "created_at").alias("seen"))
    return numbered(rows, [F.asc_nulls_first("display_order"), F.desc_nulls_last("seen"), F.desc("id")], "place").select("id", "place")


# ---- H: classification


@query("h01_current_evidence", with_tables(f"SELECT l.asset_id, l.layer, {_CANON.format('l.label')} AS label, l.similarity FROM labels l JOIN now_assets a ON a.id = l.asset_id AND a.fingerprint = l.source_fingerprint WHERE l.model_version = '2.1'", "labels"))
def h01(c: Catalog) -> DataFrame:
    return classify.current_evidence(c).select("asset_id", "layer", "label", "similarity")


@query("h02_active_model", "SELECT model_name, max(model_version) AS active, count(DISTINCT model_version) AS versions FROM semantic_outputs GROUP BY ALL")
def h02(c: Catalog) -> DataFrame:
    return c.raw("semantic_outputs").groupBy("model_name").agg(F.max("model_version").alias("active"), F.count_distinct("model_version").alias("versions"))


@query("h05_resolve_single", _res("true", "asset_id, effective_primary, CASE WHEN mp IS NOT NULL THEN 'manual' WHEN auto_primary IS NOT NULL THEN 'auto' ELSE 'none' END AS primary_source, effective_tone, CASE WHEN mt IS NOT NULL THEN 'manual' WHEN tone_label IS NOT NULL THEN 'auto' ELSE 'none' END AS tone_source"))
def h05(c: Catalog) -> DataFrame:
    return classify.resolved(c, {"effective_primary", "effective_tone"}).select("asset_id", "effective_primary", "primary_source", "effective_tone", "tone_source")


@query("h06_resolve_tags", _res("true", "asset_id, list_aggregate(list_sort(list_transform(effective_tags, lambda x: lower(x))), 'string_agg', '|') AS tags, CASE WHEN len(adds) + len(removes) > 0 AND len(auto_tags) > 0 THEN 'mixed' WHEN len(adds) + len(removes) > 0 THEN 'manual' WHEN len(auto_tags) > 0 THEN 'auto' ELSE 'none' END AS tags_source"))
def h06(c: Catalog) -> DataFrame:
    return classify.resolved(c, {"effective_tags"}).select("asset_id", F.when(F.size("effective_tags") > 0, F.array_join(F.transform("effective_tags", lambda t: F.lower(t)), "|")).alias("tags"), "tags_source")


@query("h16_label_catalog", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{g}', {t}::DOUBLE, {str(g == 'scene').lower()}, {i})" for i, (n, g, t) in enumerate(LABELS)) + ") AS x(label, category_group, threshold, is_primary, place)")
def h16(c: Catalog) -> DataFrame:
    """The labels with their groups and thresholds: scenes, surroundings, subjects."""
    return c.spark.createDataFrame([(n, g, t, g == "scene", i) for i, (n, g, t) in enumerate(LABELS)], "label STRING, category_group STRING, threshold DOUBLE, is_primary BOOLEAN, place INT")


@query("h15_label_groups", with_tables(f"SELECT label, {_CANON.format('label')} AS canonical, CASE {_CANON.format('label')} " + " ".join(f"WHEN '{n}' THEN '{g}'" for n, g, _ in LABELS) + " END AS category_group, count(*) AS n FROM labels GROUP BY ALL", "labels"))
def h15(c: Catalog) -> DataFrame:
    """Stored labels, older names too, with today's name and group."""
    groups = F.create_map(*[F.lit(v) for n, g, _ in LABELS for v in (n, g)])
    return c.labels.groupBy("label").agg(count_rows().alias("n")).withColumn("canonical", classify.canonical(F.col("label"))).select("label", "canonical", groups[F.col("canonical")].alias("category_group"), "n")


# ---- I: set operations


@query("i01_union_all", with_tables("SELECT layer, count(*) AS n FROM labels GROUP BY ALL", "labels"))
def i01(c: Catalog) -> DataFrame:
    parts = [c.labels.where(F.col("layer") == x) for x in ("semantic", "subject")]
    return parts[0].unionByName(parts[1]).groupBy("layer").agg(count_rows().alias("n"))


@query("i03_insert_ignore", "SELECT collection_id, count(*) AS members FROM (SELECT collection_id, asset_id FROM collection_assets UNION SELECT 1, id FROM assets WHERE is_favorite AND id IS NOT NULL) WHERE collection_id IS NOT NULL AND asset_id IS NOT NULL GROUP BY ALL")
def i03(c: Catalog) -> DataFrame:
    new = c.raw("assets").where("is_favorite and id is not null").select(F.lit(1).cast("bigint").alias("collection_id"), F.col("id").alias("asset_id"))
    return c.members.unionByName(new).dropDuplicates(["collection_id", "asset_id"]).groupBy("collection_id").agg(count_rows().alias("members"))
