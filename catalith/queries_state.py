"""Queries of edit logs, snapshots, jobs, scoring details and planning checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vector as V
from .operators import classify, state
from .operators.ranking import numbered, running
from .plans.catalog import TOPICS, Catalog, with_tables
from .registry import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def count_rows() -> Column:
    return F.count(F.lit(1))


# ---- A


@query("a05_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def a05(c: Catalog) -> DataFrame:
    return c.raw("documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("a12_manifest_json", "SELECT id, CAST(json_object('id', id, 'path', file_name, 'bytes', file_size) AS VARCHAR) AS line FROM (SELECT DISTINCT id, file_name, file_size FROM assets WHERE id IS NOT NULL AND file_name IS NOT NULL AND file_size IS NOT NULL)")
def a12(c: Catalog) -> DataFrame:
    rows = c.raw("assets").where("id is not null and file_name is not null and file_size is not null").select("id", "file_name", "file_size").distinct()
    return rows.select("id", F.to_json(F.struct("id", F.col("file_name").alias("path"), F.col("file_size").alias("bytes"))).alias("line"))


@query("a14_replace_plan", with_tables("SELECT a.id, substr(a.fingerprint, 1, 8) AS target, coalesce(o.first_seen, a.last_seen_at) AS created_at FROM now_assets a LEFT JOIN (SELECT id, min(first_seen_at) AS first_seen FROM assets WHERE scan_status = 'indexed' GROUP BY id) o ON o.id = a.id", "now_assets"))
def a14(c: Catalog) -> DataFrame:
    """A plan's rows are replaced, the date of its first making is kept."""
    old = c.raw("assets").where("scan_status = 'indexed'").groupBy("id").agg(F.min("first_seen_at").alias("first_seen"))
    return c.now_assets.join(old, "id", "left").select("id", F.substring("fingerprint", 1, 8).alias("target"), F.coalesce("first_seen", "last_seen_at").alias("created_at"))


@query("a18_folder_labels", "SELECT DISTINCT name, list_aggregate(list_sort(list_distinct(list_filter(list_transform(string_split(name, ' '), lambda x: trim(x)), lambda x: len(x) > 0))), 'string_agg', '+') AS labels FROM libraries WHERE name IS NOT NULL AND trim(name) <> ''")
def a18(c: Catalog) -> DataFrame:
    """Labels in a folder name: split, trimmed, sorted, each once."""
    parts = F.filter(F.transform(F.split("name", " "), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return c.raw("libraries").where("name is not null and trim(name) <> ''").select("name", F.array_join(F.array_sort(F.array_distinct(parts)), "+").alias("labels")).distinct()


@query("a20_data_url", "SELECT item_id, 'data:image/jpeg;base64,' || base64(encode(item_text)) AS url FROM eval_items")
def a20(c: Catalog) -> DataFrame:
    from .sources.files import data_url

    return c.raw("eval_items").select("item_id", data_url(F.encode("item_text", "UTF-8")).alias("url"))


# ---- E, F


@query("e10_max_version", "SELECT tone_label, coalesce(max(CAST(substr(algorithm_version, 7) AS INTEGER)), 0) AS version FROM tone_features GROUP BY ALL")
def e10(c: Catalog) -> DataFrame:
    return c.raw("tone_features").groupBy("tone_label").agg(F.coalesce(F.max(F.substring("algorithm_version", 7, 9).cast("int")), F.lit(0)).alias("version"))


@query("e11_greatest", "SELECT DISTINCT asset_id, greatest(brightness_mean, contrast) AS most FROM tone_features WHERE brightness_mean IS NOT NULL AND contrast IS NOT NULL AND NOT isnan(brightness_mean) AND NOT isnan(contrast)")
def e11(c: Catalog) -> DataFrame:
    return c.raw("tone_features").where("brightness_mean is not null and contrast is not null and not isnan(brightness_mean) and not isnan(contrast)").select("asset_id", F.greatest("brightness_mean", "contrast").alias("most")).distinct()


@query("e17_palette_stats", with_tables("SELECT category, count(*) AS n, round(avg(saturation), 6) AS saturation, round(avg(neutral), 6) AS neutral, round(count(*) FILTER (neutral >= 0.9) / count(*), 6) AS monochrome FROM colour GROUP BY ALL", "colour"))
def e17(c: Catalog) -> DataFrame:
    return c.colour.groupBy("category").agg(count_rows().alias("n"), F.round(F.avg("saturation"), 6).alias("saturation"), F.round(F.avg("neutral"), 6).alias("neutral"), F.round(F.count_if(F.col("neutral") >= 0.9) / F.count(F.lit(1)), 6).alias("monochrome"))


_TOPIC = "['" + "', '".join(TOPICS) + "']"


@query("e19_prompt_means", f"SELECT t AS topic, round(coalesce(avg(abs(e)), 0), 6) AS score FROM (SELECT unnest({_TOPIC}) AS t, unnest(range(0, 12)) AS i) LEFT JOIN (SELECT unnest(range(0, 36)) AS d, unnest(embedding[1:36])::DOUBLE AS e FROM embeddings) ON d // 3 = i GROUP BY ALL")
def e19(c: Catalog) -> DataFrame:
    """Mean score of the three prompts of each topic, 0 where there is none."""
    scores = c.raw("embeddings").select(F.posexplode(F.slice("embedding", 1, 36)).alias("d", "e")).groupBy(F.floor(F.col("d") / 3).alias("i")).agg(F.avg(F.abs(F.col("e").cast("double"))).alias("s"))
    topics = c.spark.createDataFrame(list(enumerate(TOPICS)), "i BIGINT, topic STRING")
    return topics.join(scores, "i", "left").select("topic", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"))


@query("e21_second_best", "SELECT vec_id, list_max(e) AS best, list_sort(e, 'DESC')[2] AS second FROM (SELECT vec_id, list_transform(embedding[1:16], lambda x: round(x::DOUBLE, 6)) AS e FROM embeddings)")
def e21(c: Catalog) -> DataFrame:
    e = F.transform(F.slice("embedding", 1, 16), lambda x: F.round(x.cast("double"), 6))
    return c.raw("embeddings").select("vec_id", F.array_max(e).alias("best"), F.sort_array(e, asc=False)[1].alias("second"))


@query("e25_histogram64", "SELECT CAST(floor(v * 64 / 256) AS BIGINT) AS bin, count(*) AS n FROM (SELECT unnest([('0x' || rgb[2:3])::INT, ('0x' || rgb[4:5])::INT, ('0x' || rgb[6:7])::INT]) AS v FROM (SELECT dominant_color_rgb AS rgb FROM color_features WHERE dominant_color_rgb IS NOT NULL)) GROUP BY ALL")
def e25(c: Catalog) -> DataFrame:
    parts = F.array(*[F.conv(F.substring("dominant_color_rgb", i, 2), 16, 10).cast("int") for i in (2, 4, 6)])
    return c.raw("color_features").where("dominant_color_rgb is not null").select(F.explode(parts).alias("v")).groupBy(F.floor(F.col("v") * 64 / 256).alias("bin")).agg(count_rows().alias("n"))


@query("f08_margin", "SELECT vec_id, round(s[1] - s[2], 6) AS lead FROM (SELECT vec_id, list_sort(list_transform(embedding[1:12], lambda x: abs(x::DOUBLE)), 'DESC') AS s FROM embeddings)")
def f08(c: Catalog) -> DataFrame:
    s = F.sort_array(F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double"))), asc=False)
    return c.raw("embeddings").select("vec_id", F.round(s[0] - s[1], 6).alias("lead"))


@query("f09_plan_ordinal", with_tables("SELECT library_id, id, row_number() OVER (PARTITION BY library_id ORDER BY lower(nfc_normalize(relative_path)), id) AS ordinal FROM now_assets", "now_assets"))
def f09(c: Catalog) -> DataFrame:
    rows = c.now_assets.select("library_id", "id", T.comparison_key("relative_path").alias("k"))
    return running(rows, ["library_id"], [F.col("k"), F.col("id")], ordinal=F.lit(1)).select("library_id", "id", "ordinal")


# ---- G, H


@query("g08_collections", with_tables("SELECT id, name, row_number() OVER (ORDER BY id <> 1, display_order NULLS FIRST, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') NULLS FIRST, id) AS place FROM now_collections", "now_collections"))
def g08(c: Catalog) -> DataFrame:
    """The collections in the order of their list."""
    rows = c.now_collections.select("id", "name", "display_order", (F.col("id") != 1).alias("late"), T.ascii_lower("name").alias("low"))
    return numbered(rows, [F.col("late"), F.asc_nulls_first("display_order"), F.asc_nulls_first("low"), F.col("id")], "place").select("id", "name", "place")


@query("h07_dominant_colors", with_tables("SELECT asset_id, list_aggregate(CASE WHEN category IS NOT NULL THEN CASE WHEN coalesce(CAST(coverage AS DECIMAL(6,3)), -1) >= 0.08 AND coalesce(CAST(neutral AS DECIMAL(6,3)), 0) >= 0.08 THEN CASE WHEN category = 'neutral' THEN ['neutral'] ELSE [category, 'neutral'] END WHEN coalesce(CAST(coverage AS DECIMAL(6,3)), -1) >= 0.08 THEN [category] WHEN coalesce(CAST(neutral AS DECIMAL(6,3)), 0) >= 0.08 THEN ['neutral'] ELSE [category] END ELSE ['neutral'] END, 'string_agg', '|') AS colors FROM colour", "colour"))
def h07(c: Catalog) -> DataFrame:
    p = c.palettes.select("asset_id", F.from_json("palette", classify.PALETTE).alias("p"))
    return p.select("asset_id", F.array_join(classify.dominant_categories(F.col("p"), F.lit(None).cast("string")), "|").alias("colors"))


@query("h08_main_color", with_tables("SELECT asset_id, CASE WHEN category IS NULL THEN 'neutral' WHEN coalesce(CAST(coverage AS DECIMAL(6,3)), -1) >= 0.08 THEN category WHEN coalesce(CAST(neutral AS DECIMAL(6,3)), 0) >= 0.08 THEN 'neutral' ELSE category END AS main FROM colour", "colour"))
def h08(c: Catalog) -> DataFrame:
    """The first entry of at least .08 of the area, else the first entry."""
    p = c.palettes.select("asset_id", F.from_json("palette", classify.PALETTE)["coveragePalette"].alias("e"))
    big = F.get(F.filter("e", lambda x: x["areaCoverage"] >= 0.08), F.lit(0))["category"]
    return p.select("asset_id", F.coalesce(big, F.get("e", F.lit(0))["category"]).alias("main"))


@query("h14_valid_marks", "SELECT DISTINCT id, rating, color_label, coalesce(rating BETWEEN 0 AND 5, false) AS rating_ok, color_label IS NULL OR color_label IN ('red', 'yellow', 'green', 'blue', 'purple') AS mark_ok FROM assets")
def h14(c: Catalog) -> DataFrame:
    marks = ["red", "yellow", "green", "blue", "purple"]
    return c.raw("assets").select("id", "rating", "color_label", F.coalesce(F.col("rating").between(0, 5), F.lit(False)).alias("rating_ok"), (F.col("color_label").isNull() | F.col("color_label").isin(marks)).alias("mark_ok")).distinct()


@query("h17_registry", "SELECT unnest(['" + "', '".join(state.FIELDS) + "']) AS field")
def h17(c: Catalog) -> DataFrame:
    return c.spark.createDataFrame([(f,) for f in state.FIELDS], "field STRING")


@query("i04_set_algebra", with_tables("SELECT asset_id, len(list_intersect(l, ['outdoor', 'person'])) AS both, len(list_filter(l, lambda x: x NOT IN ('outdoor', 'person'))) AS others FROM (SELECT asset_id, list(DISTINCT label) AS l FROM labels GROUP BY ALL)", "labels"))
def i04(c: Catalog) -> DataFrame:
    x = c.labels.groupBy("asset_id").agg(F.collect_set("label").alias("l"))
    w = F.array(F.lit("outdoor"), F.lit("person"))
    return x.select("asset_id", F.size(F.array_intersect("l", w)).cast("bigint").alias("both"), F.size(F.array_except("l", w)).cast("bigint").alias("others"))


# ---- J


@query("j02_latest_features", "SELECT asset_id, b AS brightness_mean FROM (SELECT asset_id, b, row_number() OVER (PARTITION BY asset_id ORDER BY algorithm_version DESC, b DESC NULLS LAST) AS k FROM (SELECT *, CASE WHEN NOT isnan(brightness_mean) THEN brightness_mean END AS b FROM tone_features WHERE asset_id IS NOT NULL)) WHERE k = 1")
def j02(c: Catalog) -> DataFrame:
    """Features of the newest version of each asset; NaN is no value."""
    rows = c.raw("tone_features").where("asset_id is not null").select("asset_id", "algorithm_version", F.when(~F.isnan("brightness_mean"), F.col("brightness_mean")).alias("brightness_mean"))
    w = Window.partitionBy("asset_id").orderBy(F.desc("algorithm_version"), F.desc_nulls_last("brightness_mean"))
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select("asset_id", "brightness_mean")


@query("j04_touch_seen", with_tables("SELECT a.id, CASE WHEN m.asset_id IS NOT NULL THEN a.last_seen_scan + 1 ELSE a.last_seen_scan END AS last_seen_scan FROM now_assets a LEFT JOIN (SELECT DISTINCT asset_id FROM members) m ON m.asset_id = a.id", "now_assets", "members"))
def j04(c: Catalog) -> DataFrame:
    seen = c.members.select(F.col("asset_id").alias("id"), F.lit(1).alias("up")).distinct()
    return c.now_assets.select("id", "last_seen_scan").join(seen, "id", "left").select("id", (F.col("last_seen_scan") + F.coalesce("up", F.lit(0))).alias("last_seen_scan"))


@query("j09_merge_edits", with_tables("SELECT survivor AS asset_id, field, max(value) AS value FROM (SELECT o.*, min(a.id) OVER (PARTITION BY coalesce(a.fingerprint, CAST(a.id AS VARCHAR))) AS survivor FROM now_assets a LEFT JOIN overrides o ON o.asset_id = a.id) WHERE field IS NOT NULL GROUP BY ALL", "now_assets", "overrides"))
def j09(c: Catalog) -> DataFrame:
    """Edits of copies united under the smallest id of the copies."""
    key = F.coalesce("fingerprint", F.col("id").cast("string")).alias("key")
    low = c.now_assets.groupBy(key).agg(F.min("id").alias("survivor"))
    identity = c.now_assets.select(F.col("id").alias("asset_id"), key).join(low, "key").select("asset_id", "survivor")
    return state.merged_overrides(c.overrides.withColumn("updated_at", F.lit("1")), identity).select("asset_id", "field", "value")


@query("j10_job_items", with_tables("SELECT a.library_id, count(*) AS items FROM now_assets a WHERE a.file_status = 'present' AND NOT EXISTS (SELECT 1 FROM semantic_outputs s WHERE s.asset_id = a.id AND s.model_version = '2.1' AND s.source_fingerprint = a.fingerprint) GROUP BY ALL", "now_assets"))
def j10(c: Catalog) -> DataFrame:
    """Items of a new analysis job per library: present assets without a current output."""
    done = c.raw("semantic_outputs").where("model_version = '2.1'").select(F.col("asset_id").alias("id"), F.col("source_fingerprint").alias("fingerprint"))
    return c.now_assets.where("file_status = 'present'").join(done, ["id", "fingerprint"], "left_anti").groupBy("library_id").agg(count_rows().alias("items"))


@query("j14_progress", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL")
def j14(c: Catalog) -> DataFrame:
    return c.raw("events").groupBy("user_id").agg(count_rows().alias("total"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("j15_cancel", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'cancelled' ELSE event_type END AS status, CASE WHEN event_type IN ('view', 'click') THEN 'not_analyzed' END AS asset_status FROM events")
def j15(c: Catalog) -> DataFrame:
    """Open items (view stands for queued, click for running) of a cancelled job."""
    items = c.raw("events").select("event_id", F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")).alias("status"))
    return state.cancelled(items).select("event_id", "status", "asset_status")


@query("j18_collection_checks", with_tables("SELECT id, CASE WHEN name IS NULL OR length(trim(name)) NOT BETWEEN 1 AND 100 THEN 'name' WHEN length(coalesce(description, '')) > 500 THEN 'description' WHEN parent_collection_id = 1 THEN 'parent' END AS issue FROM now_collections", "now_collections"))
def j18(c: Catalog) -> DataFrame:
    n = F.length(F.trim("name"))
    issue = F.when(F.col("name").isNull() | ~n.between(1, 100), "name").when(F.length(F.coalesce("description", F.lit(""))) > 500, "description").when(F.col("parent_collection_id") == 1, "parent")
    return c.now_collections.select("id", issue.alias("issue"))


# ---- K, L, M


@query("k06_zero_padded", "SELECT DISTINCT id, CASE WHEN length(CAST(id AS VARCHAR)) >= 3 THEN CAST(id AS VARCHAR) ELSE lpad(CAST(id AS VARCHAR), 3, '0') END AS padded FROM libraries")
def k06(c: Catalog) -> DataFrame:
    return c.raw("libraries").select("id", T.zero_padded(F.col("id"), "000").alias("padded")).distinct()


@query("k07_utf16", "SELECT DISTINCT id, name, CAST(length(name) + len(list_filter(string_split(name, ''), lambda x: unicode(x) > 65535)) AS INTEGER) AS units FROM libraries WHERE name IS NOT NULL")
def k07(c: Catalog) -> DataFrame:
    return c.raw("libraries").where("name is not null").select("id", "name", T.utf16_length("name").alias("units")).distinct()


@query("k12_trimmed", "SELECT name, nullif(trim(name), '') AS clean, count(*) AS n FROM collections GROUP BY ALL")
def k12(c: Catalog) -> DataFrame:
    return c.raw("collections").groupBy("name", state.normalised_value(F.col("name")).alias("clean")).agg(count_rows().alias("n"))


@query("l07_end_of_day", "SELECT created_at[:10] AS day, created_at[:10] || 'T23:59:59.999' AS until, count(*) AS n FROM libraries GROUP BY ALL")
def l07(c: Catalog) -> DataFrame:
    day = F.substring("created_at", 1, 10)
    return c.raw("libraries").groupBy(day.alias("day"), F.when(F.length(day) == 10, F.concat(day, F.lit("T23:59:59.999"))).alias("until")).agg(count_rows().alias("n"))


@query("m02_cosine_prefix", "SELECT a.vec_id, round(list_dot_product(a.e, q.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(q.e, q.e)), 6) AS cosine FROM (SELECT vec_id, embedding[1:16]::DOUBLE[] AS e FROM embeddings) a, (SELECT embedding[1:16]::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) q")
def m02(c: Catalog) -> DataFrame:
    """Cosine over the common length: a query of 16 numbers against records of 64."""
    e = c.raw("embeddings")
    q = e.where("vec_id = 0").select(F.slice("embedding", 1, 16).alias("q"))  # one row
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(V.cosine_prefix(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query("m12_hue_distance", "SELECT DISTINCT asset_id, least(abs(h - 350) % 360, 360 - abs(h - 350) % 360) AS apart FROM (SELECT asset_id, asset_id % 360 AS h FROM color_features)")
def m12(c: Catalog) -> DataFrame:
    d = F.abs(F.col("asset_id") % 360 - 350) % 360
    return c.raw("color_features").select("asset_id", F.least(d, 360 - d).alias("apart")).distinct()


# ---- P, Q


# ---- what remains of the other sections


@query("b24_stable_ids", "SELECT asset_id, row_number() OVER (ORDER BY first_at, asset_id) AS place FROM (SELECT asset_id, min(added_at) AS first_at FROM collection_assets WHERE collection_id = 1 AND asset_id > 0 GROUP BY asset_id)")
def b24(c: Catalog) -> DataFrame:
    """Distinct positive ids in the order in which they were first seen."""
    from .queries_catalog import numbered

    first = c.raw("collection_assets").where("collection_id = 1 and asset_id > 0").groupBy("asset_id").agg(F.min("added_at").alias("first_at"))
    return numbered(first, [F.col("first_at"), F.col("asset_id")], "place").select("asset_id", "place")


@query("b25_selection", with_tables("SELECT id, file_name FROM now_assets WHERE id IN (SELECT asset_id FROM members WHERE collection_id = 3)", "now_assets", "members"))
def b25(c: Catalog) -> DataFrame:
    chosen = c.members.where("collection_id = 3").select(F.col("asset_id").alias("id"))
    return c.now_assets.select("id", "file_name").join(chosen, "id", "left_semi")


@query("b28_thumbnail_currency", with_tables("SELECT n.id FROM now_assets n JOIN (SELECT DISTINCT id, file_size, modified_at FROM assets WHERE scan_status = 'indexed' AND analysis_status = 'completed') t ON t.id = n.id AND t.file_size = n.file_size AND t.modified_at = n.modified_at", "now_assets"))
def b28(c: Catalog) -> DataFrame:
    """Assets for which something finished exists of the same size and time."""
    done = c.raw("assets").where("scan_status = 'indexed' and analysis_status = 'completed'").select("id", "file_size", "modified_at").distinct()
    return c.now_assets.select("id", "file_size", "modified_at").join(done, ["id", "file_size", "modified_at"]).select("id")


@query("c11_nested_roots", with_tables("SELECT p.id AS root, c.id AS nested FROM now_libraries p JOIN now_libraries c ON c.id <> p.id AND starts_with(c.source_identity_key, p.source_identity_key || '/')", "now_libraries"))
def c11(c: Catalog) -> DataFrame:
    """Roots physically inside other roots, whatever their relation: by the ancestors of the path, not by a range join."""
    kids = c.now_libraries.select(F.col("id").alias("nested"), F.explode(T.ancestors("source_identity_key")).alias("key"))
    return kids.join(c.now_libraries.select(F.col("id").alias("root"), F.col("source_identity_key").alias("key")), "key").select("root", "nested")


@query("e26_savings", with_tables("SELECT CAST(sum(r) AS BIGINT) AS reclaimable, count(*) AS groups FROM (SELECT sum(file_size) - max(file_size) AS r FROM now_assets WHERE fingerprint <> '' AND file_status = 'present' GROUP BY fingerprint HAVING count(*) > 1)", "now_assets"))
def e26(c: Catalog) -> DataFrame:
    g = c.now_assets.where("fingerprint <> '' and file_status = 'present'").groupBy("fingerprint").agg(count_rows().alias("n"), (F.sum("file_size") - F.max("file_size")).alias("r"))
    return g.where("n > 1").agg(F.sum("r").alias("reclaimable"), count_rows().alias("groups"))


@query("j03_failed_assets", "SELECT id, max(last_seen_scan) AS last_scan, CAST(NULL AS INTEGER) AS width, 'not_analyzed' AS semantic_status FROM assets WHERE scan_status = 'failed' GROUP BY id")
def j03(c: Catalog) -> DataFrame:
    """Failed files keep their identity, lose their dimensions and wait for analysis."""
    f = c.raw("assets").where("scan_status = 'failed'").groupBy("id").agg(F.max("last_seen_scan").alias("last_scan"))
    return f.select("id", "last_scan", F.lit(None).cast("int").alias("width"), F.lit("not_analyzed").alias("semantic_status"))


@query("j13_failed_items", with_tables("SELECT l.asset_id, l.label FROM labels l WHERE l.model_version = '2.1' AND l.asset_id NOT IN (SELECT id FROM now_assets WHERE analysis_status = 'failed')", "labels"))
def j13(c: Catalog) -> DataFrame:
    """Labels that stay when the items of failed assets are taken back."""
    failed = c.now_assets.where("analysis_status = 'failed'").select(F.col("id").alias("asset_id"))
    return c.labels.where("model_version = '2.1'").join(failed, "asset_id", "left_anti").select("asset_id", "label")


@query("l03_parse_times", "SELECT DISTINCT id, created_at, epoch_ms(created_at::TIMESTAMP) AS ms FROM libraries WHERE created_at IS NOT NULL")
def l03(c: Catalog) -> DataFrame:
    ts = F.coalesce(F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")), F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return c.raw("libraries").where("created_at is not null").select("id", "created_at", F.unix_millis(ts).alias("ms")).distinct()


