"""The catalogue as DataFrames, and small derived tables that stand in for evidence and user edits.

The derived tables are portable SQL over the catalogue tables, so that a test can rebuild them in another engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import current, table

#: The topics of the taxonomy in their order, which decides ties.
TOPICS = ["photo_portrait", "photo_landscape", "photo_street", "photo_architecture", "photo_still_life", "photo_food", "photo_wildlife", "photo_macro", "photo_activity", "photo_vehicle", "photo_document", "photo_abstract"]
#: The score each topic has to reach, in the order of TOPICS.
THRESHOLDS = [0.22, 0.18, 0.19, 0.19, 0.21, 0.21, 0.22, 0.22, 0.21, 0.22, 0.25, 0.21]
#: Labels of older taxonomies and what they are called now.
CANONICAL = {
    "unknown": "photo_abstract", "photo_documentary": "photo_abstract", "person": "single_person", "portrait": "single_person", "group": "multiple_people", "pet": "animal",
    "photo_urban": "photo_street", "photo_event": "photo_activity", "photo_transport": "photo_vehicle", "photo_plant": "photo_macro",
}
#: The topic that each subject stands for.
SUBJECT_TOPICS = {"single_person": "photo_portrait", "multiple_people": "photo_portrait", "animal": "photo_wildlife", "vehicle": "photo_vehicle", "food": "photo_food", "plant": "photo_macro"}

#: The score each subject has to reach.
SUBJECT_THRESHOLDS = {"single_person": 0.45, "multiple_people": 0.45, "animal": 0.40, "vehicle": 0.40, "food": 0.40, "plant": 0.40}
#: All labels with their group and threshold; scenes as above.
LABELS = [*((t, "scene", x) for t, x in zip(TOPICS, THRESHOLDS)), ("indoor", "context", 0.55), ("outdoor", "context", 0.55), *((s, "subject", SUBJECT_THRESHOLDS[s]) for s in SUBJECT_TOPICS)]

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {1} DESC NULLS LAST) AS k FROM {0} WHERE id IS NOT NULL) x WHERE k = 1"
BASE = {
    "now_assets": _LATEST.format("assets", "last_seen_scan"),
    "now_libraries": _LATEST.format("libraries", "scan_generation DESC NULLS LAST, parent_library_id DESC NULLS LAST, name DESC NULLS LAST, display_order"),
    "now_collections": _LATEST.format("collections", "updated_at DESC NULLS LAST, parent_collection_id DESC NULLS LAST, name DESC NULLS LAST, display_order"),
    "tone": "SELECT asset_id, max(brightness_mean) AS brightness, max(contrast) AS contrast, max(tone_label) AS tone_label FROM tone_features WHERE algorithm_version = 'tone-v3' AND brightness_mean BETWEEN 0 AND 1 AND asset_id IS NOT NULL GROUP BY asset_id",
    "colour": "SELECT asset_id, max(saturation_mean) AS saturation, max(saturation_label) AS saturation_label, max(dominant_color_category) AS category, max(dominant_color_rgb) AS rgb, max(CASE WHEN dominant_color_coverage BETWEEN 0 AND 1 THEN dominant_color_coverage END) AS coverage, max(CASE WHEN neutral_ratio BETWEEN 0 AND 1 THEN neutral_ratio END) AS neutral FROM color_features WHERE saturation_mean BETWEEN 0 AND 1 AND asset_id IS NOT NULL GROUP BY asset_id",
    "members": "SELECT DISTINCT collection_id, asset_id FROM collection_assets WHERE collection_id IS NOT NULL AND asset_id IS NOT NULL",
}
DERIVED = {
    "labels": """SELECT a.id AS asset_id, 'semantic' AS layer, CASE a.camera_make WHEN 'Velmar' THEN 'photo_portrait' WHEN 'Okunra' THEN 'photo_urban' WHEN 'Norlicht' THEN 'photo_landscape' WHEN 'Hanzuo' THEN 'unknown' WHEN 'Pixarro' THEN 'photo_food' ELSE 'photo_wildlife' END AS label,
  coalesce(t.brightness, 0.5) AS similarity, a.semantic_status = 'completed' AS is_primary, CASE WHEN a.analysis_status = 'failed' THEN '2.0' ELSE '2.1' END AS model_version, CASE WHEN a.rating = 2 THEN 'stale' ELSE a.fingerprint END AS source_fingerprint FROM now_assets a LEFT JOIN tone t ON t.asset_id = a.id
UNION ALL SELECT a.id, 'semantic', CASE WHEN coalesce(t.brightness, 0) >= 0.5 THEN 'outdoor' ELSE 'indoor' END, coalesce(t.contrast, 0.1), false, '2.1', CASE WHEN a.rating = 2 THEN 'stale' ELSE a.fingerprint END FROM now_assets a LEFT JOIN tone t ON t.asset_id = a.id
UNION ALL SELECT a.id, 'subject', CASE WHEN c.saturation > 0.5 THEN 'person' ELSE 'pet' END, coalesce(c.saturation, 0.4), false, '2.1', a.fingerprint FROM now_assets a JOIN colour c ON c.asset_id = a.id""",
    "overrides": """SELECT id AS asset_id, 'primary_category' AS field, 'photo_macro' AS value FROM now_assets WHERE rating = 5
UNION ALL SELECT id, 'tone', 'high_key' FROM now_assets WHERE color_label = 'red'
UNION ALL SELECT id, 'saturation', 'high' FROM now_assets WHERE color_label = 'green'
UNION ALL SELECT id, 'color', 'orange' FROM now_assets WHERE color_label = 'blue'""",
    "tag_overrides": """SELECT id AS asset_id, 'favorite' AS tag_id, 'add' AS state FROM now_assets WHERE is_favorite
UNION ALL SELECT id, 'outdoor', 'remove' FROM now_assets WHERE rating = 1
UNION ALL SELECT id, 'Indoor scene', 'add' FROM now_assets WHERE rating = 3""",
    "palettes": """SELECT asset_id, '{"coveragePalette":[' || CASE WHEN category IS NULL THEN '' ELSE '{"rank":0,"category":"' || category || '"' || coalesce(',"areaCoverage":' || CAST(CAST(coverage AS DECIMAL(6,3)) AS VARCHAR(20)), '') || '},' END || '{"rank":1,"category":"neutral","areaCoverage":' || coalesce(CAST(CAST(neutral AS DECIMAL(6,3)) AS VARCHAR(20)), '0.000') || '}]}' AS palette,
  '[' || CAST(asset_id * 3 % 7 AS VARCHAR(9)) || ',' || CAST(asset_id * 5 % 7 AS VARCHAR(9)) || ',' || CAST(asset_id * 2 % 5 AS VARCHAR(9)) || ',0,0,' || CAST(asset_id % 11 AS VARCHAR(9)) || ',0,1,0,' || CAST(asset_id % 3 AS VARCHAR(9)) || ',0,' || CAST(asset_id % 13 AS VARCHAR(9)) || ']' AS histogram FROM colour""",
}
USES = {"labels": ["now_assets", "tone", "colour"], "overrides": ["now_assets"], "tag_overrides": ["now_assets"], "palettes": ["colour"]}


class Catalog:
    """Tables of one data folder; every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.d, name)

    @cached_property
    def now_assets(self) -> DataFrame:
        return current(self.spark, self.d, "assets")

    @cached_property
    def now_libraries(self) -> DataFrame:
        return current(self.spark, self.d, "libraries")

    @cached_property
    def now_collections(self) -> DataFrame:
        return current(self.spark, self.d, "collections")

    @cached_property
    def tone(self) -> DataFrame:
        good = self.raw("tone_features").where("algorithm_version = 'tone-v3' and brightness_mean between 0 and 1 and asset_id is not null")
        return good.groupBy("asset_id").agg(F.max("brightness_mean").alias("brightness"), F.max("contrast").alias("contrast"), F.max("tone_label").alias("tone_label"))

    @cached_property
    def colour(self) -> DataFrame:
        good = self.raw("color_features").where("saturation_mean between 0 and 1 and asset_id is not null")
        sane = lambda c: F.max(F.when(F.col(c).between(0, 1), F.col(c)))
        return good.groupBy("asset_id").agg(
            F.max("saturation_mean").alias("saturation"), F.max("saturation_label").alias("saturation_label"), F.max("dominant_color_category").alias("category"), F.max("dominant_color_rgb").alias("rgb"),
            sane("dominant_color_coverage").alias("coverage"), sane("neutral_ratio").alias("neutral"),
        )

    @cached_property
    def members(self) -> DataFrame:
        return self.raw("collection_assets").where("collection_id is not null and asset_id is not null").select("collection_id", "asset_id").distinct()

    def derived(self, name: str) -> DataFrame:
        sql = DERIVED[name]
        for used in USES[name]:
            sql = sql.replace(f" {used} ", f" {{{used}}} ").replace(f" {used}\n", f" {{{used}}}\n")
            sql = sql[: -len(used)] + f"{{{used}}}" if sql.endswith(f" {used}") else sql
        sql = sql.replace('{"', '{{"').replace('"}', '"}}').replace("'},'", "'}},'").replace("'}]}'", "'}}]}}'")
        return self.spark.sql(sql, **{u: getattr(self, u) for u in USES[name]})

    labels = cached_property(lambda self: self.derived("labels"))
    overrides = cached_property(lambda self: self.derived("overrides"))
    tag_overrides = cached_property(lambda self: self.derived("tag_overrides"))
    palettes = cached_property(lambda self: self.derived("palettes"))


def with_tables(body: str, *names: str) -> str:
    """SQL for the check: `body` with the named tables defined before it."""
    need: list[str] = []
    for n in names:
        for x in (*USES.get(n, []), n):
            if x not in need:
                need.append(x)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({BASE.get(n) or DERIVED[n]})" for n in need) + "\n" + body
