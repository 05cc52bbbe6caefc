"""Automatic evidence and manual edits resolved into effective values with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import CANONICAL, Catalog

VERSION = "2.1"


def canonical(label: Column) -> Column:
    names = F.create_map(*[F.lit(v) for kv in CANONICAL.items() for v in kv])
    return F.coalesce(names[label], label)


def current_evidence(c: Catalog) -> DataFrame:
    """Labels of the active model version whose fingerprint is that of the asset's current row, in today's names."""
    prints = c.now_assets.select(F.col("id").alias("asset_id"), F.col("fingerprint").alias("source_fingerprint"))
    found = c.labels.where(F.col("model_version") == VERSION).join(prints, ["asset_id", "source_fingerprint"])
    return found.select("asset_id", "layer", canonical(F.col("label")).alias("label"), "similarity", "is_primary")


def resolve_single(auto: Column, manual: Column) -> tuple[Column, Column]:
    """Effective value and where it comes from: none, auto or manual."""
    return F.coalesce(manual, auto), F.when(manual.isNotNull(), "manual").when(auto.isNotNull(), "auto").otherwise("none")


def resolve_tags(auto: Column, adds: Column, removes: Column) -> tuple[Column, Column]:
    """(auto - removes) + adds, sorted by folded name; repeated automatic tags stay repeated."""
    kept = F.filter(auto, lambda t: ~F.array_contains(removes, t))
    added = F.array_except(adds, auto)
    tags = F.array_sort(F.concat(kept, added), lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    manual, has = (F.size(adds) > 0) | (F.size(removes) > 0), F.size(auto) > 0
    return tags, F.when(manual & has, "mixed").when(manual, "manual").when(has, "auto").otherwise("none")


def dominant_categories(palette: Column, legacy: Column) -> Column:
    """The first two coverage entries of at least .08 of the area, else the first entry, without repeats; else the legacy category."""
    cover = palette["coveragePalette"]
    main = F.transform(F.slice(F.filter(cover, lambda x: x["areaCoverage"] >= 0.08), 1, 2), lambda x: x["category"])
    main = F.when(F.size(main) > 0, main).otherwise(F.transform(F.slice(cover, 1, 1), lambda x: x["category"]))
    return F.coalesce(F.array_distinct(main), F.when(legacy.isNotNull(), F.array(legacy)))


PALETTE = "struct<coveragePalette:array<struct<rank:int,category:string,areaCoverage:double>>>"


#: The columns that each side of the view brings; effective values name the sides they are made from.
SIDES = {
    "tone": {"brightness", "contrast", "tone_label", "effective_tone", "tone_source"},
    "colour": {"saturation", "saturation_label", "category", "rgb", "coverage", "neutral", "effective_saturation_level", "saturation_level_source", "effective_colors"},
    "palettes": {"palette", "histogram", "effective_colors"},
    "evidence": {"auto_primary_label", "auto_primary", "auto_tags", "effective_primary", "primary_source", "effective_tags", "tags_source"},
    "manual": {"manual_primary_category", "manual_tone", "manual_saturation", "manual_color", "effective_primary", "primary_source", "effective_tone", "tone_source", "effective_saturation_level", "saturation_level_source", "effective_colors"},
    "tags": {"adds", "removes", "effective_tags", "tags_source"},
}


def _side(c: Catalog, name: str) -> DataFrame:
    if name == "evidence":
        return current_evidence(c).groupBy("asset_id").agg(
            F.min(F.when(F.col("is_primary"), F.struct((-F.col("similarity")).alias("s"), "label")))["label"].alias("auto_primary_label"),
            F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_primary"), F.struct((-F.col("similarity")).alias("s"), "label")))), lambda x: x["label"]).alias("auto_tags"),
        )
    if name == "manual":
        return c.overrides.groupBy("asset_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"manual_{f}") for f in ("primary_category", "tone", "saturation", "color")])
    if name == "tags":
        return c.tag_overrides.groupBy("asset_id").agg(F.collect_set(F.when(F.col("state") == "add", F.col("tag_id"))).alias("adds"), F.collect_set(F.when(F.col("state") == "remove", F.col("tag_id"))).alias("removes"))
    if name == "palettes":
        return c.palettes.select("asset_id", F.from_json("palette", PALETTE).alias("palette"), F.from_json("histogram", "array<double>").alias("histogram"))
    return c.tone if name == "tone" else c.colour


def resolved(c: Catalog, columns: set[str] | None = None) -> DataFrame:
    """One row per current asset: its columns, features, automatic, manual and effective values. The view behind every filter.

    With `columns` only the sides that these need are built and joined, so a page by file name reads the assets alone.
    Evidence, edits and features are each reduced to one row per asset before they are joined, all by the asset's id,
    so the joins share one partitioning.
    """
    sides = [n for n, brings in SIDES.items() if columns is None or brings & columns]
    x = c.now_assets.withColumnRenamed("id", "asset_id")
    for name in sides:
        x = x.join(_side(c, name), "asset_id", "left")
    none = F.array().cast("array<string>")
    if "evidence" in sides:
        auto = F.coalesce("auto_primary_label", F.when(F.col("semantic_status") == "completed", "photo_abstract"))
        x = x.withColumns({"auto_primary": auto, "auto_tags": F.coalesce("auto_tags", none)})
    if "tags" in sides:
        x = x.withColumns({"adds": F.coalesce("adds", none), "removes": F.coalesce("removes", none)})
    out, there = {}, set(x.columns)
    for name, a, m in (("primary", "auto_primary", "manual_primary_category"), ("tone", "tone_label", "manual_tone"), ("saturation_level", "saturation_label", "manual_saturation")):
        if {a, m} <= there:
            out[f"effective_{name}"], out[f"{name}_source"] = resolve_single(F.col(a), F.col(m))
    if {"auto_tags", "adds"} <= there:
        out["effective_tags"], out["tags_source"] = resolve_tags(F.col("auto_tags"), F.col("adds"), F.col("removes"))
    if {"manual_color", "palette", "category"} <= there:
        out["effective_colors"] = F.coalesce(F.when(F.col("manual_color").isNotNull(), F.array("manual_color")), dominant_categories(F.col("palette"), F.col("category")))
    return x.withColumns(out)
