"""The versioned asset query: root, filter, sort and page, compiled to one plan for count and page."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import hue_bins, strictness_threshold
from ..functions.text import ascii_lower, contains_nocase
from ..operators.classify import canonical, resolved
from ..operators.hierarchy import reach
from .catalog import CANONICAL, Catalog

VERSION = 2
SORTS = {"file_name": "file_name", "capture_time": "capture_time", "modified_at": "modified_at", "brightness": "brightness", "saturation": "saturation"}
#: Fixed value: the system key of the collection that holds the favourites.
FAVOURITES = "default_favorites"


@dataclass
class AssetFilter:
    search: str | None = None
    primary_categories: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    tag_mode: str = "any"
    tones: list[str] = field(default_factory=list)
    palette: list[str] = field(default_factory=list)
    hue_centre: float | None = None
    hue_width: float = 30
    strictness: float | None = None
    ratings: list[int] = field(default_factory=list)
    color_labels: list[str] = field(default_factory=list)
    saturations: list[str] = field(default_factory=list)
    brightness_min: float | None = None
    brightness_max: float | None = None
    saturation_min: float | None = None
    saturation_max: float | None = None
    captured_from: str | None = None
    captured_to: str | None = None
    analysis_status: str | None = None


@dataclass
class AssetQuery:
    root: str = "all"  #: all, source, collection or favorites
    root_id: int | None = None
    include_descendants: bool = True
    filter: AssetFilter = field(default_factory=AssetFilter)
    sort: str = "file_name"
    direction: str = "asc"
    page: int = 1
    page_size: int = 120
    version: int = VERSION


def from_v1(v1: dict) -> AssetQuery:
    """The older form: a collection goes before favourites, before all, before a source."""
    q = AssetQuery(filter=AssetFilter(search=v1.get("search"), ratings=v1.get("ratings", [])), page=v1.get("page", 1), page_size=v1.get("page_size", 120), sort=v1.get("sort", "file_name"), direction=v1.get("direction", "asc"))
    if v1.get("collection_id"):
        q.root, q.root_id = "collection", v1["collection_id"]
    elif v1.get("favorite_only"):
        q.root = "favorites"
    elif v1.get("library_id"):
        q.root, q.root_id = "source", v1["library_id"]
    return q


def validate(q: AssetQuery) -> None:
    if q.version != VERSION:
        raise ValueError(f"query version {q.version} is not supported")
    if q.root not in ("all", "source", "collection", "favorites"):
        raise ValueError(f"unknown root {q.root}")
    if q.root in ("source", "collection") and not (q.root_id and q.root_id > 0):
        raise ValueError("a root needs a positive id")
    if q.sort not in SORTS or q.direction not in ("asc", "desc"):
        raise ValueError("unknown order")


def paging(page: int | None, size: int | None, default: int = 120) -> tuple[int, int]:
    """Page from 1, size 1 to 500."""
    return max(1, page or 1), min(500, max(1, default if size is None else size))


def hue_range(histogram: Column, centre: float, width: float, strictness: float | None) -> Column:
    """Whether the selected bins hold the share of all that the strictness asks for."""
    bins = hue_bins(centre, width)
    total = F.aggregate(histogram, F.lit(0.0), lambda s, v: s + v)
    chosen = reduce(lambda a, b: a + b, [F.coalesce(F.get(histogram, F.lit(i)), F.lit(0.0)) for i in bins], F.lit(0.0))
    return (total > 0) & (chosen >= strictness_threshold(strictness) * total)


def palette_match(palette: Column, manual: Column, legacy: Column, wanted: list[str]) -> Column:
    """A manual colour, else any coverage entry of at least .08 of the area (missing counts as all), else the legacy category."""
    entries = F.exists(palette["coveragePalette"], lambda x: x["category"].isin(wanted) & (F.coalesce(x["areaCoverage"], F.lit(1.0)) >= 0.08))
    return F.when(manual.isNotNull(), manual.isin(wanted)).when(palette.isNotNull(), entries).otherwise(legacy.isin(wanted))


def predicates(f: AssetFilter) -> list[Column]:
    """One column per clause that is present; they are all of built-in functions, so filters on stored columns reach the scan."""
    out: list[Column] = []
    if f.search and f.search.strip():
        out.append(contains_nocase("file_name", f.search) | contains_nocase("relative_path", f.search))
    name = lambda x: CANONICAL.get(x, x)
    if f.primary_categories:
        out.append(F.col("effective_primary").isin([name(x) for x in f.primary_categories]))
    if f.tags:
        wanted = F.array(*[F.lit(name(t)) for t in f.tags])
        tags = F.transform("effective_tags", canonical)
        out.append(F.arrays_overlap(tags, wanted) if f.tag_mode == "any" else F.size(F.array_except(wanted, tags)) == 0)
    if f.tones:
        out.append(F.col("effective_tone").isin(f.tones))
    if f.palette:
        out.append(palette_match(F.col("palette"), F.col("manual_color"), F.col("category"), f.palette))
    if f.hue_centre is not None and math.isfinite(f.hue_centre):
        out.append(hue_range(F.col("histogram"), f.hue_centre, f.hue_width, f.strictness))
    if f.ratings:
        out.append(F.col("rating") >= max(f.ratings))
    if f.color_labels:
        out.append(F.col("color_label").isin(f.color_labels))
    if f.saturations:
        out.append(F.col("effective_saturation_level").isin(f.saturations))
    for column, low, high in (("brightness", f.brightness_min, f.brightness_max), ("saturation", f.saturation_min, f.saturation_max)):
        if low is not None and math.isfinite(low):
            out.append(F.col(column) >= low)
        if high is not None and math.isfinite(high):
            out.append(F.col(column) <= high)
    if f.captured_from:
        out.append(F.col("capture_time") >= f.captured_from)
    if f.captured_to:
        out.append(F.col("capture_time") <= (f.captured_to + "T23:59:59.999" if len(f.captured_to) == 10 else f.captured_to))
    if f.analysis_status == "not_analyzed":
        out.append(F.col("analysis_status").isin("not_analyzed", "queued", "running"))
    elif f.analysis_status in ("failed", "completed"):
        out.append(F.col("analysis_status") == f.analysis_status)
    return out


def in_scope(c: Catalog, q: AssetQuery, assets: DataFrame, key: str = "asset_id") -> DataFrame:
    """Semi-join of assets with the query's root; an asset in several collections of a subtree comes once."""
    if q.root == "all":
        return assets
    if q.root == "source":
        if not q.include_descendants:
            return assets.where(F.col("library_id") == q.root_id)
        tree = c.now_libraries.select("id", F.when(F.col("parent_relation") == "source", F.col("parent_library_id")).alias("parent"))
        return assets.join(reach(tree, "id", "parent", q.root_id).select(F.col("node").alias("library_id")), "library_id", "left_semi")
    if q.root == "favorites":
        kept = c.now_collections.where(F.lower("system_key") == FAVOURITES).select(F.col("id").alias("collection_id"))
        held = c.members.join(kept, "collection_id", "left_semi")
        return assets.join(held.select(F.col("asset_id").alias(key)), key, "left_semi")
    held = c.members.where(F.col("collection_id") == q.root_id)
    if q.root == "collection" and q.include_descendants:
        below = reach(c.now_collections, "id", "parent_collection_id", q.root_id).select(F.col("node").alias("collection_id"))
        held = c.members.join(below, "collection_id", "left_semi")
    return assets.join(held.select(F.col("asset_id").alias(key)), key, "left_semi")


def columns_of(q: AssetQuery) -> set[str]:
    """The columns that the filter and the order of a query look at."""
    f, out = q.filter, {SORTS[q.sort]}
    for given, names in (
        (f.primary_categories, ["effective_primary"]), (f.tags, ["effective_tags"]), (f.tones, ["effective_tone"]), (f.palette, ["palette", "manual_color", "category"]), (f.hue_centre is not None, ["histogram"]),
        (f.saturations, ["effective_saturation_level"]), (f.brightness_min is not None or f.brightness_max is not None, ["brightness"]), (f.saturation_min is not None or f.saturation_max is not None, ["saturation"]),
    ):
        if given:
            out |= set(names)
    return out


def select(c: Catalog, q: AssetQuery, *columns: str) -> DataFrame:
    """The rows of a query before order and page; count and page are both taken from it.

    With `columns` the rows have these and what the order needs, and only the sides that they and the filter name are
    joined; else all columns.
    """
    validate(q)
    rows = in_scope(c, q, resolved(c, columns_of(q) | set(columns) if columns else None))
    for p in predicates(q.filter):
        rows = rows.where(p)
    return rows


def ordered(rows: DataFrame, q: AssetQuery) -> DataFrame:
    """Nulls last in both directions, then file name without regard to ASCII case, then id."""
    column = ascii_lower("file_name") if q.sort == "file_name" else F.col(SORTS[q.sort])
    first = column.asc_nulls_last() if q.direction == "asc" else column.desc_nulls_last()
    return rows.orderBy(first, ascii_lower("file_name").asc_nulls_last(), F.col("asset_id"))


def page(c: Catalog, q: AssetQuery, *columns: str) -> DataFrame:
    number, size = paging(q.page, q.page_size)
    return ordered(select(c, q, *columns), q).offset((number - 1) * size).limit(size)
