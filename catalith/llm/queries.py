"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.times import asset_times
from ..session import materialise
from ..sources.tables import clean_fingerprint, current, table
from .clusters import similarity_clusters, typical_members
from .leakage import leaked_items
from .mixing import mix
from .neighbours import most_similar
from .pii import find_pii, redact
from .survivors import best_records, most_common
from .vectors import current_vectors


def _copies(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Present assets with a fingerprint; values that cannot be right are null."""
    assets = current(spark, d, "assets", "id", "fingerprint", "file_status", "file_size", "rating", "capture_time", "camera_model", "last_seen_at", *more)
    present = asset_times(assets.where("file_status = 'present'").withColumn("fingerprint", clean_fingerprint("fingerprint")).where("fingerprint is not null"), table(spark, d, "camera_clocks"))
    return materialise(
        present.select(
            "fingerprint", "id", "last_seen_at", F.when(F.col("rating").between(1, 5), F.col("rating").cast("bigint")).alias("rating"), F.when(F.col("file_size") > 0, F.col("file_size")).alias("file_size"),
            F.col("instant_ms").alias("capture_ms"), "own_zone", *([F.col("camera_model")] if more else []), *more,
        ), "copies",
    )


FILLED = ["capture_ms", "rating", "file_size"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    copies = _copies(spark, d)
    best = best_records(copies, "fingerprint", "id", "last_seen_at", FILLED, least=2).select("fingerprint", F.col("survivor").alias("survivor_id"))
    seen = F.struct(F.coalesce("last_seen_at", F.lit("")).alias("at"), (-F.col("id")).alias("first"), F.col("rating").alias("rating"))
    values = copies.groupBy("fingerprint").agg(
        F.max(F.when(F.col("rating").isNotNull(), seen))["rating"].alias("last_rating"), F.min(F.when(F.col("own_zone"), F.col("capture_ms"))).alias("own_ms"), F.min(F.when(~F.col("own_zone"), F.col("capture_ms"))).alias("other_ms")
    )
    sizes = most_common(copies, "fingerprint", "file_size", "best_file_size")
    return best.join(values, "fingerprint").join(sizes, "fingerprint", "left").select(
        "fingerprint", "survivor_id", F.coalesce("last_rating", F.lit(0)).alias("best_rating"), F.coalesce("best_file_size", F.lit(0)).alias("best_file_size"), F.coalesce("own_ms", "other_ms", F.lit(-1)).alias("best_capture_ms")
    )


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group, its gaps filled from successive dominance layers."""
    fields = [*FILLED, "camera_model", "lens_model", "color_label"]
    best = best_records(_copies(spark, d, "lens_model", "color_label"), "fingerprint", "id", "last_seen_at", fields, least=2)
    return best.select("fingerprint", F.col("survivor").alias("survivor_id"), "members", "skyline", *fields)


def _looks(spark: SparkSession, d: str) -> DataFrame:
    tone = table(spark, d, "tone_features").where("algorithm_version = 'tone-v3' and brightness_mean between 0 and 1").groupBy(F.col("asset_id").alias("id")).agg(F.max("brightness_mean").alias("brightness"))
    colour = table(spark, d, "color_features").where("saturation_mean between 0 and 1").groupBy(F.col("asset_id").alias("id")).agg(F.max("saturation_mean").alias("saturation"))
    return materialise(current_vectors(spark, d).join(tone, "id").join(colour, "id").select("id", "vec", "brightness", "saturation"), "looks")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similarity_clusters(_looks(spark, d))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    base = _looks(spark, d)
    return typical_members(base, materialise(similarity_clusters(base), "clusters"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = most_similar(current_vectors(spark, d))
    return near.select(F.least("id", "neighbour").alias("asset_a"), F.greatest("id", "neighbour").alias("asset_b")).distinct()


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return most_similar(current_vectors(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents and how far."""
    found = leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("containment").alias("most_contained"), F.count_if(F.col("containment") == 1.0).alias("whole"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_pii(table(spark, d, "documents"), table(spark, d, "name_parts")).select("doc_id", "pii_kind", "pii_text").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return redact(docs, find_pii(docs, table(spark, d, "name_parts")))


QUERIES = {"p3_found": p3_found, "p3_survivors": p3_survivors, "p4_found": p4_found, "p4_clusters": p4_clusters, "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p7_found": p7_found, "p7_items": p7_items, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_redacted": p9_redacted}
ORACLES: dict[str, str] = {}
