"""Mutable state as append-only logs and snapshots: latest rows, merges, ownership and job transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: The fields that can be edited by hand.
FIELDS = ["primary_category", "auxiliary_tags", "tone", "saturation", "dominant_color"]
#: What a restart makes of each job status; statuses not named here stay.
RECOVERY = {"running": "interrupted", "queued": "interrupted", "cancelling": "cancelled"}


def fold_log(log: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Latest value per key of an edit log; a null value is a tombstone (edit withdrawn). Ties in time go to the greater value."""
    last = log.groupBy(*keys).agg(F.max(F.struct(F.col(at), F.col(value).isNotNull().alias("_set"), F.col(value))).alias("x"))
    return last.where(F.col(f"x.{value}").isNotNull()).select(*keys, f"x.{value}", f"x.{at}")


def normalised_value(value: Column) -> Column:
    """Trimmed, null when nothing is left."""
    v = F.trim(value)
    return F.when(v != "", v)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Snapshot rewrite: rows of `new` replace those of `old` with the same key; both have the same columns."""
    tagged = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return tagged.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new")))).where("_k = 1").drop("_new", "_k")


def reowned(assets: DataFrame, roots: DataFrame, removed: int) -> DataFrame:
    """(id, new_owner): assets of a removed root with the deepest remaining root that holds their path, null where none does (to be deleted)."""
    left = roots.where(F.col("id") != removed).select(F.col("id").alias("new_owner"), F.col("source_identity_key").alias("key"))
    mine = assets.where(F.col("library_id") == removed).select("id", "asset_identity_key")
    held = mine.select("id", F.explode(T.ancestors("asset_identity_key")).alias("key")).join(left, "key")
    best = held.groupBy("id").agg(F.max(F.struct(F.length("key").alias("n"), (-F.col("new_owner")).alias("o")))["o"].alias("o"))
    return mine.select("id").join(best.select("id", (-F.col("o")).alias("new_owner")), "id", "left")


def recovered(status: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in RECOVERY.items() for v in kv])[status], status)


def cancelled(items: DataFrame) -> DataFrame:
    """Items of a cancelled job: open ones are cancelled and their assets wait for analysis again; finished ones stay."""
    is_open = F.col("status").isin("queued", "running")
    return items.withColumns({"asset_status": F.when(is_open, "not_analyzed"), "status": F.when(is_open, "cancelled").otherwise(F.col("status"))})


def merged_overrides(log: DataFrame, identity: DataFrame) -> DataFrame:
    """Edits of duplicate assets united under their survivor: per field the newest edit of any of them wins. identity (asset_id, survivor)."""
    moved = log.join(identity, "asset_id").drop("asset_id").withColumnRenamed("survivor", "asset_id")
    return fold_log(moved, ["asset_id", "field"], "updated_at", "value")


def cleaned_values(values: Column) -> Column:
    """A list as it is stored: trimmed, blanks and nulls dropped, each value once where it stood first; null when nothing is left."""
    kept = F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))
    return F.when(F.size(kept) > 0, kept)


def accepted_batches(edits: DataFrame, batch: str, valid: Column) -> DataFrame:
    """The edits of batches of which every edit is valid: a batch is applied as a whole or not at all."""
    bad = edits.where(~F.coalesce(valid, F.lit(False))).select(batch).distinct()
    return edits.join(bad, batch, "left_anti")


def restored(log: DataFrame, requests: DataFrame) -> DataFrame:
    """The log with a tombstone for each edit that a request withdraws.

    log (asset_id, field, value, at), requests (asset_id, field, at; a null field means all fields of the asset).
    """
    held = log.select("asset_id", "field").distinct()
    one = requests.where("field is not null").join(held, ["asset_id", "field"], "left_semi").select("asset_id", "field", "at")
    every = requests.where("field is null").select("asset_id", "at").join(held, "asset_id").select("asset_id", "field", "at")
    stones = one.unionByName(every).distinct().withColumn("value", F.lit(None).cast(dict(log.dtypes)["value"]))
    return log.unionByName(stones.select(log.columns))


def changed_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ between two states: their revision rises, that of the others stays."""
    columns = before.columns
    more = before.exceptAll(after.select(columns)).select(key)
    return more.unionByName(after.select(columns).exceptAll(before).select(key)).distinct()


def saved_results(old: DataFrame, new: DataFrame, now: DataFrame, identity: list[str], fingerprint: str = "source_fingerprint") -> tuple[DataFrame, DataFrame]:
    """Results after a save, and the keys that were saved: new rows replace all old ones of their identity.

    New rows count only while their fingerprint is that of the asset in `now` (id, fingerprint); late ones change
    nothing, so saving twice does not either. identity: the asset and the model the rows belong to.
    """
    fresh = new.join(now.select(F.col("id").alias(identity[0]), F.col("fingerprint").alias(fingerprint)), [identity[0], fingerprint], "left_semi")
    saved = fresh.select(*identity).distinct()
    return old.join(saved, identity, "left_anti").unionByName(fresh.select(old.columns)), saved


def scan_route(found: DataFrame, known: DataFrame, features: DataFrame) -> DataFrame:
    """(id, route) of each file found: 'new', 'full' when size or time changed or the last scan failed, 'features' when only current features are missing, else 'skip'.

    found (id, file_size, modified_at), known (id, file_size, modified_at, scan_status), features (id), one row per id.
    """
    k = known.select("id", F.col("file_size").alias("s"), F.col("modified_at").alias("m"), "scan_status", F.lit(True).alias("k"))
    x = found.select("id", "file_size", "modified_at").join(k, "id", "left").join(features.select("id", F.lit(True).alias("f")), "id", "left")
    same = F.col("s").eqNullSafe(F.col("file_size")) & F.col("m").eqNullSafe(F.col("modified_at")) & (F.coalesce("scan_status", F.lit("")) == "indexed")
    return x.select("id", F.when(F.col("k").isNull(), "new").when(~same, "full").when(F.col("f").isNull(), "features").otherwise("skip").alias("route"))


def removable_fingerprints(assets: DataFrame, removed: DataFrame) -> DataFrame:
    """(fingerprint): those that only removed assets (id) have, whose cached files may go."""
    gone = assets.join(removed.select("id"), "id", "left_semi").where(F.col("fingerprint") != "").select("fingerprint").distinct()
    return gone.join(assets.join(removed.select("id"), "id", "left_anti").select("fingerprint"), "fingerprint", "left_anti")


def merged_assets(assets: DataFrame, members: DataFrame, identity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Survivors of merged copies (survivor, copies, is_favorite, rating), and their memberships, each once.

    A mark any copy has is kept; the rating is the latest that is set. identity (asset_id, survivor).
    """
    x = assets.withColumnRenamed("id", "asset_id").join(identity, "asset_id")
    rated = F.when(F.col("rating").between(1, 5), F.struct("last_seen_at", (-F.col("asset_id")).alias("first"), "rating"))
    kept = x.groupBy("survivor").agg(F.count(F.lit(1)).alias("copies"), F.coalesce(F.max("is_favorite"), F.lit(False)).alias("is_favorite"), F.coalesce(F.max(rated)["rating"], F.lit(0)).alias("rating"))
    return kept, members.join(identity, "asset_id").select("collection_id", F.col("survivor").alias("asset_id")).distinct()


def startable(jobs: DataFrame, requests: DataFrame, scope: str, active: tuple[str, ...] = ("queued", "running", "cancelling")) -> DataFrame:
    """Requests with `accepted`: a scope that has an active job starts no other. jobs (scope, status), one row per scope."""
    busy = jobs.where(F.col("status").isin(*active)).select(scope, F.lit(True).alias("_busy"))
    return requests.join(busy, scope, "left").withColumn("accepted", F.col("_busy").isNull()).drop("_busy")
