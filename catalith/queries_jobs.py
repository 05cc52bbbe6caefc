"""Queries of edits, merges, jobs, saved results and model plug-ins; versions of an asset's row serve as the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators import organize, plugin, scoring, state
from .plans.catalog import Catalog, with_tables
from .queries_plan import _BLOCK, _CHECKED, ROOT, _sql, plan_rows
from .registry import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def count_rows() -> Column:
    return F.count(F.lit(1))


# ---- A, E


@query("a15_plan_issues", _sql("SELECT i AS code, count(*) AS n FROM (SELECT unnest(issues) AS i FROM iss WHERE id % 2 = 1) GROUP BY ALL", _CHECKED))
def a15(c: Catalog) -> DataFrame:
    """Two plans are kept and one is deleted; the issues of the other are read back."""
    x = organize.draft(plan_rows(c), _BLOCK, ROOT).select("ordinal", F.col("id").alias("asset_id"), "target", "issues")
    plans = organize.Plans(c.spark)
    for name, rest in (("even", 0), ("odd", 1)):
        plans.save(name, x.where(F.col("asset_id") % 2 == rest))
    plans.delete("even")
    return plans.issues("odd").groupBy("code").agg(count_rows().alias("n"))


@query("e12_face_counts", "SELECT vec_id % 50 AS asset_id, CAST(sum(CASE WHEN f >= 0.65 THEN 1 ELSE 0 END) AS BIGINT) AS faces, max(f) AS best FROM (SELECT vec_id, round(abs(embedding[41]::DOUBLE) * 3, 6) AS f FROM embeddings) GROUP BY ALL")
def e12(c: Catalog) -> DataFrame:
    """Faces that are clear enough, per asset."""
    f = c.raw("embeddings").select((F.col("vec_id") % 50).alias("asset_id"), F.round(F.abs(F.get("embedding", F.lit(40)).cast("double")) * 3, 6).alias("score"))
    return f.groupBy("asset_id").agg(F.count_if(F.col("score") >= scoring.FACE).alias("faces"), F.max("score").alias("best"))


# ---- H: edits

_FOLD = "SELECT {0} FROM (SELECT *, row_number() OVER (PARTITION BY {1} ORDER BY w DESC, (v IS NOT NULL) DESC, v DESC) AS k FROM ({2})) WHERE k = 1 AND v IS NOT NULL"


@query("h10_edit_values", _FOLD.format("asset_id, v AS value", "asset_id", "SELECT id AS asset_id, last_seen_scan AS w, nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform([camera_make, ' ' || camera_make || ' ', lens_model, color_label, ''], lambda x: trim(x)), lambda x: x <> ''))), '|'), '') AS v FROM assets WHERE id IS NOT NULL"))
def h10(c: Catalog) -> DataFrame:
    """A list edit per version of an asset: cleaned, then folded to the latest; an empty list withdraws the edit."""
    given = F.array("camera_make", F.concat(F.lit(" "), "camera_make", F.lit(" ")), "lens_model", "color_label", F.lit(""))
    log = c.raw("assets").where("id is not null").select(F.col("id").alias("asset_id"), F.col("last_seen_scan").alias("at"), F.array_join(F.array_sort(state.cleaned_values(given)), "|").alias("value"))
    return state.fold_log(log, ["asset_id"], "at", "value").select("asset_id", "value")


@query("h11_tag_states", _FOLD.format("asset_id, v AS state", "asset_id", "SELECT id AS asset_id, last_seen_scan AS w, CASE WHEN is_favorite THEN 'add' WHEN NOT is_favorite THEN 'remove' END AS v FROM assets WHERE id IS NOT NULL"))
def h11(c: Catalog) -> DataFrame:
    """The state of a tag: added, removed, or cleared by a later null."""
    log = c.raw("assets").where("id is not null").select(F.col("id").alias("asset_id"), F.col("last_seen_scan").alias("at"), F.when(F.col("is_favorite"), "add").when(~F.col("is_favorite"), "remove").alias("state"))
    return state.fold_log(log, ["asset_id"], "at", "state").select("asset_id", "state")


@query("h12_restore", with_tables("SELECT a.id, count(o.field) AS edits, count(o.field) FILTER (NOT (a.id % 5 = 0 OR (a.id % 3 = 0 AND o.field = 'tone'))) AS kept, a.classification_revision + CASE WHEN count(o.field) FILTER (a.id % 5 = 0 OR (a.id % 3 = 0 AND o.field = 'tone')) > 0 THEN 1 ELSE 0 END AS revision FROM now_assets a LEFT JOIN overrides o ON o.asset_id = a.id GROUP BY a.id, a.classification_revision", "now_assets", "overrides"))
def h12(c: Catalog) -> DataFrame:
    """One field or all fields go back to automatic values; the revision rises only where that changed something."""
    log = c.overrides.withColumn("at", F.lit(1))
    ids = c.now_assets.select(F.col("id").alias("asset_id"))
    asked = ids.where("asset_id % 3 = 0").withColumn("field", F.lit("tone")).unionByName(ids.where("asset_id % 5 = 0").withColumn("field", F.lit(None).cast("string"))).withColumn("at", F.lit(2))
    fold = lambda x: state.fold_log(x, ["asset_id", "field"], "at", "value").select("asset_id", "field", "value")
    before, after = fold(log), fold(state.restored(log, asked))
    counts = lambda x, n: x.groupBy(F.col("asset_id").alias("id")).agg(count_rows().alias(n))
    bumped = state.changed_keys(before, after, "asset_id").select(F.col("asset_id").alias("id"), F.lit(1).alias("up"))
    x = c.now_assets.select("id", "classification_revision").join(counts(before, "edits"), "id", "left").join(counts(after, "kept"), "id", "left").join(bumped, "id", "left")
    zero = F.lit(0).cast("bigint")
    return x.select("id", F.coalesce("edits", zero).alias("edits"), F.coalesce("kept", zero).alias("kept"), (F.col("classification_revision") + F.coalesce("up", F.lit(0))).alias("revision"))


@query("h13_batches", with_tables("SELECT library_id, count(*) AS applied FROM now_assets WHERE library_id IS NOT NULL AND library_id NOT IN (SELECT library_id FROM now_assets WHERE library_id IS NOT NULL AND NOT coalesce(rating BETWEEN 0 AND 5, false)) GROUP BY ALL", "now_assets"))
def h13(c: Catalog) -> DataFrame:
    """Ratings set library by library: one impossible rating refuses the whole batch."""
    edits = c.now_assets.where("library_id is not null").select("library_id", "id", "rating")
    return state.accepted_batches(edits, "library_id", F.col("rating").between(0, 5)).groupBy("library_id").agg(count_rows().alias("applied"))


# ---- J: scans, merges, jobs

_GEN = "SELECT id, g, max(file_size) AS s, max(modified_at) AS m, max(scan_status) AS st FROM (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY last_seen_scan DESC) AS g FROM assets WHERE id IS NOT NULL) WHERE g <= 2 GROUP BY ALL"


@query("j06_skip_rule", with_tables(f"SELECT n.id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.s IS DISTINCT FROM o.s OR n.m IS DISTINCT FROM o.m OR coalesce(o.st, '') <> 'indexed' THEN 'full' WHEN t.asset_id IS NULL THEN 'features' ELSE 'skip' END AS route FROM ({_GEN}) n LEFT JOIN ({_GEN}) o ON o.id = n.id AND o.g = 2 LEFT JOIN tone t ON t.asset_id = n.id WHERE n.g = 1", "tone"))
def j06(c: Catalog) -> DataFrame:
    """What a scan does with each file: compared by size and time with the version before, and by its current features."""
    w = Window.partitionBy("id").orderBy(F.desc("last_seen_scan"))
    ranked = c.raw("assets").where("id is not null").select("id", "file_size", "modified_at", "scan_status", F.dense_rank().over(w).alias("g")).where("g <= 2")
    x = ranked.groupBy("id", "g").agg(*[F.max(n).alias(n) for n in ("file_size", "modified_at", "scan_status")])
    return state.scan_route(x.where("g = 1"), x.where("g = 2"), c.tone.select(F.col("asset_id").alias("id"))).select("id", "route")


@query("j08_library_removal", with_tables("SELECT x.*, new_owner IS NULL AND coalesce(fingerprint, '') <> '' AND NOT EXISTS (SELECT 1 FROM now_assets b LEFT JOIN x y ON y.id = b.id WHERE b.fingerprint = x.fingerprint AND (y.id IS NULL OR y.new_owner IS NOT NULL)) AS cache_removable FROM x", "now_assets", "now_libraries").replace("\nSELECT x.*", ", x AS (SELECT a.id, a.fingerprint, (SELECT arg_max(l.id, (length(l.source_identity_key), -l.id)) FROM now_libraries l WHERE l.id <> 7 AND starts_with(a.asset_identity_key, l.source_identity_key || '/')) AS new_owner FROM now_assets a WHERE a.library_id = 7)\nSELECT x.*"))
def j08(c: Catalog) -> DataFrame:
    """Removing a library: its assets go to the deepest library that still holds their path, or are deleted; cached files go where no other asset needs them."""
    moved = state.reowned(c.now_assets, c.now_libraries, 7)
    prints = c.now_assets.select("id", "fingerprint")
    free = state.removable_fingerprints(prints, moved.where("new_owner is null")).withColumn("free", F.lit(True))
    x = moved.join(prints, "id").join(free, "fingerprint", "left")
    return x.select("id", "fingerprint", "new_owner", (F.col("new_owner").isNull() & F.coalesce("free", F.lit(False))).alias("cache_removable"))


_SURVIVOR = "sv AS (SELECT id AS asset_id, min(id) OVER (PARTITION BY coalesce(fingerprint, CAST(id AS VARCHAR))) AS survivor FROM now_assets)"


def _identity(c: Catalog) -> DataFrame:
    """Copies under the smallest id of their fingerprint."""
    key = F.coalesce("fingerprint", F.col("id").cast("string")).alias("key")
    low = c.now_assets.groupBy(key).agg(F.min("id").alias("survivor"))
    return c.now_assets.select(F.col("id").alias("asset_id"), key).join(low, "key").select("asset_id", "survivor")


@query("j09_merge_assets", with_tables("", "now_assets", "members").rstrip() + f", {_SURVIVOR} SELECT survivor, count(*) AS copies, coalesce(bool_or(is_favorite), false) AS is_favorite, coalesce(arg_max(rating, (last_seen_at, -id)) FILTER (rating BETWEEN 1 AND 5), 0) AS rating FROM sv JOIN now_assets a ON a.id = sv.asset_id GROUP BY ALL")
def j09(c: Catalog) -> DataFrame:
    return state.merged_assets(c.now_assets, c.members, _identity(c))[0]


@query("j09_merge_members", with_tables("", "now_assets", "members").rstrip() + f", {_SURVIVOR} SELECT DISTINCT collection_id, survivor AS asset_id FROM members JOIN sv USING (asset_id)")
def j09_members(c: Catalog) -> DataFrame:
    return state.merged_assets(c.now_assets, c.members, _identity(c))[1]


_STATUS = "CASE arg_max(event_type, (ts, event_id)) WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'completed' END"


@query("j10_start_jobs", f"SELECT user_id, {_STATUS} NOT IN ('queued', 'running', 'cancelling') AS accepted FROM events GROUP BY ALL")
def j10(c: Catalog) -> DataFrame:
    """A user whose last job is still open starts no other (view stands for queued, click for running)."""
    last = c.raw("events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("e"))
    jobs = last.select("user_id", F.when(F.col("e") == "click", "running").when(F.col("e") == "view", "queued").otherwise("completed").alias("status"))
    return state.startable(jobs, c.raw("events").select("user_id").distinct(), "user_id").select("user_id", "accepted")


_SAVED = "n AS (SELECT DISTINCT s.asset_id, s.model_name, s.model_version, s.source_fingerprint FROM semantic_outputs s JOIN now_assets a ON a.id = s.asset_id AND a.fingerprint = s.source_fingerprint WHERE s.model_version = '2.1'), o AS (SELECT DISTINCT asset_id, model_name, model_version, source_fingerprint FROM semantic_outputs WHERE model_version <> '2.1')"


@query("j11_save_results", with_tables("", "now_assets").rstrip() + f", {_SAVED} SELECT asset_id, model_version, count(*) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.asset_id = o.asset_id AND n.model_name = o.model_name)) GROUP BY ALL")
def j11(c: Catalog) -> DataFrame:
    """Results of the newest version replace those of their model before, unless they came too late."""
    rows = c.raw("semantic_outputs").select("asset_id", "model_name", "model_version", "source_fingerprint").distinct()
    kept, _ = state.saved_results(rows.where("model_version <> '2.1'"), rows.where("model_version = '2.1'"), c.now_assets, ["asset_id", "model_name"])
    return kept.groupBy("asset_id", "model_version").agg(count_rows().alias("n"))


@query("j12_revisions", with_tables("", "now_assets").rstrip() + f", {_SAVED} SELECT a.id, a.classification_revision + CASE WHEN n.asset_id IS NOT NULL THEN 1 ELSE 0 END AS revision FROM now_assets a LEFT JOIN (SELECT DISTINCT asset_id FROM n) n ON n.asset_id = a.id")
def j12(c: Catalog) -> DataFrame:
    """Every asset whose results were saved gets a new revision."""
    rows = c.raw("semantic_outputs").select("asset_id", "model_name", "model_version", "source_fingerprint").distinct()
    _, saved = state.saved_results(rows.where("model_version <> '2.1'"), rows.where("model_version = '2.1'"), c.now_assets, ["asset_id", "model_name"])
    up = saved.select(F.col("asset_id").alias("id")).distinct().withColumn("up", F.lit(1))
    return c.now_assets.select("id", "classification_revision").join(up, "id", "left").select("id", (F.col("classification_revision") + F.coalesce("up", F.lit(0))).alias("revision"))


# ---- R: plug-ins


def _word_counter():
    def count(texts: list[str]) -> list[int]:
        if any(not t.strip() for t in texts):
            raise ValueError("empty text")
        return [len(t) for t in texts]

    return count


@query("r_model_errors", "SELECT doc_id, CASE WHEN text IS NOT NULL AND trim(text) <> '' THEN CAST(length(text) AS BIGINT) END AS result, CASE WHEN text IS NULL THEN 'no input' WHEN trim(text) = '' THEN 'ValueError: empty text' END AS error FROM documents")
def r_model(c: Catalog) -> DataFrame:
    """A model over all documents; what it cannot read comes out with its error, without harm to the batch."""
    return plugin.infer(c.raw("documents"), "doc_id", "text", _word_counter, "BIGINT")
