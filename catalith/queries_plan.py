"""Queries of planning files and of scoring: every one calls the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import evaluate, organize, scoring
from .operators.organize import Rules
from .operators.ranking import numbered
from .plans.catalog import SUBJECT_TOPICS, THRESHOLDS, TOPICS, Catalog, with_tables
from .registry import Registry
from .session import materialise

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def count_rows() -> Column:
    return F.count(F.lit(1))


# ---- Q: planning. Marks stand in for the semantic label; EXIF dates that can be read are the capture time.

ROOT = "/" + "/".join(["a shelf of organised pictures"] * 7)
_ROWS = """pr AS (SELECT a.id, a.relative_path, a.file_name, a.extension, a.capture_time, a.file_size, a.rating, CASE WHEN regexp_matches(a.capture_time, '^[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$') THEN try_strptime(a.capture_time, '%Y:%m:%d %H:%M:%S') END AS captured, make_timestamp(a.modified_at * 1000) AS modified, a.camera_make, a.camera_model, a.lens_model,
  a.color_label AS semantic, t.tone_label AS tone, c.category AS dominant_color, c.saturation_label AS saturation, a.fingerprint, a.file_status, row_number() OVER (ORDER BY rtrim(replace(lower(nfc_normalize(a.relative_path)), '\\', '/'), '/') NULLS FIRST, a.id) AS ordinal
  FROM now_assets a LEFT JOIN tone t ON t.asset_id = a.id LEFT JOIN colour c ON c.asset_id = a.id)"""


def _sql(body: str, *ctes: str) -> str:
    return with_tables("", "now_assets", "tone", "colour").rstrip() + ", " + ",\n".join([_ROWS, *ctes]) + "\n" + body


def plan_rows(c: Catalog) -> DataFrame:
    """What a plan needs of each current asset, numbered in the order of their paths."""
    a = c.now_assets.select("id", "relative_path", "file_name", "extension", "capture_time", "file_size", "rating", F.try_to_timestamp("capture_time", F.lit("yyyy:MM:dd HH:mm:ss")).alias("captured"), "modified_at", "camera_make", "camera_model", "lens_model", F.col("color_label").alias("semantic"), "fingerprint", "file_status")
    sides = a.join(c.tone.select(F.col("asset_id").alias("id"), F.col("tone_label").alias("tone")), "id", "left").join(c.colour.select(F.col("asset_id").alias("id"), F.col("category").alias("dominant_color"), F.col("saturation_label").alias("saturation")), "id", "left")
    keyed = sides.withColumn("_path", T.comparison_key("relative_path"))
    return numbered(keyed, [F.asc_nulls_first("_path"), F.col("id")], "ordinal").drop("_path")


@query("q01_rule_checks", """SELECT * FROM (VALUES (0, NULL), (1, 'sequence_width'), (2, 'sequence_width'), (3, 'sequence_start'), (4, 'levels'), (4, 'duplicate_level'), (5, 'duplicate_level'), (6, 'invalid_level_fallback'), (7, 'unknown_template_variable'), (8, 'invalid_template'), (9, 'sequence_width'), (9, 'sequence_start'), (9, 'invalid_template')) AS t(rule, issue)""")
def q01(c: Catalog) -> DataFrame:
    dated = [("year", "modification_time"), ("month", "modification_time"), ("day", "unknown")]
    tried = [
        Rules("{capture_time:yyyy}_{semantic}", dated), Rules("a", width=0), Rules("a", width=13), Rules("a", start=0), Rules("a", [(k, "skip") for k in [*organize.LEVELS, "tone"]]), Rules("a", [("tone", "skip"), ("tone", "block")]),
        Rules("a", [("tone", "modification_time")]), Rules("{nope}"), Rules("{semantic"), Rules("}", width=0, start=0),
    ]
    rows = [(i, issue) for i, rules in enumerate(tried) for issue in (list(dict.fromkeys(organize.rule_issues(rules))) or [None])]
    return c.spark.createDataFrame(rows, "rule INT, issue STRING")


def _values(fallback: str) -> str:
    """The 18 variables as (name, value) structs, in SQL."""
    missing = {"unknown": "'unknown'", "modification_time": "'unknown'", "skip": "''", "block": "''"}[fallback]
    of = lambda x: f"CASE WHEN trim({x}) <> '' THEN {x} ELSE {missing} END"
    time = "coalesce(captured, modified)" if fallback == "modification_time" else "captured"
    text = {"modification_time": "coalesce(strftime(modified, '%Y-%m-%dT%H:%M:%S+00:00'), '')", "block": "''"}.get(fallback, "'unknown'")
    date = f"coalesce(strftime({time}, '%Y-%m-%d'), '')"
    values = {
        "capture_time": f"CASE WHEN captured IS NOT NULL THEN capture_time ELSE {text} END", "capture_date": date, "captured_date": date, "captured_time": f"coalesce(strftime({time}, '%H-%M-%S'), '')", "camera": of("coalesce(camera_model, camera_make)"),
        "camera_make": "coalesce(camera_make, '')", "camera_model": "coalesce(camera_model, '')", "lens": of("lens_model"), "original_name": "coalesce(file_name, '')", "original_stem": "regexp_replace(coalesce(file_name, ''), '(.)\\.[^.]*$', '\\1')", "extension": "ltrim(coalesce(extension, ''), '.')",
        "semantic": of("semantic"), "primary_label": of("semantic"), "tone": of("tone"), "dominant_color": of("dominant_color"), "saturation": of("saturation"), "sequence": "CAST(ordinal AS VARCHAR)", "short_hash": "substr(coalesce(fingerprint, ''), 1, 8)",
    }
    return "[" + ", ".join(f"{{n: '{n}', v: {v}}}" for n, v in values.items()) + "]"


def _variables(fallback: str) -> None:
    @query(f"q02_variables_{fallback}", _sql(f"SELECT id, u.n AS variable, u.v AS value FROM (SELECT id, unnest({_values(fallback)}) AS u FROM pr)"))
    def q02(c: Catalog) -> DataFrame:
        """All variables of a template, with what stands in for missing ones."""
        x = organize.draft(plan_rows(c), Rules("x", fallback=fallback), ROOT)
        return x.select("id", F.explode("values").alias("variable", "value"))


for _fallback in organize.FALLBACKS:
    _variables(_fallback)

PLAN = Rules("{camera_make}_{saturation}_{captured_time:HH}", [("year", "modification_time"), ("dominant_color", "unknown"), ("tone", "skip")])
_TARGET = """pl AS (SELECT *, concat_ws('/', coalesce(strftime(captured, '%Y'), strftime(modified, '%Y')), CASE WHEN dominant_color <> '' THEN dominant_color ELSE 'unknown' END, CASE WHEN tone <> '' THEN tone ELSE 'unknown' END, coalesce(camera_make, '') || '_' || CASE WHEN trim(saturation) <> '' THEN saturation ELSE 'unknown' END || '_' || coalesce(strftime(captured, '%H'), 'unknown')
  || CASE WHEN rating = 5 AND id % 2 = 0 THEN '_0001' ELSE '' END || '.' || ltrim(extension, '.')) AS target FROM pr)"""


def _plan(c: Catalog) -> DataFrame:
    """A drafted plan with many equal targets; half of the five-star files already carry a number."""
    x = organize.draft(plan_rows(c), PLAN, "/pictures").withColumn("short_hash", F.col("values")["short_hash"])
    numbered_ = (F.col("rating") == 5) & (F.col("id") % 2 == 0)
    return x.withColumn("target", F.when(numbered_, F.concat(organize.T.stem("target"), F.lit("_0001."), F.col("values")["extension"])).otherwise(F.col("target")))


@query("q02_render", _sql("SELECT id, target FROM pl", _TARGET))
def q02_render(c: Catalog) -> DataFrame:
    return _plan(c).select("id", "target")


_ORIGINAL = [("original_directory", "skip"), ("year", "modification_time"), ("month", "unknown"), ("day", "skip"), ("primary_semantic", "unknown"), ("tone", "skip"), ("dominant_color", "unknown"), ("saturation", "skip")]


@query("q03_levels", _sql("SELECT id, array_to_string(list_filter(string_split(concat_ws('/', regexp_extract(replace(relative_path, '\\', '/'), '^(.*)/[^/]*$', 1), coalesce(strftime(captured, '%Y'), strftime(modified, '%Y')), coalesce(strftime(captured, '%m'), 'unknown'), strftime(captured, '%d'), CASE WHEN trim(semantic) <> '' THEN semantic ELSE 'unknown' END, CASE WHEN trim(tone) <> '' THEN tone ELSE 'unknown' END, CASE WHEN trim(dominant_color) <> '' THEN dominant_color ELSE 'unknown' END, CASE WHEN trim(saturation) <> '' THEN saturation ELSE 'unknown' END), '/'), lambda s: s <> ''), '/') AS directory FROM pr"))
def q03(c: Catalog) -> DataFrame:
    """All kinds of levels, each with its own fallback; directories are split into segments."""
    rules = Rules("x", _ORIGINAL)
    segments, _ = organize.levels(rules, organize.variables(rules)[0])
    return plan_rows(c).select("id", F.array_join(segments, "/").alias("directory"))


_BLOCK = Rules("{original_stem}", [("original_directory", "skip"), ("year", "modification_time"), ("tone", "block")], fallback="block")
_DEV = "'" + "', '".join(T.RESERVED) + "'"
_REASON = f"CASE WHEN regexp_matches(s, '[<>:\"/\\\\|?*\\x00-\\x1f]') OR regexp_matches(s, '[ .]$') OR s = '' THEN 'invalid_segment' WHEN lower(split_part(s, '.', 1)) IN ({_DEV}) THEN 'reserved_name' END"
_CHECKED = f"""ck AS (SELECT *, concat_ws('/', CASE WHEN d <> '' THEN d END, coalesce(strftime(captured, '%Y'), strftime(modified, '%Y')), CASE WHEN tone <> '' THEN tone END, CASE WHEN lower(st) LIKE '%.' || lower(ltrim(extension, '.')) THEN st ELSE st || '.' || ltrim(extension, '.') END) AS target FROM (
  SELECT *, array_to_string(list_filter(string_split(regexp_extract(replace(relative_path, '\\', '/'), '^(.*)/[^/]*$', 1), '/'), lambda s: s <> ''), '/') AS d, regexp_replace(coalesce(file_name, ''), '(.)\\.[^.]*$', '\\1') AS st FROM pr)),
iss AS (SELECT *, list_filter([CASE WHEN captured IS NULL THEN 'capture_time_missing' END, CASE WHEN trim(coalesce(semantic, '')) = '' THEN 'semantic_missing' END, CASE WHEN trim(coalesce(camera_model, camera_make, '')) = '' THEN 'camera_missing' END, CASE WHEN trim(coalesce(lens_model, '')) = '' THEN 'lens_missing' END, CASE WHEN trim(coalesce(tone, '')) = '' THEN 'tone_missing' END,
  CASE WHEN trim(coalesce(dominant_color, '')) = '' THEN 'color_missing' END, CASE WHEN trim(coalesce(saturation, '')) = '' THEN 'saturation_missing' END, CASE WHEN captured IS NULL AND modified IS NULL THEN 'missing_metadata' END, CASE WHEN trim(coalesce(tone, '')) = '' THEN 'missing_metadata' END, CASE WHEN regexp_matches(st, '[/\\\\]') THEN 'target_escape' END,
  CASE WHEN target = '' OR regexp_matches(target, '^[/\\\\]') OR contains(target, ':') OR len(list_filter(string_split(target, '/'), lambda s: s IN ('.', '..') OR contains(s, '\\'))) > 0 THEN 'target_escape' END, CASE WHEN len(list_filter(string_split(target, '/'), lambda s: ({_REASON}) = 'reserved_name')) > 0 THEN 'reserved_name' END,
  CASE WHEN len(list_filter(string_split(target, '/'), lambda s: ({_REASON}) = 'invalid_segment')) > 0 THEN 'invalid_segment' END, CASE WHEN len(list_filter(string_split(target, '/'), lambda s: len(s) + len(regexp_replace(s, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) > 255)) > 0 THEN 'segment_too_long' END,
  CASE WHEN {len(ROOT) + 1} + len(target) + len(regexp_replace(target, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) > 260 THEN 'path_too_long' END, CASE WHEN coalesce(file_status <> 'present', true) THEN 'source_missing' END], lambda x: x IS NOT NULL) AS issues FROM ck)"""


@query("q04_issues", _sql("SELECT id, i AS issue, CAST(count(*) AS BIGINT) AS n FROM (SELECT id, unnest(issues) AS i FROM iss) GROUP BY ALL", _CHECKED))
def q04(c: Catalog) -> DataFrame:
    """What is wrong with each file's place, under the strictest fallback and a long root."""
    return organize.draft(plan_rows(c), _BLOCK, ROOT).select("id", F.explode("issues.code").alias("issue")).groupBy("id", "issue").agg(count_rows().alias("n"))


@query("q05_extension", with_tables("SELECT id, CASE WHEN lower(file_name) LIKE '%.' || lower(extension) THEN file_name ELSE file_name || '.' || extension END AS target FROM now_assets", "now_assets"))
def q05(c: Catalog) -> DataFrame:
    return c.now_assets.select("id", organize.with_extension(F.col("file_name"), F.col("extension")).alias("target"))


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CONFLICT = f"""ex AS (SELECT DISTINCT {_LOW.format('target')} AS low FROM pl WHERE rating = 4 AND id % 3 = 0),
cf AS (SELECT x.*, n > 0 AS clash, CASE WHEN n > 0 THEN CASE WHEN ex.low IS NOT NULL THEN 'existing_target' ELSE 'duplicate_target' END END AS conflict FROM (SELECT pl.*, {_LOW.format('target')} AS lt, regexp_extract(target, '^(.*?)(\\.[^./]*)?$', 1) AS stem, regexp_extract(target, '(\\.[^./]*)$', 1) AS ext,
  row_number() OVER (PARTITION BY {_LOW.format('target')} ORDER BY ordinal) - CASE WHEN {_LOW.format('target')} IN (SELECT low FROM ex) THEN 0 ELSE 1 END AS n FROM pl WHERE target IS NOT NULL) x LEFT JOIN ex ON ex.low = x.lt)"""
_TAKEN = f"""tk AS (SELECT DISTINCT regexp_extract(l, '^(.*)_([0-9]{{4}}|[1-9][0-9]{{4,}})(\\.[^./]*)?$', 1) AS s, regexp_extract(l, '^(.*)_([0-9]{{4}}|[1-9][0-9]{{4,}})(\\.[^./]*)?$', 3) AS e, TRY_CAST(regexp_extract(l, '^(.*)_([0-9]{{4}}|[1-9][0-9]{{4,}})(\\.[^./]*)?$', 2) AS BIGINT) AS m FROM (SELECT lt AS l FROM cf UNION SELECT low FROM ex)),
fr AS (SELECT s, e, list(m ORDER BY m) FILTER (m >= 1) AS ms FROM tk WHERE m IS NOT NULL GROUP BY ALL)"""


def _existing(plan: DataFrame) -> DataFrame:
    """Files that are there before: the targets of some of the plan's own files."""
    return plan.where((F.col("rating") == 4) & (F.col("id") % 3 == 0)).select("target")


def _conflicts(strategy: str, resolved: str, *ctes: str) -> None:
    @query(f"q06_{strategy}", _sql(f"SELECT id, target, conflict, {resolved} AS resolved FROM cf", _TARGET, _CONFLICT, *ctes))
    def q06(c: Catalog) -> DataFrame:
        plan = materialise(_plan(c).select("id", "ordinal", "target", "rating", "short_hash"), "plan")
        return organize.resolve_conflicts(plan, "target", "ordinal", strategy, _existing(plan)).select("id", "target", "conflict", "resolved")


_conflicts("skip", "target")
_conflicts("short_hash", "CASE WHEN clash THEN stem || '_' || substr(coalesce(fingerprint, ''), 1, 8) || ext ELSE target END")
_FREE = "list_reduce(list_prepend(CAST(n AS BIGINT), coalesce((SELECT ms FROM fr WHERE fr.s = {0} AND fr.e = {1}), [])), lambda f, m: CASE WHEN m <= f THEN f + 1 ELSE f END)".format(_LOW.format("stem"), _LOW.format("ext"))
_conflicts("sequence", f"CASE WHEN clash THEN stem || '_' || CASE WHEN length(CAST({_FREE} AS VARCHAR)) >= 4 THEN CAST({_FREE} AS VARCHAR) ELSE lpad(CAST({_FREE} AS VARCHAR), 4, '0') END || ext ELSE target END", _TAKEN)

_STATUS = " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, CASE WHEN file_status IS DISTINCT FROM 'present' AND NOT ({clash}) THEN 'error' WHEN {clash} THEN '{name}' WHEN captured IS NULL OR (captured IS NULL AND modified IS NULL) THEN 'warning' ELSE 'ready' END AS status, file_size FROM cf"
    for s, name, clash in (("skip", "skipped_conflict", "coalesce(clash, false)"), ("sequence", "warning", "coalesce(clash, false) AND coalesce(file_status = 'present', false)"))
)


@query("q07_status", _sql(f"SELECT strategy, status, count(*) AS items, CAST(sum(file_size) AS BIGINT) AS bytes FROM ({_STATUS}) GROUP BY ALL", _TARGET, _CONFLICT))
def q07(c: Catalog) -> DataFrame:
    """How many items of a plan are ready, to be warned about, in error or skipped, under two strategies."""
    plan = materialise(_plan(c).where("target is not null").select("id", "ordinal", "target", "rating", "short_hash", "issues", "file_size"), "plan")
    parts = []
    for s in ("skip", "sequence"):
        x = organize.resolve_conflicts(plan, "target", "ordinal", s, _existing(plan))
        parts.append(x.select(F.lit(s).alias("strategy"), organize.status(F.col("issues"), F.col("conflict"), s).alias("status"), "file_size"))
    return parts[0].unionByName(parts[1]).groupBy("strategy", "status").agg(count_rows().alias("items"), F.sum("file_size").alias("bytes"))


@query("e13_plan_summary", _sql("SELECT count(*) AS items, count(*) FILTER (coalesce(file_status <> 'present', true)) AS missing, count(*) FILTER (len(issues) > 0) AS flagged, CAST(sum(len(issues)) AS BIGINT) AS issues, CAST(sum(file_size) AS BIGINT) AS bytes, (SELECT count(*) FROM (SELECT count(*) - 1 AS k FROM iss GROUP BY target) WHERE k > 0) AS shared_targets FROM iss", _CHECKED))
def e13(c: Catalog) -> DataFrame:
    x = organize.draft(plan_rows(c), _BLOCK, ROOT).select("file_size", "target", "issues")
    per = x.groupBy("target").agg(count_rows().alias("n"), F.count_if(F.exists("issues", lambda i: i["code"] == "source_missing")).alias("gone"), F.count_if(F.size("issues") > 0).alias("flagged"), F.sum(F.size("issues")).alias("issues"), F.sum("file_size").alias("bytes"))
    return per.agg(F.sum("n").alias("items"), F.sum("gone").alias("missing"), F.sum("flagged").alias("flagged"), F.sum("issues").alias("issues"), F.sum("bytes").alias("bytes"), F.count_if(F.col("n") > 1).alias("shared_targets"))


@query("e14_target_tree", _sql("SELECT directory, CAST(CASE WHEN directory = '' THEN 0 ELSE len(string_split(directory, '/')) END AS INTEGER) AS depth, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM (SELECT file_size, unnest(list_transform(range(0, len(string_split(target, '/'))), lambda i: array_to_string(string_split(target, '/')[1:i], '/'))) AS directory FROM pl WHERE target IS NOT NULL) GROUP BY ALL", _TARGET))
def e14(c: Catalog) -> DataFrame:
    return organize.target_tree(_plan(c).where("target is not null"), "target", "file_size")


# ---- P: scores. The squares of a vector, made to sum to 1, stand in for the probabilities of 64 scene leaves.

LEAVES = [f"leaf_{i:02d}" for i in range(64)]
GROUPS = {leaf: list(scoring.GROUP_CLUSTERS)[i % 10] for i, leaf in enumerate(LEAVES)}
SPECIAL = {leaf: cluster for every, cluster in ((19, "photo_plant"), (17, "photo_travel"), (13, "photo_food")) for leaf in LEAVES[::every]}
OF_LEAVES = [scoring.leaf_topic(leaf, GROUPS, SPECIAL) for leaf in LEAVES]
OUTDOOR = [i % 3 == 0 for i in range(64)]
_PROB = "pb AS (SELECT vec_id, label, list_transform(e, lambda x: round(x * x / list_sum(list_transform(e, lambda y: y * y)), 9)) AS p, list_transform(e[1:12], lambda x: round(abs(x) * 2, 6)) AS scores FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))"


def _scored(c: Catalog) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)
    return c.raw("embeddings").select("vec_id", "label", F.transform(e, lambda x: F.round(x * x / total, 9)).alias("probabilities"), F.transform(F.slice("embedding", 1, 12), lambda x: F.round(F.abs(x.cast("double")) * 2, 6)).alias("scores"))


def _list(names: list) -> str:
    return "[" + ", ".join("NULL" if n is None else f"'{n}'" for n in names) + "]"


_SUMS = f"sm AS (SELECT vec_id, list_transform({_list(TOPICS)}, lambda t: round(coalesce(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN {_list(OF_LEAVES)}[i] = t THEN p[i] END)), 0), 9)) AS sums FROM pb)"
_TOP = f"tp AS (SELECT vec_id, CASE WHEN -r[1].s >= 0.24 AND r[2].s - r[1].s >= 0.045 THEN {_list(TOPICS)}[r[1].i] END AS topic, CASE WHEN -r[1].s >= 0.24 AND r[2].s - r[1].s >= 0.045 THEN -r[1].s END AS score FROM (SELECT vec_id, list_sort(list_transform(range(1, 13), lambda i: {{s: -sums[i], i: i}})) AS r FROM sm))"


@query("e20_leaf_sums", f"WITH {_PROB}, {_SUMS} SELECT vec_id, unnest({_list(TOPICS)}) AS topic, unnest(sums) AS mass FROM sm")
def e20(c: Catalog) -> DataFrame:
    sums = F.transform(scoring.topic_sums(F.col("probabilities"), OF_LEAVES), lambda s: F.round(s, 9))
    return _scored(c).select("vec_id", F.explode(F.arrays_zip(F.array(*map(F.lit, TOPICS)).alias("topic"), sums.alias("mass"))).alias("x")).select("vec_id", "x.topic", "x.mass")


@query("p_scene_topic", f"WITH {_PROB}, {_SUMS}, {_TOP} SELECT vec_id, topic, score FROM tp")
def p_scene(c: Catalog) -> DataFrame:
    """Leaves to clusters to topics, summed; the best topic if it is enough and leads by enough."""
    sums = F.transform(scoring.topic_sums(F.col("probabilities"), OF_LEAVES), lambda s: F.round(s, 9))
    return _scored(c).select("vec_id", scoring.scene_topic(sums).alias("t")).select("vec_id", F.col("t.label").alias("topic"), "t.score")


_VOTE = "vt AS (SELECT vec_id, list_sum(list_transform(list_filter(t, lambda x: (x.i - 1) % 3 = 0), lambda x: x.v)) / list_sum(list_transform(t, lambda x: x.v)) AS share FROM (SELECT vec_id, list_transform(list_sort(list_transform(range(1, 65), lambda i: {m: -p[i], i: i}))[1:10], lambda q: {v: -q.m, i: q.i}) AS t FROM pb))"


@query("f07_indoor_vote", f"WITH {_PROB}, {_VOTE} SELECT vec_id, CASE WHEN coalesce(share, 0) >= 0.65 THEN 'outdoor' WHEN coalesce(share, 0) <= 0.35 THEN 'indoor' END AS vote FROM vt")
def f07(c: Catalog) -> DataFrame:
    """The ten strongest leaves vote; bands at .65 and .35."""
    return _scored(c).select("vec_id", scoring.surroundings(F.col("probabilities"), OUTDOOR)["label"].alias("vote"))


_EVIDENCE = f"ev AS (SELECT vec_id, list_transform(list_sort(list_concat(list_transform(range(1, 13), lambda i: {{s: -scores[i], l: {_list(TOPICS)}[i]}}), list_transform(range(1, 65), lambda i: {{s: -p[i], l: {_list(LEAVES)}[i]}})))[1:8], lambda x: {{l: x.l, s: -x.s}}) AS e FROM pb)"
_TEXT = "array_to_string(list_transform({0}, lambda x: x.l || '=' || CAST(CAST(round(x.s * 1000000) AS BIGINT) AS VARCHAR)), ' ')"


def _shown(evidence: Column | str) -> Column:
    return F.array_join(F.transform(evidence, lambda x: F.concat(x["label"], F.lit("="), F.round(x["score"] * 1000000).cast("bigint").cast("string"))), " ")


def _classified(c: Catalog) -> DataFrame:
    x = scoring.classified(_scored(c), OF_LEAVES, OUTDOOR, LEAVES)
    return x.withColumn("primary", F.when(F.col("primary").isNotNull(), F.struct(F.col("primary.label").alias("label"), F.round("primary.score", 9).alias("score"))))


@query("p_composite", f"WITH {_PROB}, {_SUMS}, {_TOP}, {_VOTE}, {_EVIDENCE} SELECT vec_id, topic, CASE WHEN coalesce(share, 0) >= 0.65 THEN 'outdoor' WHEN coalesce(share, 0) <= 0.35 THEN 'indoor' END AS surroundings, {_TEXT.format('e')} AS evidence FROM tp JOIN vt USING (vec_id) JOIN ev USING (vec_id)")
def p_composite(c: Catalog) -> DataFrame:
    """Topic, surroundings and the eight best of topic scores and leaves together."""
    return _classified(c).select("vec_id", F.col("primary.label").alias("topic"), F.col("surroundings.label").alias("surroundings"), _shown("evidence").alias("evidence"))


_CLASS = [0, 0, 0, 16, 2, 47, 58, 60]
_BOXES = f"bx AS (SELECT vec_id, {_CLASS}[(i - 1) % 8 + 1] AS k, round(abs(embedding[i]::DOUBLE) * 2, 6) AS s FROM embeddings, (SELECT unnest(range(1, 25)) AS i)), fc AS (SELECT vec_id, round(abs(embedding[41]::DOUBLE) * 3, 6) AS f FROM embeddings)"
_SUBJECTS = """ag AS (SELECT fc.vec_id, f, count(*) FILTER (k = 0 AND s >= 0.45) AS n, list(s ORDER BY s DESC) FILTER (k = 0 AND s >= 0.45) AS ps, max(s) FILTER (k BETWEEN 14 AND 23 AND s > 0) AS animal, max(s) FILTER (k BETWEEN 1 AND 8 AND s > 0) AS vehicle, max(s) FILTER ((k BETWEEN 39 AND 41 OR k BETWEEN 45 AND 55) AND s > 0) AS food, max(s) FILTER (k = 58 AND s > 0) AS plant FROM fc LEFT JOIN bx USING (vec_id) GROUP BY ALL),
sj AS (SELECT vec_id, u.l AS label, u.s AS score FROM (SELECT vec_id, unnest([{l: 'single_person', s: CASE WHEN n = 1 THEN greatest(ps[1], f) WHEN n = 0 AND f >= 0.65 THEN f END}, {l: 'multiple_people', s: CASE WHEN n > 1 THEN ps[2] END}, {l: 'animal', s: animal}, {l: 'vehicle', s: vehicle}, {l: 'food', s: food}, {l: 'plant', s: plant}]) AS u FROM ag) WHERE u.s IS NOT NULL)"""


def _subjects(c: Catalog) -> DataFrame:
    e = c.raw("embeddings")
    classes = F.array(*map(F.lit, _CLASS))
    boxes = e.select("vec_id", F.posexplode(F.slice("embedding", 1, 24)).alias("i", "v")).select("vec_id", F.element_at(classes, F.col("i") % 8 + 1).alias("class_id"), F.round(F.abs(F.col("v").cast("double")) * 2, 6).alias("score"))
    return scoring.subjects(boxes, e.select("vec_id", F.round(F.abs(F.get("embedding", F.lit(40)).cast("double")) * 3, 6).alias("score")), "vec_id")


@query("p_subjects", f"WITH {_BOXES}, {_SUBJECTS} SELECT vec_id, label, score FROM sj")
def p_subjects(c: Catalog) -> DataFrame:
    """One or several people, never both, a clear face without a body, and the best of each other class."""
    return _subjects(c).select("vec_id", "label", "score")


_MAP = "CASE label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SUBJECT_TOPICS.items()) + " END"


@query("p_fusion", f"WITH {_PROB}, {_SUMS}, {_TOP}, {_EVIDENCE}, {_BOXES}, {_SUBJECTS}, bs AS (SELECT vec_id, max(score) AS bs, arg_max({_MAP}, (score, label)) AS bt FROM sj GROUP BY ALL), fu AS (SELECT vec_id, topic, bs, bt, CASE WHEN bt IS NULL THEN e WHEN len(list_filter(e, lambda x: x.l = bt)) > 0 THEN list_transform(e, lambda x: {{l: x.l, s: CASE WHEN x.l = bt THEN greatest(x.s, bs) ELSE x.s END}}) ELSE list_append(e, {{l: bt, s: bs}}) END AS e FROM tp JOIN ev USING (vec_id) LEFT JOIN bs USING (vec_id)) SELECT vec_id, coalesce(bt, topic) AS topic, {_TEXT.format('list_transform(list_sort(list_transform(e, lambda x: {s: -x.s, l: x.l}))[1:8], lambda x: {l: x.l, s: -x.s})')} AS evidence FROM fu")
def p_fusion(c: Catalog) -> DataFrame:
    """The best mapped subject replaces the primary and raises or joins the evidence, of which the eight best stay."""
    x = scoring.fused(_classified(c), _subjects(c), "vec_id")
    return x.select("vec_id", F.col("primary.label").alias("topic"), _shown("evidence").alias("evidence"))


_GUESS = f"gs AS (SELECT vec_id, {_list(TOPICS)}[label % 12 + 1] AS truth, list_transform(list_sort(list_transform(range(1, 13), lambda i: {{s: -scores[i], i: i}})), lambda x: {{l: {_list(TOPICS)}[x.i], s: -x.s}}) AS r FROM pb), jd AS (SELECT CASE WHEN vec_id % 11 = 0 THEN ['unknown'] ELSE [truth] END AS expected, CASE WHEN r[1].s < 0.3 THEN ['unknown'] ELSE [r[1].l, r[2].l] END AS predicted, CASE WHEN vec_id % 17 = 0 THEN [] ELSE [r[1].l, r[2].l, r[3].l] END AS top FROM gs)"


def _judged(c: Catalog) -> DataFrame:
    r = scoring.ranked(F.col("scores"), TOPICS)
    x = _scored(c).select("vec_id", F.element_at(F.array(*map(F.lit, TOPICS)), F.col("label") % 12 + 1).alias("truth"), r.alias("r"))
    unknown, none = F.array(F.lit("unknown")), F.array().cast("array<string>")
    return x.select(
        F.when(F.col("vec_id") % 11 == 0, unknown).otherwise(F.array("truth")).alias("expected"), F.when(F.col("r")[0]["score"] < 0.3, unknown).otherwise(F.array(F.col("r")[0]["label"], F.col("r")[1]["label"])).alias("predicted"),
        F.when(F.col("vec_id") % 17 == 0, none).otherwise(F.transform(F.slice("r", 1, 3), lambda g: g["label"])).alias("top"),
    )


_PER = "pc AS (SELECT l AS label, count(*) FILTER (list_contains(expected, l)) AS expected, count(*) FILTER (list_contains(predicted, l)) AS predicted, count(*) FILTER (list_contains(expected, l) AND list_contains(predicted, l)) AS hits FROM (SELECT unnest(list_distinct(expected || predicted)) AS l, expected, predicted FROM jd) GROUP BY ALL)"


@query("e22_report", f"WITH {_PROB}, {_GUESS}, {_PER} SELECT *, hits / nullif(predicted, 0) AS precision, hits / nullif(expected, 0) AS recall FROM pc")
def e22(c: Catalog) -> DataFrame:
    return evaluate.classification_report(_judged(c))


@query("e22_confusion", f"WITH {_PROB}, {_GUESS} SELECT expected, predicted, count(*) AS n FROM (SELECT unnest(expected) AS expected, coalesce(top[1], 'inference_error') AS predicted FROM jd) GROUP BY ALL")
def e22_confusion(c: Catalog) -> DataFrame:
    return evaluate.confusion(_judged(c))


_K = "list_filter({0}, lambda x: x <> 'unknown')"
_TP = f"len(list_intersect({_K.format('expected')}, {_K.format('predicted')}))"


@query("e22_summary", f"WITH {_PROB}, {_GUESS}, {_PER} SELECT count(*) AS samples, round(count(*) FILTER (coalesce(list_contains(expected, top[1]), false)) / count(*), 9) AS top1, round(count(*) FILTER (list_has_any(expected, top)) / count(*), 9) AS top3, round(sum({_TP}) / sum(len({_K.format('predicted')})), 9) AS micro_precision, round(sum({_TP}) / sum(len({_K.format('expected')})), 9) AS micro_recall, round(count(*) FILTER (list_contains(predicted, 'unknown')) / count(*), 9) AS unknown_ratio, (SELECT round(avg(coalesce(hits / nullif(predicted, 0), 0)), 9) FROM pc WHERE label <> 'unknown' AND expected > 0) AS macro_precision, (SELECT round(avg(coalesce(hits / nullif(expected, 0), 0)), 9) FROM pc WHERE label <> 'unknown' AND expected > 0) AS macro_recall FROM jd")
def e22_summary(c: Catalog) -> DataFrame:
    x = evaluate.summary(_judged(c))
    return x.select("samples", *[F.round(n, 9).alias(n) for n in ("top1", "top3", "micro_precision", "micro_recall", "unknown_ratio", "macro_precision", "macro_recall")])


_TRUTH = f"tr AS (SELECT r[1].l AS label, r[1].s AS score, r[2].s AS second, r[1].l = truth AS correct, truth FROM gs), th AS (SELECT t AS label, h AS threshold, (SELECT count(*) FROM tr WHERE truth = t) AS positives FROM (SELECT unnest({_list(TOPICS)}) AS t, unnest({THRESHOLDS}::DOUBLE[]) AS h))"


@query("p_margins", f"WITH {_PROB}, {_GUESS}, {_TRUTH}, mg AS (SELECT unnest({evaluate.MARGINS}::DOUBLE[]) AS margin), ac AS (SELECT margin, label, count(*) AS n, count(*) FILTER (correct) AS k FROM tr JOIN th USING (label) JOIN mg ON score >= threshold AND score - second >= margin - 1e-12 GROUP BY ALL), sw AS (SELECT margin, CAST(coalesce(sum(n), 0) AS BIGINT) AS accepted, CAST(coalesce(sum(k), 0) AS BIGINT) AS hits, round(sum(k) / sum(n), 9) AS precision, round(coalesce(sum(k / greatest(positives, 1)), 0) / 12, 9) AS macro_recall, round(coalesce(sum(n), 0) / (SELECT count(*) FROM tr), 9) AS coverage FROM mg LEFT JOIN ac USING (margin) LEFT JOIN th USING (label) GROUP BY ALL) SELECT *, coalesce(margin = (SELECT arg_max(margin, (macro_recall, -margin)) FROM sw WHERE precision >= 0.08), false) AS recommended FROM sw")
def p_margins(c: Catalog) -> DataFrame:
    """Every margin of the sweep in one pass, with the one to recommend."""
    r = scoring.ranked(F.col("scores"), TOPICS)
    x = _scored(c).select(F.element_at(F.array(*map(F.lit, TOPICS)), F.col("label") % 12 + 1).alias("truth"), r.alias("r"))
    rows = x.select(F.col("r")[0]["label"].alias("label"), F.col("r")[0]["score"].alias("score"), F.col("r")[1]["score"].alias("second"), (F.col("r")[0]["label"] == F.col("truth")).alias("correct"), "truth")
    positives = rows.groupBy(F.col("truth").alias("label")).agg(count_rows().alias("positives"))
    known = c.spark.createDataFrame(list(zip(TOPICS, THRESHOLDS)), "label STRING, threshold DOUBLE").join(positives, "label", "left").withColumn("positives", F.coalesce("positives", F.lit(0)))
    sweep = evaluate.margin_sweep(rows, known, 0.08)
    return sweep.select("margin", "accepted", "hits", *[F.round(n, 9).alias(n) for n in ("precision", "macro_recall", "coverage")], "recommended")


@query("m13_detections", "SELECT vec_id, CASE WHEN best >= 0.2 THEN best END AS face FROM (SELECT vec_id, round(max(sqrt(greatest(a, 0) * greatest(b, 0))), 6) AS best FROM (SELECT vec_id, unnest(embedding[1:16])::DOUBLE AS a, unnest(embedding[17:32])::DOUBLE AS b FROM embeddings) GROUP BY ALL)")
def m13(c: Catalog) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    boxes = F.transform(F.arrays_zip(F.slice(e, 1, 16).alias("cls"), F.slice(e, 17, 16).alias("obj")), lambda b: b)
    return c.raw("embeddings").select("vec_id", F.round(scoring.detections(boxes, 0.0), 6).alias("best")).select("vec_id", F.when(F.col("best") >= 0.2, F.col("best")).alias("face"))
