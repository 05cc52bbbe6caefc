"""Queries of state, strings, times, colours, vectors, scores and planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import colour as K
from .functions import text as T
from .functions import vector as V
from .operators import evaluate
from .operators.components import connected_components
from .operators.ranking import running
from .plans.catalog import CANONICAL, SUBJECT_TOPICS, THRESHOLDS, TOPICS, Catalog, with_tables
from .registry import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def count_rows() -> Column:
    return F.count(F.lit(1))


# ---- J: state. Old and new generation of an asset are its current row and the row before.

_GENERATIONS = "SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY last_seen_scan DESC) AS g FROM (SELECT DISTINCT id, last_seen_scan, fingerprint, file_size, rating, semantic_status, classification_revision FROM assets WHERE id IS NOT NULL)"


def _generations(c: Catalog) -> DataFrame:
    rows = c.raw("assets").where("id is not null").select("id", "last_seen_scan", "fingerprint", "file_size", "rating", "semantic_status", "classification_revision").distinct()
    return rows.withColumn("g", F.dense_rank().over(Window.partitionBy("id").orderBy(F.desc("last_seen_scan"))))


@query("j01_upsert", f"WITH x AS ({_GENERATIONS}) SELECT n.id, n.fingerprint, CASE WHEN o.id IS NOT NULL AND o.fp <> coalesce(n.fingerprint, '') THEN 'not_analyzed' ELSE coalesce(o.st, n.semantic_status) END AS semantic_status, CASE WHEN o.id IS NOT NULL AND o.fp <> coalesce(n.fingerprint, '') THEN o.rev + 1 ELSE coalesce(o.rev, n.classification_revision) END AS revision FROM x n LEFT JOIN (SELECT id, max(coalesce(fingerprint, '')) AS fp, max(semantic_status) AS st, max(classification_revision) AS rev FROM x WHERE g = 2 GROUP BY id) o ON o.id = n.id WHERE n.g = 1")
def j01(c: Catalog) -> DataFrame:
    """Upsert of a generation: a changed fingerprint resets the analysis and raises the revision, else both are kept."""
    x = _generations(c)
    old = x.where("g = 2").groupBy("id").agg(F.max(F.coalesce("fingerprint", F.lit(""))).alias("fp"), F.max("semantic_status").alias("st"), F.max("classification_revision").alias("rev"))
    j = x.where("g = 1").join(old, "id", "left")
    changed = F.col("fp").isNotNull() & (F.col("fp") != F.coalesce("fingerprint", F.lit("")))
    return j.select("id", "fingerprint", F.when(changed, "not_analyzed").otherwise(F.coalesce("st", "semantic_status")).alias("semantic_status"), F.when(changed, F.col("rev") + 1).otherwise(F.coalesce("rev", "classification_revision")).alias("revision"))


@query("j05_mark_missing", with_tables("SELECT a.library_id, count(*) AS seen, count(*) FILTER (l.id IS NULL OR a.last_seen_scan < l.scan_generation) AS missing FROM now_assets a LEFT JOIN now_libraries l ON l.id = a.library_id GROUP BY ALL", "now_assets", "now_libraries"))
def j05(c: Catalog) -> DataFrame:
    """Closing a scan: assets whose last scan is older than the library's generation are missing."""
    gen = c.now_libraries.select(F.col("id").alias("library_id"), "scan_generation")
    x = c.now_assets.select("library_id", "last_seen_scan").join(gen, "library_id", "left")
    return x.groupBy("library_id").agg(count_rows().alias("seen"), F.count_if(F.col("scan_generation").isNull() | (F.col("last_seen_scan") < F.col("scan_generation"))).alias("missing"))


_LATEST_EVENT = "(SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY ALL)"


@query("j16_recovery", f"SELECT user_id, CASE status WHEN 'click' THEN 'interrupted' WHEN 'view' THEN 'cancelled' ELSE status END AS status, events FROM {_LATEST_EVENT}")
def j16(c: Catalog) -> DataFrame:
    """Status log to latest status, with what a restart makes of the open ones (click stands for running, view for cancelling)."""
    last = c.raw("events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("s"), count_rows().alias("events"))
    return last.select("user_id", F.when(F.col("s") == "click", "interrupted").when(F.col("s") == "view", "cancelled").otherwise(F.col("s")).alias("status"), "events")


@query("j17_favorite_mirror", with_tables("SELECT a.id, a.is_favorite, m.asset_id IS NOT NULL AS member FROM now_assets a LEFT JOIN (SELECT * FROM members WHERE collection_id = 1) m ON m.asset_id = a.id WHERE coalesce(a.is_favorite, false) <> (m.asset_id IS NOT NULL)", "now_assets", "members"))
def j17(c: Catalog) -> DataFrame:
    """Assets whose favourite mark disagrees with their membership."""
    fav = c.members.where("collection_id = 1").select(F.col("asset_id").alias("id"), F.lit(True).alias("m"))
    x = c.now_assets.select("id", "is_favorite").join(fav, "id", "left").withColumn("member", F.coalesce("m", F.lit(False)))
    return x.where(F.coalesce("is_favorite", F.lit(False)) != F.col("member")).select("id", "is_favorite", "member")


# ---- K: strings


@query("k02_paths", "SELECT DISTINCT relative_path, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS directory, regexp_replace(file_name, '\\.[^.]*$', '') AS stem, CAST(len(list_filter(string_split(regexp_extract(relative_path, '^(.*)/[^/]*$', 1), '/'), lambda x: x <> '')) AS INTEGER) AS levels FROM assets")
def k02(c: Catalog) -> DataFrame:
    return c.raw("assets").select("relative_path", T.parent_path("relative_path").alias("directory"), T.stem("file_name").alias("stem"), F.size(T.ancestors("relative_path")).alias("levels")).distinct()


@query("k03_containment", "SELECT a.id AS id, count(*) AS holders FROM (SELECT DISTINCT id, source_identity_key AS k FROM libraries) a JOIN (SELECT DISTINCT source_identity_key AS k FROM libraries) r ON a.k = r.k OR starts_with(a.k, r.k || '/') GROUP BY a.id")
def k03(c: Catalog) -> DataFrame:
    """How many roots hold each library's root, by components of the path."""
    rows = c.raw("libraries").select("id", F.col("source_identity_key").alias("k")).distinct()
    up = rows.select("id", F.explode(F.concat(T.ancestors("k"), F.array("k"))).alias("r"))
    return up.join(rows.select(F.col("k").alias("r")).distinct(), "r").groupBy("id").agg(count_rows().alias("holders"))


@query("k04_comparison_key", "SELECT DISTINCT id, rtrim(replace(lower(nfc_normalize(source_path)), '\\', '/'), '/') AS key FROM libraries")
def k04(c: Catalog) -> DataFrame:
    return c.raw("libraries").select("id", "source_path").distinct().select("id", T.comparison_key("source_path").alias("key")).distinct()


@query("k08_segments", "SELECT DISTINCT id, CASE WHEN regexp_matches(name, '[<>:\"/\\\\|?*\\x00-\\x1f]') OR regexp_matches(name, '[ .]$') OR name = '' THEN 'invalid_segment' END AS issue FROM libraries WHERE name IS NOT NULL")
def k08(c: Catalog) -> DataFrame:
    return c.raw("libraries").where("name is not null").select("id", T.bad_segment("name").alias("issue")).distinct()


@query("k10_short_hash", with_tables("SELECT id, lower(trim(fingerprint))[:8] AS short_hash FROM now_assets", "now_assets"))
def k10(c: Catalog) -> DataFrame:
    return c.now_assets.select("id", F.substring(F.lower(F.trim("fingerprint")), 1, 8).alias("short_hash"))


_WORDS = "q"
for _from, _to in T.QUERY_WORDS:
    _WORDS = f"replace({_WORDS}, '{_from}', '{_to}')"


@query("k11_query_words", f"SELECT doc_id, {_WORDS} AS normalised FROM (SELECT doc_id, text AS q FROM documents WHERE text IS NOT NULL)")
def k11(c: Catalog) -> DataFrame:
    """Ordered replacement of words in search texts, here in all documents."""
    return c.raw("documents").where("text is not null").select("doc_id", T.query_words(F.col("text")).alias("normalised"))


# ---- L: times


@query("l02_exif", "SELECT DISTINCT capture_time, regexp_replace(capture_time, '^([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9:]{8})$', '\\1-\\2-\\3T\\4') AS iso FROM assets WHERE regexp_matches(capture_time, '^[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9:]{8}$')")
def l02(c: Catalog) -> DataFrame:
    return c.raw("assets").where(F.col("capture_time").rlike(r"^\d{4}:\d{2}:\d{2} [0-9:]{8}$")).select("capture_time", F.regexp_replace("capture_time", r"^(\d{4}):(\d{2}):(\d{2}) ([0-9:]{8})$", "$1-$2-$3T$4").alias("iso")).distinct()


@query("l05_dimensions", "SELECT first_seen_at[:4] AS year, first_seen_at[6:7] AS month, count(*) AS n FROM assets GROUP BY ALL")
def l05(c: Catalog) -> DataFrame:
    ts = F.try_to_timestamp("first_seen_at", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))
    return c.raw("assets").groupBy(F.date_format(ts, "yyyy").alias("year"), F.date_format(ts, "MM").alias("month")).agg(count_rows().alias("n"))


@query("l06_epoch", "SELECT DISTINCT id, modified_at, strftime(make_timestamp(modified_at * 1000), '%Y-%m-%d %H:%M:%S') AS utc FROM assets WHERE modified_at IS NOT NULL")
def l06(c: Catalog) -> DataFrame:
    return c.raw("assets").where("modified_at is not null").select("id", "modified_at", F.date_format(F.timestamp_millis("modified_at"), "yyyy-MM-dd HH:mm:ss").alias("utc")).distinct()


# ---- M: vectors and colours

_RGB = "(SELECT DISTINCT dominant_color_rgb AS rgb, ('0x' || dominant_color_rgb[2:3])::INT / 255.0::DOUBLE AS r, ('0x' || dominant_color_rgb[4:5])::INT / 255.0::DOUBLE AS g, ('0x' || dominant_color_rgb[6:7])::INT / 255.0::DOUBLE AS b FROM color_features WHERE dominant_color_rgb IS NOT NULL)"


def _lin(c: str) -> str:
    return f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


def _rgb(c: Catalog) -> DataFrame:
    r, g, b = K.channels(F.col("rgb"))
    return c.raw("color_features").where("dominant_color_rgb is not null").select(F.col("dominant_color_rgb").alias("rgb")).distinct().withColumns({"r": r, "g": g, "b": b})


@query("m01_cosine", "SELECT a.vec_id, round(CASE WHEN len(a.embedding) <> len(q.embedding) THEN -1 ELSE list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) END, 6) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def m01(c: Catalog) -> DataFrame:
    e = c.raw("embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query("m03_strongest", "SELECT vec_id, list_aggregate(list_transform(list_sort(list_transform(range(0, 64), lambda i: {m: -abs(embedding[i + 1]), i: i}))[1:4], lambda p: p.i), 'string_agg', ',') AS dims FROM embeddings")
def m03(c: Catalog) -> DataFrame:
    return c.raw("embeddings").select("vec_id", F.array_join(F.transform(V.strongest(F.col("embedding")), lambda i: i.cast("string")), ",").alias("dims"))


@query("m04_softmax", "SELECT vec_id, round(list_sum(list_transform(e[1:4], lambda x: exp(x - list_max(e)))) / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS first_four, round(1 / (1 + exp(-e[1])), 6) AS sigmoid FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def m04(c: Catalog) -> DataFrame:
    e = c.raw("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).withColumn("s", V.softmax(F.col("e")))
    return e.select("vec_id", F.round(F.aggregate(F.slice("s", 1, 4), F.lit(0.0), lambda a, x: a + x), 6).alias("first_four"), F.round(V.sigmoid(F.col("e")[0]), 6).alias("sigmoid"))


@query("m05_oklab", f"SELECT rgb, round(0.2104542553 * l + 0.7936177850 * m - 0.0040720468 * s, 6) AS lightness, round(sqrt(pow(1.9779984951 * l - 2.4285922050 * m + 0.4505937099 * s, 2) + pow(0.0259040371 * l + 0.7827717662 * m - 0.8086757660 * s, 2)), 6) AS chroma FROM (SELECT rgb, cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b) AS l, cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b) AS m, cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b) AS s FROM (SELECT rgb, {_lin('r')} AS r, {_lin('g')} AS g, {_lin('b')} AS b FROM {_RGB}))")
def m05(c: Catalog) -> DataFrame:
    x = _rgb(c)
    light, a, b = K.oklab(F.col("r"), F.col("g"), F.col("b"))
    return x.select("rgb", F.round(light, 6).alias("lightness"), F.round(K.chroma(a, b), 6).alias("chroma"))


@query("m06_hsv", f"SELECT rgb, round(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END, 6) AS saturation, round(0.2126 * r + 0.7152 * g + 0.0722 * b, 6) AS luma FROM {_RGB}")
def m06(c: Catalog) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return _rgb(c).select("rgb", F.round(K.hsv_saturation(r, g, b), 6).alias("saturation"), F.round(K.luma(r, g, b), 6).alias("luma"))


_LMS = f"SELECT rgb, r, g, b, greatest(r, g, b) AS mx, least(r, g, b) AS mn, cbrt(0.4122214708 * {_lin('r')} + 0.5363325363 * {_lin('g')} + 0.0514459929 * {_lin('b')}) AS l, cbrt(0.2119034982 * {_lin('r')} + 0.6806995451 * {_lin('g')} + 0.1073969566 * {_lin('b')}) AS m, cbrt(0.0883024619 * {_lin('r')} + 0.2817188376 * {_lin('g')} + 0.6299787005 * {_lin('b')}) AS s FROM {_RGB}"
_LCH = f"SELECT rgb, 0.2104542553 * l + 0.7936177850 * m - 0.0040720468 * s AS light, sqrt(pow(1.9779984951 * l - 2.4285922050 * m + 0.4505937099 * s, 2) + pow(0.0259040371 * l + 0.7827717662 * m - 0.8086757660 * s, 2)) AS chroma, CASE WHEN mx = mn THEN 0 WHEN mx = r THEN (60 * (g - b) / (mx - mn) + 360) % 360 WHEN mx = g THEN 60 * ((b - r) / (mx - mn) + 2) ELSE 60 * ((r - g) / (mx - mn) + 4) END AS h FROM ({_LMS})"


@query("m07_category", f"SELECT rgb, CASE WHEN chroma < CASE WHEN light < 0.12 THEN 0.025 WHEN light > 0.96 THEN 0.012 ELSE 0.0085 END THEN 'neutral' WHEN h < 15 OR h >= 315 THEN 'red' WHEN h < 45 THEN 'orange' WHEN h < 70 THEN 'yellow' WHEN h < 165 THEN 'green' WHEN h < 195 THEN 'cyan' WHEN h < 255 THEN 'blue' ELSE 'purple' END AS category FROM ({_LCH})")
def m07(c: Catalog) -> DataFrame:
    """Colour category of each dominant colour: accent test on OKLab chroma, then bands of hue."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    light, x, y = K.oklab(r, g, b)
    return _rgb(c).select("rgb", K.category(K.hue(r, g, b), K.accent(light, K.chroma(x, y))).alias("category"))


@query("m09_labels", with_tables("SELECT t.asset_id, CASE WHEN brightness < 0.36 THEN 'low_key' WHEN brightness > 0.68 THEN 'high_key' ELSE 'mid_tone' END AS tone, CASE WHEN brightness < 0.30 THEN 'underexposed' WHEN brightness > 0.74 THEN 'overexposed' ELSE 'balanced' END AS exposure, CASE WHEN saturation < 0.16 THEN 'low' WHEN saturation > 0.52 THEN 'high' ELSE 'medium' END AS saturation_level FROM tone t JOIN colour c ON c.asset_id = t.asset_id", "tone", "colour"))
def m09(c: Catalog) -> DataFrame:
    return c.tone.join(c.colour, "asset_id").select("asset_id", K.tone_label(F.col("brightness")).alias("tone"), K.exposure_label(F.col("brightness")).alias("exposure"), K.saturation_label(F.col("saturation")).alias("saturation_level"))


# ---- O: similarity


def _near(query_id: int, least: float, k: int) -> str:
    dot = "list_dot_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])"
    return f"SELECT vec_id, similarity FROM (SELECT a.vec_id, round({dot.format('a', 'q')} / sqrt({dot.format('a', 'a')} * {dot.format('q', 'q')}), 6) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = {query_id}) q WHERE a.vec_id <> {query_id}) WHERE similarity >= {least} ORDER BY similarity DESC, vec_id LIMIT {k}"


def _similar(c: Catalog, query_id: int, least: float = 0.7, k: int = 24, lowest: float = 0.0) -> DataFrame:
    """Records most similar to one, itself left out; ValueError outside lowest..1 or for no result wanted, LookupError without its vector."""
    if not (lowest <= least <= 1.0 and k >= 1):
        raise ValueError("similarity or number of results out of range")
    e = c.raw("embeddings")
    found = e.where((F.col("vec_id") == query_id) & F.col("embedding").isNotNull()).select(F.col("embedding").alias("q")).limit(1).collect()
    if not found:
        raise LookupError(f"no embedding for {query_id}")
    q = c.spark.createDataFrame(found, "q ARRAY<FLOAT>")  # one row
    s = e.where(F.col("vec_id") != query_id).crossJoin(F.broadcast(q)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return s.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "vec_id").limit(k)


@query("o01_text_search", _near(3, 0.05, 80))
def o01(c: Catalog) -> DataFrame:
    """Search by a query vector (here that of record 3): one row is broadcast, the top k is kept per task."""
    return _similar(c, 3, 0.05, 80, lowest=-1.0)


@query("o02_similar_to", _near(11, 0.7, 24).replace(">= 0.7", ">= 0.1"))
def o02(c: Catalog) -> DataFrame:
    return _similar(c, 11, 0.1, 24)


def _near_all(least: float, k: int) -> str:
    dot = "list_dot_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])"
    pairs = f"SELECT q.vec_id AS query_id, a.vec_id, round({dot.format('a', 'q')} / sqrt({dot.format('a', 'a')} * {dot.format('q', 'q')}), 6) AS similarity FROM embeddings a JOIN embeddings q ON q.vec_id % 20 = 0 AND a.vec_id <> q.vec_id"
    return f"SELECT query_id, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM ({pairs}) WHERE similarity >= {least}) WHERE place <= {k}"


@query("o01_text_search_all", _near_all(0.05, 80))
def o01_all(c: Catalog) -> DataFrame:
    """The search of o01 for every record with an id divisible by 20."""
    return V.top_similar(c.raw("embeddings"), F.col("vec_id") % 20 == 0, 0.05, 80)


@query("o02_similar_to_all", _near_all(0.1, 24))
def o02_all(c: Catalog) -> DataFrame:
    return V.top_similar(c.raw("embeddings"), F.col("vec_id") % 20 == 0, 0.1, 24)


_BUCKETS = "(SELECT vec_id, d || CASE WHEN embedding[d + 1] < 0 THEN '-' ELSE '+' END AS bucket, row_number() OVER (PARTITION BY d, embedding[d + 1] < 0 ORDER BY abs(embedding[d + 1]) DESC, vec_id) AS place FROM (SELECT vec_id, embedding, unnest(list_transform(list_sort(list_transform(range(0, 64), lambda i: {m: -abs(embedding[i + 1]), i: i}))[1:4], lambda p: p.i)) AS d FROM embeddings))"


@query("o03_candidates", f"SELECT DISTINCT least(x.vec_id, y.vec_id) AS a, greatest(x.vec_id, y.vec_id) AS b FROM {_BUCKETS} x JOIN {_BUCKETS} y ON x.bucket = y.bucket AND y.place BETWEEN x.place + 1 AND x.place + 96")
def o03(c: Catalog) -> DataFrame:
    return _candidates(c).select("a", "b")


def _candidates(c: Catalog) -> DataFrame:
    """Neighbours within 96 places in a bucket of strongest dimension and sign.

    The band becomes an equi-join: places are cut into blocks of 96, and a row meets its own block and the next one.
    """
    e = c.raw("embeddings").select("vec_id", "embedding", F.explode(V.strongest(F.col("embedding"))).alias("d"))
    value = F.get("embedding", F.col("d"))
    x = e.select("vec_id", F.concat(F.col("d").cast("string"), F.when(value < 0, "-").otherwise("+")).alias("bucket"), F.abs(value).alias("m"))
    x = running(x, ["bucket"], [F.desc("m"), F.col("vec_id")], place=F.lit(1))  # at most twice as many buckets as dimensions: ranked over all tasks
    block = F.floor(F.col("place") / 96)
    left = x.select(F.col("vec_id").alias("l"), "bucket", F.col("place").alias("lp"), F.explode(F.array(block, block + 1)).alias("block"))
    right = x.select(F.col("vec_id").alias("r"), "bucket", F.col("place").alias("rp"), block.alias("block"))
    pairs = left.join(right, ["bucket", "block"]).where("rp between lp + 1 and lp + 96")
    return pairs.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct()


_DOT = "list_dot_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])"
_EDGES = f"WITH RECURSIVE c AS (SELECT DISTINCT least(x.vec_id, y.vec_id) AS a, greatest(x.vec_id, y.vec_id) AS b FROM {_BUCKETS} x JOIN {_BUCKETS} y ON x.bucket = y.bucket AND y.place BETWEEN x.place + 1 AND x.place + 96), e AS (SELECT a, b FROM c JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b WHERE {_DOT.format('x', 'y')} / sqrt({_DOT.format('x', 'x')} * {_DOT.format('y', 'y')}) >= 0.35)"


@query("o05_components", f"{_EDGES}, two AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS top FROM two UNION SELECT two.b, r.top FROM r JOIN two ON two.a = r.node) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM (SELECT node, min(top) AS component FROM r GROUP BY node)")
def o05(c: Catalog) -> DataFrame:
    """Candidate pairs above a similarity, joined to components, with their sizes."""
    e = c.raw("embeddings")
    pairs = _candidates(c).join(e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
    edges = pairs.where(V.cosine(F.col("x"), F.col("y")) >= 0.35).select("a", "b")
    return connected_components(edges).withColumn("size", count_rows().over(Window.partitionBy("component")))


# ---- P: scores

_SCORES = "(SELECT vec_id, list_transform(embedding[1:12], lambda x: round(abs(x::DOUBLE) * 2, 6)) AS scores, label FROM embeddings)"


def _scores(c: Catalog) -> DataFrame:
    return c.raw("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: F.round(F.abs(x.cast("double")) * 2, 6)).alias("scores"), "label")


_BEST = f"(SELECT vec_id, label, scores, list_sort(list_transform(range(0, 12), lambda i: {{s: -scores[i + 1], i: i}})) AS r FROM {_SCORES})"
_NAMES = "['" + "', '".join(TOPICS) + "']"


@query("p_select_primary", f"SELECT vec_id, CASE WHEN -r[1].s >= {THRESHOLDS}[r[1].i + 1] AND r[2].s - r[1].s >= 0.035 - 1e-12 THEN {_NAMES}[r[1].i + 1] END AS topic FROM {_BEST}")
def p_select(c: Catalog) -> DataFrame:
    topic = evaluate.select_primary(F.col("scores"), F.array(*map(F.lit, THRESHOLDS)), F.array(*map(F.lit, TOPICS)), 0.035)
    return _scores(c).select("vec_id", topic.alias("topic"))


@query("f06_top_scores", f"SELECT vec_id, list_aggregate(list_transform(r[1:8], lambda x: {_NAMES}[x.i + 1]), 'string_agg', ',') AS topics FROM {_BEST}")
def f06(c: Catalog) -> DataFrame:
    ranked = F.array_sort(F.transform("scores", lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    names = F.array(*map(F.lit, TOPICS))
    return _scores(c).select("vec_id", F.array_join(F.transform(F.slice(ranked, 1, 8), lambda x: F.element_at(names, x["i"] + 1)), ",").alias("topics"))


_JUDGED = f"(SELECT {_NAMES}[r[1].i + 1] AS label, -r[1].s AS score, r[1].i % 3 = label % 3 AS correct FROM {_BEST})"


def _judged(c: Catalog) -> DataFrame:
    ranked = F.array_sort(F.transform("scores", lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    x = _scores(c).withColumn("r", ranked)
    return x.select(F.element_at(F.array(*map(F.lit, TOPICS)), F.col("r")[0]["i"] + 1).alias("label"), (-F.col("r")[0]["s"]).alias("score"), ((F.col("r")[0]["i"] % 3) == (F.col("label") % 3)).alias("correct"))


@query("p_thresholds", f"SELECT label, threshold, accepted, hits FROM (SELECT label, score AS threshold, accepted, hits, row_number() OVER (PARTITION BY label ORDER BY hits DESC, score) AS k FROM (SELECT label, score, CAST(sum(n) OVER (PARTITION BY label ORDER BY score DESC) AS BIGINT) AS accepted, CAST(sum(k) OVER (PARTITION BY label ORDER BY score DESC) AS BIGINT) AS hits, sum(k) OVER (PARTITION BY label) AS a FROM (SELECT label, score, count(*) AS n, count(*) FILTER (correct) AS k FROM {_JUDGED} GROUP BY ALL)) WHERE a >= 8 AND hits >= 0.35 * accepted) WHERE k = 1")
def p_thresholds(c: Catalog) -> DataFrame:
    return evaluate.recommended_thresholds(_judged(c), target_precision=0.35)


# ---- Q: digests of snapshots


CHUNK = 10_000  #: items that one digest is taken over; the digests of the chunks are digested in turn

_ITEMS = f"SELECT library_id, k // {CHUNK} AS chunk, sha256(string_agg(id || ':' || coalesce(fingerprint, '') || ';', '' ORDER BY id)) AS part FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY id) - 1 AS k FROM now_assets) GROUP BY ALL"


@query("q08_snapshot_digest", with_tables(f"SELECT library_id, sha256(string_agg(part, '' ORDER BY chunk)) AS digest FROM ({_ITEMS}) GROUP BY ALL", "now_assets"))
def q08(c: Catalog) -> DataFrame:
    """Digest of the ordered id:fingerprint; list of each library, by chunks, so that no library is one text."""
    rows = running(c.now_assets.select("library_id", "id", "fingerprint"), ["library_id"], [F.col("id")], place=F.lit(1))
    item = F.struct("id", F.concat(F.col("id").cast("string"), F.lit(":"), F.coalesce("fingerprint", F.lit("")), F.lit(";")).alias("t"))
    digest = lambda rows, of: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda i: i[of]), ""), 256)
    parts = rows.groupBy("library_id", F.floor((F.col("place") - 1) / CHUNK).alias("chunk")).agg(digest(item, "t").alias("part"))
    return parts.groupBy("library_id").agg(digest(F.struct("chunk", "part"), "part").alias("digest"))


# ---- S: streams


@query("s02_stream_batches")
def s02(c: Catalog) -> DataFrame:
    """Event files as a stream, folded batch by batch into the latest status per user; replaying a batch changes nothing."""
    from .session import fresh_path
    from .streaming.ingest import apply_batches, snapshots

    spark, out, inbox = c.spark, fresh_path(c.spark, "stream"), fresh_path(c.spark, "inbox")
    events = c.raw("events")
    events.repartition(4, "user_id").write.parquet(inbox)

    def apply(batch: DataFrame, number: int) -> None:
        batch.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    apply_batches(snapshots(spark, inbox, events.schema, 1), apply, fresh_path(spark, "progress")).awaitTermination()
    done = spark.read.parquet(out).groupBy("user_id").agg(F.max("x").alias("x"))
    return done.select("user_id", "x.event_id", "x.event_type")


ORACLES["s02_stream_batches"] = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"


@query("o06_complete_link")
def o06(c: Catalog) -> DataFrame:
    """Components of similar records split into groups of mutually similar ones, greatest first."""
    from .operators.grouping import complete_link

    e = c.raw("embeddings")
    pairs = _candidates(c).join(e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
    parts = connected_components(pairs.where(V.cosine(F.col("x"), F.col("y")) >= 0.35).select("a", "b"))
    rows = parts.join(e.select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector")), "node").select("component", F.col("node").alias("id"), "vector")
    return complete_link(rows, 0.35)


@query("m10_palette")
def m10(c: Catalog) -> DataFrame:
    """Palettes of pictures whose pixels are the dominant colours of 4096 neighbouring assets."""
    from .operators.palette import palettes

    rgb = F.conv(F.substring("dominant_color_rgb", 2, 6), 16, 10).cast("int")
    x = c.raw("color_features").where("dominant_color_rgb is not null").select("asset_id", F.floor(F.col("asset_id") / 4096).alias("id"), rgb.alias("p")).distinct()
    return palettes(x.groupBy("id").agg(F.collect_list("p").alias("pixels")))
