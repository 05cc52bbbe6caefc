"""Hand-made examples of the catalogue operators, and all checked queries against DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalith.functions import colour, text, vector
from catalith.operators import classify, evaluate, organize
from catalith.plans import query as Q


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_hue_bins_and_strictness():
    assert [colour.hue_bins(*a) for a in ((0, 15), (45, 30), (-30, 15))] == [[0, 11], [0, 1, 2], [10, 11]]
    assert [round(colour.strictness_threshold(s), 9) for s in (None, 0, 1, 2)] == [0.415, 0.08, 0.75, 0.75]


def test_hue_range(spark):
    h = F.array(*[F.lit(x) for x in (0.5, 0.5, *[0.0] * 10)])
    assert [one(spark, Q.hue_range(h, 0, 15, s)) for s in (0, 0.5, 1)] == [True, True, False]
    assert one(spark, Q.hue_range(F.array(F.lit(0.0)), 0, 15, 0)) is False


def test_query_validation_and_paging():
    for bad in (Q.AssetQuery(version=1), Q.AssetQuery(root="source"), Q.AssetQuery(root="x"), Q.AssetQuery(sort="size")):
        with pytest.raises(ValueError):
            Q.validate(bad)
    assert [Q.paging(*x) for x in ((None, None), (0, 0), (3, 900))] == [(1, 120), (1, 1), (3, 500)]
    v = Q.from_v1({"collection_id": 4, "favorite_only": True, "library_id": 7})
    assert (v.root, v.root_id) == ("collection", 4)


def test_text(spark):
    assert one(spark, text.contains_nocase(F.lit("É_A%.JPG"), " _a% ")) and not one(spark, text.contains_nocase(F.lit("É"), "é"))
    assert one(spark, text.ancestors(F.lit("a/b/c.jpg"))) == ["a", "a/b"] and one(spark, text.ancestors(F.lit("c.jpg"))) == []
    assert one(spark, text.inside(F.lit("c:/photos-other"), F.lit("c:/photos"))) is False
    assert [one(spark, text.bad_segment(F.lit(s))) for s in ("ok", "CON.txt", "a:b", "a.", "x" * 256)] == [None, "reserved_name", "invalid_segment", "invalid_segment", "segment_too_long"]
    assert one(spark, text.csv_field(F.lit('a"b,c'))) == '"a""b,c"' and one(spark, text.csv_field(F.lit(None).cast("string"))) == ""
    assert one(spark, text.zero_padded(F.lit(12345), "000")) == "12345"
    assert one(spark, text.comparison_key(F.lit("C:\\Cafe\u0301\\"))) == "c:/caf\u00e9"


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, vector.cosine(a(1, 0), a(0, 0))) == -1 and one(spark, vector.cosine(a(1), a(1, 2))) == -1
    assert one(spark, vector.cosine_prefix(a(1, 0), a(0, 0))) == 0 and one(spark, vector.cosine_prefix(a(2), a(1, 9))) == 1
    assert one(spark, vector.strongest(a(1, -3, 3, 0.5, 2))) == [1, 2, 4, 0]
    assert math.isclose(sum(one(spark, vector.softmax(a(1000, 1000)))), 1) and one(spark, vector.sigmoid(F.lit(-800.0))) == 0


def test_classification(spark):
    tags, source = classify.resolve_tags(F.array(F.lit("portrait"), F.lit("outdoor")), F.array(F.lit("favorite"), F.lit("portrait")), F.array(F.lit("outdoor")))
    assert one(spark, tags) == ["favorite", "portrait"] and one(spark, source) == "mixed"
    effective, where = classify.resolve_single(F.lit("auto"), F.lit(None).cast("string"))
    assert (one(spark, effective), one(spark, where)) == ("auto", "auto")
    assert one(spark, classify.canonical(F.lit("photo_urban"))) == "photo_street"


def test_selection_and_metrics(spark):
    pick = lambda *s: one(spark, evaluate.select_primary(F.array(*map(F.lit, s)), F.array(F.lit(0.22), F.lit(0.18)), F.array(F.lit("p"), F.lit("l")), 0.035))
    assert (pick(0.30, 0.20), pick(0.30, 0.28), pick(0.10, 0.01)) == ("p", None, None)
    rows = spark.createDataFrame([(["a"], ["a"]), (["b"], [])], "expected ARRAY<STRING>, predicted ARRAY<STRING>")
    got = {r.label: (r.precision, r.recall) for r in evaluate.classification_report(rows).collect()}
    assert got == {"a": (1.0, 1.0), "b": (None, 0.0)}


def test_conflicts_probe_past_natural_names(spark):
    rows = spark.createDataFrame([(1, "d/a.jpg"), (2, "d/A.jpg"), (3, "d/a_0001.jpg"), (4, "d/a.jpg")], "id BIGINT, target STRING")
    assert {r.id: r.resolved for r in organize.resolve_conflicts(rows, "target", "id").collect()} == {1: "d/a.jpg", 2: "d/A_0002.jpg", 3: "d/a_0001.jpg", 4: "d/a_0003.jpg"}
    with pytest.raises(ValueError):
        organize.parse_template("{nope}")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else None if v is None else str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


CORE = sorted(n for n in entry.oracle_sql() if n not in {q for g in entry.GROUPS if ".llm" in g.__name__ for q in g.ORACLES})


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, duck, data, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(str([plain(v) for v in r]) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    expected = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert got == expected


def test_every_query_searches_all_rows(spark, monkeypatch):
    import math
    import random

    from catalith.functions import vector

    monkeypatch.setattr(vector, "QUERIES", 2, raising=False)
    monkeypatch.setattr(vector, "ROWS", 30, raising=False)
    r = random.Random(4)
    x = {i: [r.gauss(0, 1) for _ in range(8)] for i in range(1, 121)} | {140: None, 160: [0.0] * 8, 180: [1.0] * 3}
    x[41] = x[42] = x[40]  # ties
    cos = lambda a, b: round(sum(p * q for p, q in zip(a, b)) / math.sqrt(sum(p * p for p in a) * sum(q * q for q in b)), 6)
    expected = []
    for q in range(20, 121, 20):
        near = sorted((-cos(x[q], v), i) for i, v in x.items() if i != q and i <= 120)
        expected += [(q, i, -s) for s, i in near[:5] if -s >= 0.1]
    rows = spark.createDataFrame(list(x.items()), "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = vector.top_similar(rows, F.col("vec_id") % 20 == 0, 0.1, 5).collect()
    assert {(g.query_id, g.vec_id, g.similarity) for g in got} == set(expected) and len(got) == len(expected) > 10
    assert vector.top_similar(rows.limit(0), F.col("vec_id") % 20 == 0, 0.1, 5).count() == 0
