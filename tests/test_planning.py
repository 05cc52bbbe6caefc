"""Ranks, planning, state and plug-ins against plain Python on small fixtures, and at their edges."""

import random

import pytest
from pyspark.sql import functions as F

from catalith.operators import evaluate, organize, plugin, scoring, state
from catalith.operators.organize import Rules
from catalith.operators.ranking import nearest_rank, numbered, running


def test_running_sums_and_ranks(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), i, r.randrange(5), "clash") for i in range(400)]
    df = spark.createDataFrame(rows, "k STRING, i INT, v INT, _p STRING").repartition(7)
    got = {x.i: (x.at, x.upto) for x in running(df.drop("_p"), ["k"], [F.col("i").desc()], at=F.lit(1), upto=F.col("v")).collect()}
    for k in ("a", "b", None, "hot"):
        total = 0
        for n, (_, i, v, _) in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: -x[1])):
            total += v
            assert got[i] == (n + 1, total)
    assert [x.n for x in numbered(df.select("i"), [F.col("i")], "n").orderBy("i").collect()] == list(range(1, 401))
    assert running(df.limit(0).drop("_p"), ["k"], [F.col("i")], at=F.lit(1)).count() == 0
    ranks = {x.k: (x.n, x.mid) for x in nearest_rank(df, "k", "v", {"mid": F.ceil((F.col("n") - 1) * 0.5)}).collect()}
    for k in ("a", "b", None, "hot"):
        values = sorted(x[2] for x in rows if x[0] == k)
        assert ranks[k] == (len(values), values[-(-(len(values) - 1) // 2)])


def by_hand(targets, existing, strategy, start, width):
    """Targets in order; suffixes skip natural names and existing files."""
    low = [t.lower() for t in targets]
    there, held, given, out = {e.lower() for e in existing}, set(), {}, []
    for t, key in zip(targets, low):
        if key not in there and key not in held:
            held.add(key)
            out.append((t, None))
            continue
        why = "existing_target" if key in there else "duplicate_target"
        stem, dot, ext = t.rpartition(".")
        if strategy == "skip":
            out.append((t, why))
        elif strategy == "short_hash":
            out.append((f"{stem}_abcd1234.{ext}", why))
        else:
            n = given.get(key, start)
            while f"{stem}_{n:0{width}d}.{ext}".lower() in there | set(low):
                n += 1
            given[key] = n + 1
            out.append((f"{stem}_{n:0{width}d}.{ext}", why))
    return out


@pytest.mark.parametrize("strategy", organize.STRATEGIES)
@pytest.mark.parametrize(("start", "width"), [(1, 2), (8, 1)])
def test_conflicts_by_hand(spark, strategy, start, width):
    r = random.Random(start)
    names = ["x/A.jpg", "x/a.JPG", "x/b.png", "x/b_03.png", "x/a_02.jpg", "x/a_9.jpg", "x/a_12.jpg", "y/a.jpg"]
    targets = [r.choice(names) for _ in range(80)]
    existing = ["X/B.png", "x/a_01.jpg", "x/a_11.jpg", "x/none.jpg"]
    rows = spark.createDataFrame([(i, t, "abcd1234", "clash") for i, t in enumerate(targets)] + [(900, None, None, None)], "at INT, target STRING, short_hash STRING, place STRING")
    there = spark.createDataFrame([(e,) for e in existing] + [(None,)], "target STRING")
    got = organize.resolve_conflicts(rows, "target", "at", strategy, there, start, width)
    assert [(x.resolved, x.conflict) for x in got.orderBy("at").collect()] == [*by_hand(targets, existing, strategy, start, width), (None, None)]
    assert organize.resolve_conflicts(rows.limit(0), "target", "at", strategy).count() == 0


ASSET = "ordinal INT, relative_path STRING, file_name STRING, extension STRING, capture_time STRING, captured TIMESTAMP, modified_at BIGINT, camera_make STRING, camera_model STRING, lens_model STRING, semantic STRING, tone STRING, dominant_color STRING, saturation STRING, fingerprint STRING, file_status STRING"


def test_drafts_of_empty_and_bad_values(spark):
    full = (1, "a\\b/IMG.1.JPG", "IMG.1.JPG", "jpg", "2020-03-04", None, 1_600_000_000_000, "Make", None, None, "street", " ", None, "low", "0123456789", "present")
    bare = (2, None, None, None, None, None, None, *[None] * 9)
    df = spark.createDataFrame([full, bare], ASSET)
    x = organize.draft(df, Rules("{original_stem}_{camera}_{tone}_{sequence:000}", [("original_directory", "skip"), ("year", "modification_time"), ("saturation", "unknown")]), "/root").orderBy("ordinal").collect()
    assert x[0].target == "a/b/2020/low/IMG.1_Make_unknown_001.jpg" and x[0].valid and [i.code for i in x[0].issues] == ["capture_time_missing"]
    assert x[0]["values"]["short_hash"] == "01234567" and len(x[0]["values"]) == 18
    assert {i.code for i in x[1].issues} >= {"capture_time_missing", "missing_metadata", "source_missing"}
    blocked = organize.draft(df, Rules("con", fallback="block"), "/r" * 130).orderBy("ordinal").first()
    assert {i.code for i in blocked.issues} >= {"reserved_name", "path_too_long", "lens_missing", "tone_missing"} and not blocked.valid
    with pytest.raises(ValueError, match="sequence_width"):
        organize.draft(df, Rules("x", width=0), "/r")
    assert organize.draft(df.limit(0), Rules("x"), "/r").count() == 0


def test_status_of_items(spark):
    rows = [(1, [], None), (2, [("a", "warning")], None), (3, [("a", "error")], None), (4, [], "duplicate_target"), (5, [("target_escape", "error")], "duplicate_target")]
    df = spark.createDataFrame(rows, "id INT, issues ARRAY<STRUCT<code: STRING, severity: STRING>>, conflict STRING")
    of = lambda s: [r.s for r in df.orderBy("id").select(organize.status(F.col("issues"), F.col("conflict"), s).alias("s")).collect()]
    assert of("skip") == ["ready", "warning", "error", "skipped_conflict", "error"] and of("sequence") == ["ready", "warning", "error", "warning", "error"]


def test_plans_are_kept_and_deleted(spark):
    plans = organize.Plans(spark)
    rows = spark.createDataFrame([(2, 7, "t", [("c", "error")]), (1, 8, "u", [])], "ordinal INT, asset_id BIGINT, target STRING, issues ARRAY<STRUCT<code: STRING, severity: STRING>>")
    plans.save("one", rows)
    plans.save("one", rows.where("ordinal = 2").unionByName(rows.where("ordinal = 1")))
    assert [r.asset_id for r in plans.read("one").collect()] == [8, 7] and [r.code for r in plans.issues("one").collect()] == ["c"]
    plans.delete("one")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        plans.read("one").count()


def test_subjects_and_fusion(spark):
    boxes = [(1, 0, 0.5), (2, 0, 0.9), (2, 0, 0.9), (3, 0, 0.9), (3, 0, 0.6), (3, 0, 0.7), (4, 0, 0.4), (4, 16, 0.8), (5, 58, None), (6, 2, 0.3)]
    faces = [(1, 0.8), (2, 0.95), (4, 0.66), (7, 0.7), (8, 0.6)]
    got = {(r.asset_id, r.label): r.score for r in scoring.subjects(spark.createDataFrame(boxes, "asset_id BIGINT, class_id INT, score DOUBLE"), spark.createDataFrame(faces, "asset_id BIGINT, score DOUBLE")).collect()}
    assert got == {(1, "single_person"): 0.8, (2, "multiple_people"): 0.9, (3, "multiple_people"): 0.7, (4, "single_person"): 0.66, (4, "animal"): 0.8, (6, "vehicle"): 0.3, (7, "single_person"): 0.7}
    entry = "STRUCT<label: STRING, score: DOUBLE>"
    topics = spark.createDataFrame([(1, ("photo_food", 0.3), [("photo_food", 0.3), ("photo_portrait", 0.1)]), (2, None, []), (3, ("photo_food", 0.3), [])], f"asset_id BIGINT, primary {entry}, evidence ARRAY<{entry}>")
    found = spark.createDataFrame([(1, "single_person", 0.4), (2, "nothing", 0.9), (3, "plant", 0.2), (3, "animal", 0.1)], "asset_id BIGINT, label STRING, score DOUBLE")
    out = {r.asset_id: (r.primary and r.primary.label, [(e.label, e.score) for e in r.evidence]) for r in scoring.fused(topics, found).collect()}
    assert out == {1: ("photo_portrait", [("photo_portrait", 0.4), ("photo_food", 0.3)]), 2: (None, []), 3: ("photo_macro", [("photo_macro", 0.2)])}


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "expected ARRAY<STRING>, predicted ARRAY<STRING>, top ARRAY<STRING>")
    r = evaluate.summary(none).first()
    assert r.samples == 0 and r.top1 is None and r.micro_recall is None and evaluate.confusion(none).count() == 0
    sweep = evaluate.margin_sweep(spark.createDataFrame([], "label STRING, score DOUBLE, second DOUBLE, correct BOOLEAN"), spark.createDataFrame([("a", 0.1, 0)], "label STRING, threshold DOUBLE, positives BIGINT"), 0.5).collect()
    assert len(sweep) == len(evaluate.MARGINS) and not any(x.recommended for x in sweep) and all(x.accepted == 0 and x.precision is None for x in sweep)


def test_edits_scans_and_jobs(spark):
    values = spark.createDataFrame([([" a", "a ", None, "", "b"],), ([" "],), (None,)], "v ARRAY<STRING>")
    assert [r.v for r in values.select(state.cleaned_values(F.col("v")).alias("v")).collect()] == [["a", "b"], None, None]
    edits = spark.createDataFrame([(1, 5), (1, 3), (2, 4), (2, 9), (3, None)], "batch INT, rating INT")
    assert {r.batch for r in state.accepted_batches(edits, "batch", F.col("rating").between(0, 5)).collect()} == {1}
    found = spark.createDataFrame([(i, 10, 100, "x") for i in range(1, 6)], "id INT, file_size BIGINT, modified_at BIGINT, scan_status STRING")
    known = spark.createDataFrame([(1, 10, 100, "indexed"), (2, 10, 101, "indexed"), (3, 10, 100, "failed"), (4, 10, 100, "indexed")], "id INT, file_size BIGINT, modified_at BIGINT, scan_status STRING")
    assert {r.id: r.route for r in state.scan_route(found, known, spark.createDataFrame([(1,)], "id INT")).collect()} == {1: "skip", 2: "full", 3: "full", 4: "features", 5: "new"}
    jobs = spark.createDataFrame([("a", "running"), ("b", "completed")], "s STRING, status STRING")
    assert {r.s: r.accepted for r in state.startable(jobs, spark.createDataFrame([("a",), ("b",), ("c",)], "s STRING"), "s").collect()} == {"a": False, "b": True, "c": True}


def test_saving_twice_changes_nothing(spark):
    schema = "asset_id INT, model STRING, label STRING, source_fingerprint STRING"
    old = spark.createDataFrame([(1, "m", "x", "f1"), (2, "m", "y", "f2"), (1, "other", "z", "f1")], schema)
    new = spark.createDataFrame([(1, "m", "a", "f1"), (1, "m", "b", "f1"), (2, "m", "late", "gone")], schema)
    now = spark.createDataFrame([(1, "f1"), (2, "f2")], "id INT, fingerprint STRING")
    once, saved = state.saved_results(old, new, now, ["asset_id", "model"])
    twice, _ = state.saved_results(once, new, now, ["asset_id", "model"])
    expected = {(1, "m", "a"), (1, "m", "b"), (2, "m", "y"), (1, "other", "z")}
    assert {tuple(r)[:3] for r in once.collect()} == {tuple(r)[:3] for r in twice.collect()} == expected and [tuple(r) for r in saved.collect()] == [(1, "m")]


def test_a_bad_input_costs_its_own_row(spark):
    def load():
        def model(texts):
            return [100 // len(t) for t in texts]

        return model

    rows = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "abcd")], "id BIGINT, t STRING")
    got = {r.id: (r.result, r.error) for r in plugin.infer(rows, "id", "t", load, "BIGINT").collect()}
    assert got[1] == (50, None) and got[4] == (25, None) and got[3] == (None, "no input") and got[2][1].startswith("ZeroDivisionError")
    assert plugin.infer(rows.limit(0), "id", "t", load, "BIGINT").count() == 0
