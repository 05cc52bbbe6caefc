"""Orphan references against brute force, and their edges."""

import random

import numpy as np

from catalith.operators import references
from catalith.operators.references import Bitmap, orphan_references


def test_against_brute_force(spark):
    r = random.Random(4)
    when = lambda: f"20{r.randrange(10, 14)}-{r.randrange(1, 13):02d}-{r.randrange(1, 28):02d}T00:00:00.000Z"
    parents = {k: when() for k in [*range(-70_000, 70_000, 977), 2**40 + 5]}
    refs = [(i, r.choice([*parents, 3, 40_001, 2**40, -5]), when()) for i in range(800)] + [(900, None, when()), (901, 3, None), (902, 977 * 5 - 70_000, None), (903, 3, "junk")]
    refs += refs[:50]
    expected = set()
    for o, k, t in refs:
        if k is None:
            continue
        month = t[:7] if t and t[:2] == "20" else None
        if k not in parents:
            expected.add((o, k, month, "absent"))
        elif month and parents[k] > t:
            expected.add((o, k, month, "later"))
    a = spark.createDataFrame(refs, "owner BIGINT, key BIGINT, at STRING")
    b = spark.createDataFrame([*parents.items(), (None, "x")], "id BIGINT, made STRING")
    got = orphan_references(a, b, "owner", "key", "at", "id", "made").collect()
    assert {tuple(x) for x in got} == expected and len(got) == len(expected)


def test_empty_sides_and_dictionary(spark):
    a = spark.createDataFrame([(1, 5, "2020-01-01T00:00:00.000Z")], "owner BIGINT, key BIGINT, at STRING")
    b = spark.createDataFrame([], "id BIGINT, made STRING")
    assert [tuple(x) for x in orphan_references(a, b, "owner", "key", "at", "id", "made").collect()] == [(1, 5, "2020-01", "absent")]
    assert orphan_references(a.limit(0), b, "owner", "key", "at", "id", "made").count() == 0


def test_keys_of_text_and_sparse_numbers(spark, monkeypatch):
    monkeypatch.setattr(references, "RANGE_ROWS", 50)
    for make in (lambda i: f"key-{i * 7919 % 1000:03d}", lambda i: (i * 7919 % 1000) * 2**40 - 2**49):
        parents = [(make(i), f"2020-{1 + i % 12:02d}-05T00:00:00.000Z", "clash") for i in range(300)]
        refs = [(i, make(i), "2020-06-05T00:00:00.000Z", "clash") for i in range(0, 400, 3)] + [(9, make(350), None, None)] * 300
        kind = "STRING" if isinstance(make(0), str) else "BIGINT"
        got = orphan_references(spark.createDataFrame(refs, f"o BIGINT, k {kind}, at STRING, period STRING"), spark.createDataFrame(parents, f"id {kind}, made STRING, range STRING"), "o", "k", "at", "id", "made").collect()
        late = {(i, make(i), "2020-06", "later") for i in range(0, 300, 3) if i % 12 > 5}
        assert {tuple(x) for x in got} == late | {(i, make(i), "2020-06", "absent") for i in range(300, 400, 3)} | {(9, make(350), None, "absent")} and len(got) == len({tuple(x) for x in got})


def test_bitmaps_are_small_and_exact():
    r = random.Random(1)
    sets = [{r.randrange(n) for _ in range(k)} for n, k in ((300_000, 200), (300_000, 150_000), (70_000, 60_000), (10, 0), (66_000, 5_000))]
    for a in sets:
        for b in sets:
            x, y = Bitmap(np.array(sorted(a), np.int64)), Bitmap(np.array(sorted(b), np.int64))
            assert set(x.minus(y).tolist()) == a - b
            x.add(y)
            assert set(x.minus(Bitmap()).tolist()) == a | b
            assert x.nbytes() <= min(2 * len(a | b), 8192 * 5) + 8192
    # Whatever the spread of the keys, dense codes cost two bytes a key and month at most.
    assert Bitmap(np.arange(0, 4000, 2)).nbytes() == 4000
