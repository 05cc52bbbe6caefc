"""Hierarchies: depth-first and doubling agree with brute force on trees, cycles, tails and repeated rows."""

import random

from catalith.operators.components import connected_components
from catalith.operators.hierarchy import closure, descendants, hierarchy, reach, subtree_sums


def brute(parent):
    out = {}
    above = {}
    for n in parent:
        seen, at = [], n
        while at not in seen and parent.get(at) in parent and parent.get(at) is not None:
            seen.append(at)
            at = parent[at]
        if at in seen:
            ring = seen[seen.index(at) :]
            out[n] = (min(ring), -1)
        else:
            out[n] = (at, len(seen))
        above[n] = set(seen) | ({at} if at not in seen else set())
    below = {n: sum(1 for m in parent if m != n and n in above[m]) for n in parent}
    return {n: (*out[n], below[n]) for n in parent}


def some_forest(seed, n=60):
    r = random.Random(seed)
    p = {i: (r.randrange(1, i) if i > 1 and r.random() < 0.9 else None) for i in range(1, n)}
    p[5], p[9] = 9, 5  # a ring of two
    p[20] = 20  # its own parent
    p[30] = 999_999  # a parent without a row
    p[2**53 + 1] = 3
    return p


def test_both_ways_agree_with_brute_force(spark):
    for seed in (1, 2):
        p = some_forest(seed)
        rows = spark.createDataFrame([(k, v, f"n/{k}", "x") for k, v in p.items()] + [(None, 1, "null", "x"), (7, p[7], "n/7", "x")], "id BIGINT, up BIGINT, name STRING, root_id STRING")
        expected = brute(p)
        for limit in (50_000, 1):
            got = hierarchy(rows, "id", "up", "name", max_component=limit).collect()
            assert {r.node_id: (r.root_id, r.node_depth, r.n_below) for r in got} == expected
            rings = {}
            for n, (root, depth, _) in expected.items():
                if depth < 0:
                    rings.setdefault(root, []).append(n)
            # The ring is entered at its smallest node: its child there closes it, whatever the order of the rows.
            closing = {}
            for low in rings:
                at = low
                while p[at] != low:
                    at = p[at]
                closing[at] = low
            assert {r.node_id: r.back_edge_to for r in got if r.back_edge_to is not None} == closing
            paths = {r.node_id: r.path for r in got}
            assert paths[30] == r"/n\/30" and paths[5] is None and paths[2**53 + 1].endswith(r"/n\/9007199254740993")


def test_back_edges_do_not_depend_on_the_order_of_rows():
    import numpy as np

    from catalith.operators.hierarchy import depth_first

    for order in ((1, 2, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)):
        up = {1: 2, 2: 3, 3: 1}
        ids = np.array(order)
        got = depth_first(ids, np.array([order.index(up[i]) for i in order]))
        assert got.set_index("node_id")["back_edge_to"].dropna().to_dict() == {3: 1}


def test_descendants_of_trees_rings_and_tails(spark):
    p = some_forest(3) | {70: 71, 71: 72, 72: 70, 65: 66, 66: 65, 73: 70, 74: 73, 75: 71, 67: 66, 68: 67}
    expected = set()
    for n in p:
        at, seen = p[n], set()
        while at in p and at not in seen:
            seen.add(at)
            at = p[at]
        expected |= {(a, n) for a in seen if a != n}
    rows = spark.createDataFrame(list(p.items()), "id BIGINT, up BIGINT")
    for limit in (50_000, 1):
        got = [tuple(r) for r in descendants(rows, "id", "up", max_component=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert descendants(rows.limit(0), "id", "up").count() == 0


def test_sums_over_subtrees(spark):
    p = some_forest(4) | {70: 71, 71: 72, 72: 70, 73: 70, 74: 73, 75: 71}
    below = {n: {n} for n in p}
    for n in p:
        at, seen = p[n], set()
        while at in p and at not in seen:
            seen.add(at)
            at = p[at]
        for a in seen:
            below[a].add(n)
    rows = spark.createDataFrame([(k, v, k % 7, 1) for k, v in p.items()], "id BIGINT, up BIGINT, w BIGINT, one BIGINT")
    for limit in (50_000, 1):
        got = {r.node_id: (r.w, r.one) for r in subtree_sums(rows, "id", "up", ("w", "one"), limit).collect()}
        assert got == {n: (sum(m % 7 for m in ms), len(ms)) for n, ms in below.items()}
    assert subtree_sums(rows.limit(0), "id", "up", ("w",)).count() == 0


def test_deep_chain_and_empty(spark):
    n = 700
    rows = spark.range(1, n).selectExpr("id", "case when id > 1 then id - 1 end as up")
    for limit in (50_000, 1):
        got = {r.node_id: (r.root_id, r.node_depth, r.n_below) for r in hierarchy(rows, "id", "up", max_component=limit).collect()}
        assert got == {i: (1, i - 1, n - 1 - i) for i in range(1, n)}
    assert hierarchy(rows.limit(0), "id", "up").count() == 0


def test_closure_and_reach(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 77)], "id BIGINT, up BIGINT")
    assert {(r.ancestor, r.node, r.distance) for r in closure(rows, "id", "up").collect()} == {(1, 1, 0), (2, 2, 0), (1, 2, 1), (3, 3, 0), (2, 3, 1), (1, 3, 2), (4, 4, 0), (5, 5, 0), (5, 4, 1), (4, 5, 1), (6, 6, 0)}
    assert {(r.node, r.distance) for r in reach(rows, "id", "up", 1).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {r.node for r in reach(rows, "id", "up", 4).collect()} == {4, 5}
    assert reach(rows, "id", "up", 12345).count() == 0


def test_components_of_hub_path_and_loop(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert all(got[i] == 0 for i in range(200)) and all(got[1000 + i] == 1000 for i in range(61)) and got[5000] == 5000
    assert connected_components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0
