"""Parent-child rows to whole hierarchies: depth, root, path, descendants and cycles; and the closure behind scopes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cores, discard, materialise
from .components import connected_components

RESULT = "node_id BIGINT, root_id BIGINT, node_depth BIGINT, n_below BIGINT, on_cycle BOOLEAN, back_edge_to BIGINT, path STRING"


def escaped(name: Column) -> Column:
    """A name as one path segment: backslash and slash get a backslash, null becomes empty."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"([\\/])", r"\\$1")


def depth_first(ids: np.ndarray, parents: np.ndarray, names: list[str] | None = None) -> pd.DataFrame:
    """:data:`RESULT` of the nodes, see :func:`_walk`."""
    return _walk(ids, parents, names)[0]


def _walk(ids: np.ndarray, parents: np.ndarray, names: list[str] | None = None) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows of RESULT and the positions of the nodes in preorder, where what hangs below a node off a cycle follows it.

    Iterative depth-first traversal with node colours over whole components; `parents` holds -1 positions for roots.

    ids: node keys; parents: position of each node's parent in ids, or -1. Grey marks the walk under way, black what is
    finished: a walk that meets grey has found the back edge that closes a cycle.
    """
    n = len(ids)
    order = np.argsort(parents, kind="stable")
    starts = np.searchsorted(parents[order], np.arange(n + 1))
    white, grey, black = 0, 1, 2
    colour = np.zeros(n, np.int8)
    depth, root, below = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    cycle, back = np.zeros(n, bool), np.full(n, -1, np.int64)
    paths: list[str | None] = [None] * n
    # Upward walks find the cycles: every node has one parent, so a walk of grey nodes closes on itself or ends.
    for first in range(n):
        if colour[first] != white:
            continue
        walk, at = [], first
        while at >= 0 and colour[at] == white:
            colour[at] = grey
            walk.append(at)
            at = parents[at]
        if at >= 0 and colour[at] == grey:
            ring = walk[walk.index(at) :]
            cycle[ring] = True
            low = min(ring, key=lambda v: ids[v])
            root[ring] = ids[low]
            back[next(v for v in ring if parents[v] == low)] = low
        colour[walk] = black
    # Downward from roots and from rings: preorder gives depth, root and path; its reverse gives the counts.
    preorder = []
    colour[:] = white
    for first in [*np.flatnonzero(parents < 0), *np.flatnonzero(cycle)]:
        stack = [int(first)]
        if not cycle[first]:
            root[first], depth[first] = ids[first], 0
            if names is not None:
                paths[first] = "/" + names[first]
        while stack:
            at = stack.pop()
            if colour[at] == black:
                continue
            colour[at] = black
            preorder.append(at)
            for child in order[starts[at] : starts[at + 1]]:
                if cycle[child]:
                    continue
                root[child] = root[at]
                if depth[at] >= 0:
                    depth[child] = depth[at] + 1
                    if names is not None:
                        paths[child] = paths[at] + "/" + names[child]
                stack.append(int(child))
    for at in reversed(preorder):
        if parents[at] >= 0 and not cycle[at]:
            below[parents[at]] += below[at] + 1
    if cycle.any():
        total = pd.Series(1, index=root[depth < 0]).groupby(level=0).sum()
        below[cycle] = total.reindex(root[cycle]).to_numpy() - 1
    rows = pd.DataFrame({"node_id": ids, "root_id": root, "node_depth": depth, "n_below": below, "on_cycle": cycle, "back_edge_to": pd.array(np.where(back >= 0, ids[np.maximum(back, 0)], 0), dtype="Int64"), "path": paths}).assign(back_edge_to=lambda x: x.back_edge_to.mask(back < 0))
    return rows, np.array(preorder, np.int64)


def _positions(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = pdf["node_id"].to_numpy(np.int64)
    rank = pd.Index(ids)
    parents = pdf["parent"].to_numpy(np.float64)
    has = ~np.isnan(parents)
    position = np.full(len(ids), -1, np.int64)
    # Parents as text keep all 64 bits; floats above lost them.
    position[has] = rank.get_indexer(pdf["parent_text"][has].astype(np.int64))
    return ids, position


def _traverse(pdf: pd.DataFrame) -> pd.DataFrame:
    return depth_first(*_positions(pdf), pdf["name"].tolist() if "name" in pdf else None)


def _intervals(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each node with its place and the places (first, last) of all nodes below it; a cycle's nodes share one interval."""
    ids, position = _positions(pdf)
    rows, preorder = _walk(ids, position)
    root, ring = rows["root_id"].to_numpy(), rows["on_cycle"].to_numpy()
    # Stable by root: the trees that hang from one cycle become neighbours, and preorder within a tree is kept.
    preorder = preorder[np.argsort(root[preorder], kind="stable")]
    place = np.empty(len(ids), np.int64)
    place[preorder] = np.arange(len(ids))
    first, last = place + 1, place + rows["n_below"].to_numpy()
    if ring.any():
        low = pd.Series(place).groupby(root).transform("min").to_numpy()
        first[ring], last[ring] = low[ring], low[ring] + rows["n_below"].to_numpy()[ring]
    return pd.DataFrame({"bin": pdf["bin"].to_numpy(), "node": ids, "place": place, "first": first, "last": last})


def hierarchy(rows: DataFrame, node: str, parent: str, name: str | None = None, max_component: int = 50_000) -> DataFrame:
    """(node_id, root_id, node_depth, n_below, on_cycle, back_edge_to, path), one row per node.

    rows: at most one row per node (null nodes are ignored, repeated nodes keep the smallest parent). A parent that is
    null or has no row makes a root of depth 0. A node that never reaches a root has depth -1, the smallest node of the
    cycle it runs into as root, and no path; back_edge_to is set on one node of each cycle, the child of its smallest.
    n_below counts the other nodes that reach the node. path joins the escaped names from the root, when `name` is given.

    Components of up to `max_component` nodes are co-located, many to a task, and traversed depth-first; larger ones are
    resolved by pointer doubling in as many joins as the logarithm of their depth, with the same result.
    """
    placed, small, large = _placed(rows, node, parent, name, max_component)
    path = (lambda c: c) if name else (lambda c: F.lit(None).cast("string"))
    alone = placed.where("component is null").select("node_id", F.col("node_id").alias("root_id"), F.lit(0).cast("bigint").alias("node_depth"), F.lit(0).cast("bigint").alias("n_below"), F.lit(False).alias("on_cycle"), F.lit(None).cast("bigint").alias("back_edge_to"), path(F.concat(F.lit("/"), F.col("name")) if name else None).alias("path"))
    out = alone
    if small is not None:
        out = out.unionByName(small.groupBy("bin").applyInPandas(lambda pdf: _traverse(pdf), RESULT))
    if large is not None:
        out = out.unionByName(by_doubling(large))
    return out


def descendants(rows: DataFrame, node: str, parent: str, max_component: int = 50_000) -> DataFrame:
    """(ancestor, node): every node with each other node below it; on a cycle, all that run into it are below.

    rows and components as for :func:`hierarchy`. The traversal yields one preorder interval per node, and the pairs
    are made from the intervals by a join on places, so no task holds them; components above `max_component` nodes
    take :func:`closure`.
    """
    placed, small, large = _placed(rows, node, parent, None, max_component)
    out = placed.where("false").select(F.col("node_id").alias("ancestor"), F.col("node_id").alias("node"))
    if small is not None:
        spans = materialise(small.groupBy("bin").applyInPandas(lambda pdf: _intervals(pdf), "bin BIGINT, node BIGINT, place BIGINT, first BIGINT, last BIGINT"), "spans")
        pairs = spans.where("first <= last").select("bin", F.col("node").alias("ancestor"), F.explode(F.sequence("first", "last")).alias("place"))
        out = out.unionByName(pairs.join(spans.select("bin", "place", "node"), ["bin", "place"]).where("ancestor <> node").select("ancestor", "node"))
    if large is not None:
        out = out.unionByName(closure(large, "node_id", "parent").where("ancestor <> node").select("ancestor", "node"))
    return out


def _summed(names: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = _intervals(pdf)
        order = np.argsort(at["place"].to_numpy())
        # The interval of a ring holds the node itself, others begin behind it.
        first = np.minimum(at["place"].to_numpy(), at["first"].to_numpy())
        out = {"node_id": at["node"].to_numpy()}
        for n in names:
            upto = np.concatenate([[0], np.cumsum(pdf[n].to_numpy()[order])])
            out[n] = upto[at["last"].to_numpy() + 1] - upto[first]
        return pd.DataFrame(out)

    return run


def subtree_sums(rows: DataFrame, node: str, parent: str, names: tuple[str, ...], max_component: int = 50_000) -> DataFrame:
    """(node_id, names): BIGINT columns of `rows` summed over each node and all below it; on a cycle, over all that run into it.

    rows and components as for :func:`hierarchy`; a repeated node adds up. The sums are differences of running sums in
    preorder; components above `max_component` nodes take :func:`closure`.
    """
    placed, small, large = _placed(rows, node, parent, None, max_component)
    own = rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node_id")).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names])
    out = placed.where("component is null").select("node_id").join(own, "node_id")
    schema = "node_id BIGINT, " + ", ".join(f"{n} BIGINT" for n in names)
    if small is not None:
        run = _summed(list(names))
        out = out.unionByName(small.join(own, "node_id").groupBy("bin").applyInPandas(lambda pdf: run(pdf), schema))
    if large is not None:
        pairs = closure(large, "node_id", "parent").join(own.withColumnRenamed("node_id", "node"), "node")
        out = out.unionByName(pairs.groupBy(F.col("ancestor").alias("node_id")).agg(*[F.sum(n).alias(n) for n in names]))
    return out


def _placed(rows: DataFrame, node: str, parent: str, name: str | None, max_component: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Nodes with their component (null where alone), those of small ones with the task they go to, and those of large ones."""
    names = [escaped(F.col(name)).alias("name")] if name else []
    nodes = rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node_id")).agg(F.min(parent).alias("parent"), *([F.min(escaped(F.col(name))).alias("name")] if names else []))
    there = nodes.select(F.col("node_id").alias("parent"), F.lit(True).alias("there"))
    nodes = materialise(nodes.join(there, "parent", "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there"), "nodes")
    parts = connected_components(nodes.where("parent is not null"), "node_id", "parent")
    placed = materialise(nodes.join(parts.withColumnRenamed("node", "node_id"), "node_id", "left"), "placed")
    discard(parts)
    sizes = placed.where("component is not null").groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") > max_component)
    n_small, n_large = (sizes.agg(F.sum(F.when(F.col("size") <= max_component, F.col("size"))), F.sum((F.col("size") > max_component).cast("int"))).first()) or (0, 0)

    small = None
    if n_small:
        bins = max(cores(rows.sparkSession), -(-n_small // max_component))
        small = placed.where("component is not null").join(large, "component", "left_anti") if n_large else placed.where("component is not null")
        small = small.withColumns({"bin": F.pmod(F.xxhash64("component"), F.lit(bins)), "parent_text": F.col("parent").cast("string")})
    return placed, small, placed.join(large.select("component"), "component", "left_semi").drop("component") if n_large else None


def by_doubling(nodes: DataFrame) -> DataFrame:
    """:func:`hierarchy` for nodes (node_id, parent[, name]) of any depth and size, by doubling the ancestor pointers.

    After k steps every node knows its 2^k-th ancestor, the least node up to there and how many nodes lie below it
    within 2^k steps; the count grows by a map-side combined sum over the nodes that point to it.
    """
    named = "name" in nodes.columns
    piece = F.concat(F.lit("/"), F.col("name")) if named else F.lit(None).cast("string")
    s = nodes.select("node_id", F.col("parent").alias("anc"), F.when(F.col("parent").isNull(), F.col("node_id")).alias("top"), F.when(F.col("parent").isNull(), F.lit(0)).cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("cnt"), F.col("node_id").alias("low"), piece.alias("path"), F.col("parent"))
    s = materialise(s, "doubling")
    span, state = 1, None
    while True:
        up = s.select(F.col("node_id").alias("anc"), F.col("anc").alias("a_anc"), F.col("top").alias("a_top"), F.col("depth").alias("a_depth"), F.col("low").alias("a_low"), F.col("path").alias("a_path"))
        gained = s.where("anc is not null").groupBy(F.col("anc").alias("node_id")).agg(F.sum("cnt").alias("more"))
        j = s.join(up, "anc", "left").join(gained, "node_id", "left")
        resolved = F.col("top").isNull()
        s2 = j.select(
            "node_id",
            F.col("a_anc").alias("anc"),
            F.coalesce("top", "a_top").alias("top"),
            F.when(resolved & F.col("a_top").isNotNull(), F.col("a_depth") + span).otherwise(F.col("depth")).alias("depth"),
            (F.col("cnt") + F.coalesce("more", F.lit(0))).alias("cnt"),
            F.least("low", "a_low").alias("low"),
            (F.when(F.col("anc").isNotNull(), F.concat("a_path", "path")).otherwise(F.col("path")) if named else F.col("path")).alias("path"),
            "parent",
        )
        s2 = materialise(s2, "doubling")
        discard(s)
        s, span = s2, span * 2
        loose = s.where("top is null")
        # Distinct pointers of the unresolved shrink to the cycles' nodes; their least nodes settle with them.
        now = loose.agg(F.count(F.lit(1)), F.count_distinct("anc"), F.sum(F.hash("low").cast("bigint"))).first() + (s.where("anc is not null and top is not null").limit(1).count(),)
        if now[3] == 0 and (now[0] == 0 or now == state):
            break
        state = now
    trees = s.where("top is not null").select("node_id", F.col("top").alias("root_id"), F.col("depth").alias("node_depth"), (F.col("cnt") - 1).alias("n_below"), F.lit(False).alias("on_cycle"), F.lit(None).cast("bigint").alias("back_edge_to"), "path")
    rings = s.where("top is null").select(F.col("anc").alias("ring")).distinct()
    ring_low = rings.join(s.select(F.col("node_id").alias("ring"), F.col("low").alias("ring_low")), "ring")
    loose = s.where("top is null").join(ring_low, F.col("anc") == F.col("ring")).drop("ring").join(rings.withColumn("on_cycle", F.lit(True)).withColumnRenamed("ring", "node_id"), "node_id", "left")
    sizes = loose.groupBy("ring_low").agg(F.count(F.lit(1)).alias("size"))
    on = F.coalesce("on_cycle", F.lit(False))
    cyclic = loose.join(sizes, "ring_low").select(
        "node_id", F.col("ring_low").alias("root_id"), F.lit(-1).cast("bigint").alias("node_depth"), F.when(on, F.col("size") - 1).otherwise(F.col("cnt") - 1).alias("n_below"), on.alias("on_cycle"),
        F.when(on & (F.col("parent") == F.col("ring_low")), F.col("parent")).alias("back_edge_to"), F.lit(None).cast("string").alias("path"),
    )
    return trees.unionByName(cyclic)


def closure(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """(ancestor, node, distance): every node with itself and everything above it, cycle-safe.

    rows: at most one parent per node (the smallest counts); parents without a row are left out. By doubling: pairs of
    under 2^k steps are extended by each node's 2^k-th ancestor, so the rounds are the logarithm of the depth; in a
    cycle the shortest distance is kept and the pairs stop growing. The pairs are the result itself; use
    :func:`hierarchy` where counts and depths are enough.
    """
    nodes = rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("up"))
    nodes = materialise(nodes.join(nodes.select(F.col("node").alias("up"), F.lit(True).alias("there")), "up", "left").select("node", F.when(F.col("there"), F.col("up")).alias("up")), "closure")
    pairs = materialise(nodes.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("distance")), "closure", n=F.count(F.lit(1)))
    jumps, span = nodes.where("up is not null"), 1
    while True:
        far = jumps.join(pairs.select(F.col("node").alias("up"), "ancestor", "distance"), "up").select("ancestor", "node", (F.col("distance") + span).alias("distance"))
        grown = pairs.unionByName(far).groupBy("ancestor", "node").agg(F.min("distance").alias("distance"))
        grown = materialise(grown, "closure", n=F.count(F.lit(1)))
        settled = grown.measured["n"] == pairs.measured["n"]
        discard(pairs)
        pairs = grown
        if settled:
            return pairs
        jumps = materialise(jumps.join(jumps.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")), "jumps")
        span *= 2


def reach(rows: DataFrame, node: str, parent: str, root: int) -> DataFrame:
    """(node, distance): a node and everything below it, cycle-safe; a root without a row reaches nothing."""
    edges = rows.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("up")).distinct()
    newest = materialise(edges.where(F.col("node") == root).select("node", F.lit(0).alias("distance")).distinct(), "reach")
    seen, distance = newest, 0
    while True:
        distance += 1
        step = edges.join(newest.select(F.col("node").alias("up")), "up", "left_semi").select("node").distinct().join(seen.select("node"), "node", "left_anti")
        newest = materialise(step.select("node", F.lit(distance).alias("distance")), "reach", n=F.count(F.lit(1)))
        if not newest.measured["n"]:
            return seen
        seen = seen.unionByName(newest)
