"""Clusters of mutually similar records: k-means cells, exact links, verified groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cores, discard, materialise
from . import cells, kmeans
from .vectors import DIMS, directions, unit

SPACE = 1 << 16  #: buckets that features are hashed into; those that no feature falls into are left out
EXTRA = ("brightness", "saturation")
WEIGHTS = (1.0, 1.0)  #: of the extra features beside the unit vector
WHOLE = 4000  #: members of a component whose pairs one task holds in one matrix
TILE = 4096  #: members of a larger one on each side of a block of pairs
ROWS = 512  #: rows of a block that are compared at once
COLUMNS = 8192  #: rows that they are compared with at once
HELD = 500_000  #: links of a task that are held before they are merged
LARGER = 8  #: times the usual blocks of a cell, as the cells that miss no link are few and large
COPIED = 2e-7  #: by which the cosines of two copies, equal in float32, to another record may differ
STEPS = 200_000  #: branches that the search for a largest clique may take before the best one found stands


def buckets() -> tuple[np.ndarray, np.ndarray, int]:
    """For each feature its column and sign by signed hashing, and how many features share a column at most."""
    hashes = [xxhash.xxh64_intdigest(name) for name in (*(f"e{i}" for i in range(DIMS)), *EXTRA)]
    _, column, n = np.unique([h % SPACE for h in hashes], return_inverse=True, return_counts=True)
    return column, np.array([1.0 if h >> 63 else -1.0 for h in hashes], np.float32), int(n.max())


COLUMN, SIGN, SHARED = buckets()


def hashed(x: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Signed feature hashing of unit vectors and weighted extra features; distances grow at most by the root of the sharing."""
    values = np.hstack([x, extra * np.array(WEIGHTS)]).astype(np.float32) * SIGN
    out = np.zeros((len(x), COLUMN.max() + 1), np.float32)
    for i, c in enumerate(COLUMN):
        out[:, c] += values[:, i]
    return out


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return hashed(unit(kmeans.matrix(batch["vec"], DIMS)), np.column_stack([batch[c].to_numpy() for c in EXTRA]))


def similar(x: np.ndarray, y: np.ndarray, bx: np.ndarray, by: np.ndarray, cosine: float, apart: float, joined: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which pairs of unit vectors (float64) and feature rows are similar; exact, with decimals of features rounded to nine digits.

    joined: the components of the rows so far; where many pairs may be similar, those within one component are left out.
    """
    s = x.astype(np.float32) @ y.astype(np.float32).T
    near = s >= cosine - 1e-4
    if joined is not None and np.count_nonzero(near) > near.size // 64:
        near &= joined[0][:, None] != joined[1]
    i, j = np.nonzero(near)
    far = (np.abs(np.round(bx[i] - by[j], 9)) > apart).any(axis=1)
    edge = np.flatnonzero(~far & (s[i, j] < cosine + 1e-4))
    far[edge] = np.einsum("ij,ij->i", x[i[edge]], y[j[edge]]) < cosine - 1e-12
    near[i[far], j[far]] = False
    return near


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _link(cosine: float, apart: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, first, home, every = cells.roles(pdf)
        x = unit(kmeans.matrix(pdf["vec"].iloc[first].tolist(), DIMS))
        f = pdf[list(EXTRA)].to_numpy()[first]
        home, every = home[np.argsort(f[home, 0])], every[np.argsort(f[every, 0])]
        label, held = np.arange(len(ids)), []

        def between(rows: np.ndarray, c: int, low: float, high: float) -> np.ndarray:
            """Those of `rows`, sorted by feature c, that lie within its range of what lies from low to high."""
            first, last = np.searchsorted(f[rows, c], [low - apart - 1e-6, high + apart + 1e-6])
            return rows[first:last]

        def merged() -> np.ndarray:
            i, j = (np.concatenate(v) for v in zip(*held, (np.arange(len(ids)), label)))
            held.clear()
            return _components(len(ids), i, j)

        slab = max(ROWS, math.isqrt(len(home) * ROWS))  # of one brightness; sorted by saturation, as what it is compared with
        for a in range(0, len(home), slab):
            part = home[a : a + slab]
            some = between(every, 0, f[part[0], 0], f[part[-1], 0])
            part, some = part[np.argsort(f[part, 1])], some[np.argsort(f[some, 1])]
            for b in range(0, len(part), ROWS):
                h = part[b : b + ROWS]
                other = between(some, 1, f[h[0], 1], f[h[-1], 1])
                for c in range(0, len(other), COLUMNS):
                    o = other[c : c + COLUMNS]
                    i, j = np.nonzero(similar(x[h], x[o], f[h], f[o], cosine, apart, (label[h], label[o])))
                    held.append((h[i], o[j]))
                    if sum(len(i) for i, _ in held) > HELD:
                        label = merged()
        label = merged()
        linked = label != np.arange(len(ids))
        return pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})

    return run


def similarity_links(base: DataFrame, cosine: float, apart: float, lists: int | None = None, slack: float | None = None) -> DataFrame:
    """(a, b): a spanning set of links between similar records, at most one per record and task.

    base (id, vec, brightness, saturation). The cells are those of a k-means fitted on all records; the records of a
    cell are compared, exactly, with each other and with all that visit it from other cells. Each record visits every
    cell that can hold a similar one, so no link is missed (see cells.visits). The cells are few, as copies grow with
    their number while nearly as many pairs are left to compare; within a cell brightness and saturation are sorted,
    so that only rows within their range are compared. A `slack` leaves out visits, and with them links; the cells
    are then about the square root of the records. A cell too large for one task is compared in blocks against blocks.
    """
    n = base.count()
    centres = kmeans.fit(base, lists or max(1, round(n**0.25) if slack is None else math.isqrt(n)), int(COLUMN.max()) + 1, decode=_features)
    if len(centres) == 0:
        return base.select(F.col("id").alias("a"), F.col("id").alias("b"))
    radius = math.sqrt(SHARED * (2 - 2 * cosine + sum((w * apart) ** 2 for w in WEIGHTS)))
    placed = cells.place(base, centres, radius, slack, _features, ["id", "vec", *EXTRA], np.unique(COLUMN[:DIMS]), LARGER if slack is None else 1)
    return placed.groupBy("cell", "i", "j").applyInPandas(_link(cosine, apart), "a BIGINT, b BIGINT")


def largest_clique(near: np.ndarray, start: np.ndarray, steps: list[int]) -> np.ndarray:
    """Positions of a largest set of mutually similar rows, by branch and bound over colourings from the set `start` on.

    Exact as long as `steps` (a counter of one number, shared by the calls for a component) lasts.
    """
    n = len(near)
    order = np.argsort(-near.sum(axis=1), kind="stable")  # colours go to the most connected first
    rows = [sum(1 << int(j) for j in np.flatnonzero(near[v][order]) if j != i) for i, v in enumerate(order)]
    best: list[int] = [int(np.flatnonzero(order == v)[0]) for v in start]
    stack = [([], (1 << n) - 1)]
    while stack and steps[0] > 0:
        steps[0] -= 1
        chosen, may = stack.pop()
        if not may:
            if len(chosen) > len(best):
                best = chosen
            continue
        # Greedy colouring: rows of one colour are mutually dissimilar, so a set takes at most one of each.
        left, colour, ranked = may, 0, []
        while left:
            colour += 1
            free = left
            while free:
                low = free & -free
                v = low.bit_length() - 1
                ranked.append((v, colour))
                left ^= low
                free = (free ^ low) & ~rows[v]
        branches = []
        for v, c in reversed(ranked):
            if len(chosen) + c <= len(best):
                break
            branches.append(([*chosen, v], may & rows[v]))
            may &= ~(1 << v)
        stack += reversed(branches)
    return order[sorted(best)]


def cliques(near: np.ndarray) -> np.ndarray:
    """Labels of disjoint groups of mutually similar rows, a largest one of those left at a time; -1 for rows left alone.

    A greedy group is taken to the largest by :func:`largest_clique`; only where STEPS branches do not settle that,
    the best group found stands.
    """
    label, left, steps = np.full(len(near), -1), np.arange(len(near)), [STEPS]
    while len(left) > 1:
        part = near[np.ix_(left, left)]
        first = grown(len(left), lambda i, j, part=part: part[np.ix_(i, j)], once=True)
        if (first < 0).all():
            break
        best = left[largest_clique(part, np.flatnonzero(first >= 0), steps)]
        label[best] = best.min()
        left = left[label[left] < 0]
    return label


def grown(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], once: bool = False) -> np.ndarray:
    """Labels of disjoint groups of mutually similar rows, each the largest found when it is taken; -1 for rows left alone.

    Only the first group with `once`. Rows are tried as seeds by falling degree, joined by their most connected neighbours first. near(i, j) tells which
    of rows i and j are similar; it is asked for blocks of ROWS rows, so nothing of the size of all pairs is held.
    """

    def sums(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(j), np.int64)
        for b in range(0, len(i), ROWS):
            out += near(i[b : b + ROWS], j).sum(axis=0)
        return out

    label, left = np.full(n, -1), np.ones(n, bool)
    degree = sums(np.arange(n), np.arange(n))
    while True:
        if degree.max(initial=0) <= 1:
            return label
        rows = np.flatnonzero(left)
        best: np.ndarray = rows[:0]
        for seed in np.argsort(-degree, kind="stable")[:16]:
            if degree[seed] <= len(best):
                break
            group = [int(seed)]
            may = rows[near(np.array([seed]), rows)[0]]
            may = may[may != seed]
            inside = sums(may, may)
            while len(may) and inside.min() < len(may):
                k = int(np.argmax(inside))
                group.append(int(may[k]))
                keep = near(may[k : k + 1], may)[0]
                keep[k] = False
                gone, may = may[~keep], may[keep]
                inside = inside[keep] - sums(gone, may)
            if len(group) + len(may) > len(best):
                best = np.concatenate([np.array(group), may])  # what is left of `may` is mutually similar
        label[best] = best.min()
        if once:
            return label
        left[best] = False
        rows = np.flatnonzero(left)
        degree[rows] -= sums(best, rows)
        degree[best] = 0


def _split(cosine: float, apart: float, most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.sort_values(["grp", "id"]).groupby("grp", sort=False):
            ids = g["id"].to_numpy()
            if len(ids) < 2:
                continue
            x, f = unit(kmeans.matrix(g["vec"].tolist(), DIMS)), g[["brightness", "saturation"]].to_numpy()
            if len(ids) <= most:
                near = similar(x, x, f, f, cosine, apart)
                np.fill_diagonal(near, True)
                label = np.zeros(len(ids), np.int64) if near.all() else cliques(near)
            else:
                label = grown(len(ids), lambda i, j, x=x, f=f: similar(x[i], x[j], f[i], f[j], cosine, apart))
            m = label >= 0
            if m.any():
                out.append(pd.DataFrame({"cluster_id": ids[label[m]], "asset_id": ids[m]}))
        return pd.concat(out) if out else pd.DataFrame({"cluster_id": pd.Series(dtype="int64"), "asset_id": pd.Series(dtype="int64")})

    return run


def _tile(cosine: float, apart: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, f = unit(kmeans.matrix(pdf["vec"].tolist(), DIMS)), pdf[["brightness", "saturation"]].to_numpy()
        own, i, j = pdf["own"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        degree = np.zeros(len(pdf), np.int64)
        for b in range(0, len(left), ROWS):
            h = left[b : b + ROWS]
            near = similar(x[h], x[right], f[h], f[right], cosine, apart)
            degree[h] += near.sum(axis=1)
            if i != j:
                degree[right] += near.sum(axis=0)
        return pd.DataFrame({"grp": pdf["grp"].to_numpy(), "id": pdf["id"].to_numpy(), "degree": degree})

    return run


def degrees(rows: DataFrame, cosine: float, apart: float) -> DataFrame:
    """(grp, id, degree): with how many rows of its group, itself included, each row is similar; blocks against blocks."""
    blocks = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    placed = rows.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = placed.withColumns({"i": F.least("own", "k"), "j": F.greatest("own", "k")}).drop("blocks", "k")
    return tiles.groupBy("grp", "i", "j").applyInPandas(_tile(cosine, apart), "grp BIGINT, id BIGINT, degree BIGINT").groupBy("grp", "id").agg(F.sum("degree").alias("degree"))


def largest_cores(rows: DataFrame, cosine: float, apart: float) -> DataFrame:
    """(grp, id, cluster_id): the largest set of mutually similar rows of each group where degrees alone prove it.

    A set of m rows of which each is similar to all m, while every other row is similar to fewer than m or to m others
    at most, is a largest one: a row is in no set greater than its degree. Groups without that proof do not come out.
    """
    found = materialise(degrees(rows, cosine, apart), "degrees")
    counts = found.groupBy("grp", "degree").agg(F.count(F.lit(1)).alias("n"))
    falling = Window.partitionBy("grp").orderBy(F.desc("degree"))
    counts = counts.select("grp", "degree", F.sum("n").over(falling).alias("size"), F.coalesce(F.lead("degree").over(falling), F.lit(0)).alias("below"))
    least = counts.where("size <= degree and size >= below and size > 1").groupBy("grp").agg(F.min_by(F.struct("degree", "size"), "degree").alias("cut"))
    core = materialise(found.join(least, "grp").where("degree >= cut.degree").select("grp", "id", F.col("cut.size").alias("size")), "core")
    discard(found)
    inside = degrees(rows.join(core.select("grp", "id", "size"), ["grp", "id"]), cosine, apart)
    proven = inside.join(core, ["grp", "id"]).groupBy("grp").agg(F.min(F.col("degree") - F.col("size")).alias("missing"), F.min("id").alias("cluster_id")).where("missing = 0")
    return core.join(proven, "grp").select("grp", "id", "cluster_id")


def centroids(rows: DataFrame, group: str) -> DataFrame:
    """(group, centre BINARY of float64, n): sums of unit vectors per partition, then per group; no group is collected."""
    schema = "grp BIGINT, centre BINARY, n BIGINT"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, g = unit(kmeans.matrix(b["vec"], DIMS)), b[group].to_numpy()
                order = np.argsort(g, kind="stable")
                keys, first, n = np.unique(g[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(x[order], first, axis=0)
                yield pa.RecordBatch.from_pydict({"grp": keys, "centre": [s.tobytes() for s in sums], "n": n.astype(np.int64)})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.frombuffer(b"".join(pdf["centre"]), np.float64).reshape(-1, DIMS)
        keys, at = np.unique(pdf["grp"].to_numpy(), return_inverse=True)
        out = np.zeros((len(keys), DIMS))
        np.add.at(out, at, sums)
        return pd.DataFrame({"grp": keys, "centre": [(s / max(np.sqrt(s @ s), 1e-300)).tobytes() for s in out], "n": np.bincount(at, pdf["n"]).astype(np.int64)})

    bins = cores(rows.sparkSession) * 2
    parts = rows.select(group, "vec").mapInArrow(partial, schema).withColumn("bin", F.pmod(F.xxhash64("grp"), F.lit(bins)))
    return parts.groupBy("bin").applyInPandas(lambda pdf: total(pdf), schema).withColumnRenamed("grp", group)


def with_cosine(rows: DataFrame, group: str) -> DataFrame:
    """`rows` with `typical`, the cosine to the centroid of their group."""
    joined = rows.join(centroids(rows, group).select(group, "centre"), group)
    schema = ", ".join(f"{c} {t}" for c, t in joined.dtypes if c not in ("centre", "vec")) + ", typical DOUBLE"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(kmeans.matrix(b["vec"], DIMS))
                c = np.frombuffer(b"".join(b["centre"].to_pylist()), np.float64).reshape(-1, DIMS)
                keep = [n for n in b.schema.names if n not in ("centre", "vec")]
                yield pa.RecordBatch.from_arrays([*(b[n] for n in keep), pa.array(np.einsum("ij,ij->i", x, c))], [*keep, "typical"])

    return joined.mapInArrow(run, schema)


def similarity_clusters(base: DataFrame, cosine: float = 0.92, apart: float = 0.10, slack: float | None = None) -> DataFrame:
    """(cluster_id, asset_id): sets of two or more mutually similar records, cluster_id the smallest id of each.

    base (id, vec, brightness, saturation), one row per id; rows with a null are left out. Exact copies are merged
    first and linked to the smallest id of theirs. Links from k-means cells, of which none is missed unless `slack` is given, are joined to components.
    A component whose members all lie within half the angle of its centroid, and within the allowed range of both
    features, is mutually similar as a whole; that takes one pass however large it is. The others are verified pair
    by pair, and where not all are similar, split into cliques, a largest one at a time. Components of more than
    WHOLE members that have no such certificate are verified block against block, and their largest clique is taken
    off where the degrees prove it; one knotted beyond that is split in one task that keeps its vectors, not its
    pairs, by greedy growth. Fewer than two records, and an empty table, give no clusters.
    """
    base = base.select("id", "vec", "brightness", "saturation").where("id is not null and vec is not null and brightness is not null and saturation is not null")
    keyed = directions(base)
    same = ["key", "brightness", "saturation"]
    firsts = materialise(keyed.groupBy(*same).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "firsts", most=F.max("n"))
    if (firsts.measured["most"] or 0) > 1:
        single = materialise(base.join(firsts.select(F.col("first").alias("id")), "id", "left_semi"), "single")
        copies = keyed.join(firsts.where("n > 1").select(*same, "first"), same).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
        links = materialise(similarity_links(single, cosine - COPIED, apart, slack=slack).unionByName(copies), "links")
        discard(single)
    else:
        links = materialise(similarity_links(base, cosine, apart, slack=slack), "links")
    discard(firsts)
    found = connected_components(links).withColumnsRenamed({"node": "id"})
    members = materialise(base.join(found, "id"), "members")
    discard(links)
    groups, whole, knotted = members.select(F.col("component").alias("grp"), "id", "vec", "brightness", "saturation"), [], []
    while True:
        spread = lambda c: F.round(F.max(c) - F.min(c), 9)
        sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), spread("brightness").alias("rb"), spread("saturation").alias("rs"))
        large = materialise(sizes.where(F.col("n") > WHOLE), "large", n=F.count(F.lit(1)))
        if not large.measured["n"]:
            break
        big = groups.join(large.select("grp"), "grp", "left_semi")
        least = with_cosine(big.select("grp", "id", "vec"), "grp").groupBy("grp").agg(F.min("typical").alias("least")).join(large, "grp")
        sure = materialise(least.where((F.col("least") >= math.sqrt((1 + cosine) / 2)) & (F.col("rb") <= apart) & (F.col("rs") <= apart)).select("grp", "low"), "certified")
        whole.append(big.join(sure, "grp").select(F.col("low").alias("cluster_id"), F.col("id").alias("asset_id")))
        rest = materialise(big.join(sure, "grp", "left_anti"), "rest", n=F.count(F.lit(1)))
        groups = groups.join(large.select("grp"), "grp", "left_anti")
        if not rest.measured["n"]:
            break
        core = materialise(largest_cores(rest, cosine, apart), "cores", n=F.count(F.lit(1)))
        if not core.measured["n"]:
            knotted.append(rest)
            break
        peeled = core.select("grp").distinct()
        whole.append(core.select("cluster_id", F.col("id").alias("asset_id")))
        knotted.append(rest.join(peeled, "grp", "left_anti"))
        groups = materialise(groups.unionByName(rest.join(peeled, "grp", "left_semi").join(core.select("grp", "id"), ["grp", "id"], "left_anti").select(groups.columns)), "groups")
    for rest in knotted:
        groups = groups.unionByName(rest)
    bins = cores(base.sparkSession) * 4
    placed = groups.withColumn("bin", F.pmod(F.xxhash64("grp"), F.lit(bins)))
    verified = placed.groupBy("bin").applyInPandas(_split(cosine, apart, WHOLE), "cluster_id BIGINT, asset_id BIGINT")
    for found in whole:
        verified = verified.unionByName(found)
    return verified


def typical_members(base: DataFrame, clusters: DataFrame, k: int = 3) -> DataFrame:
    """(cluster_id, size, typical): each cluster by its size and its k members nearest the centroid, nearest first."""
    rows = base.select(F.col("id").alias("asset_id"), "vec").join(clusters, "asset_id")
    scored = with_cosine(rows, "cluster_id")
    order = Window.partitionBy("cluster_id").orderBy(F.round("typical", 9).desc(), "asset_id")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = top.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "asset_id"))), lambda x: x["asset_id"]).alias("typical"))
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).join(best, "cluster_id")
