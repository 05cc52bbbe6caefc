"""Distributed k-means with parallel oversampled seeding, over vectors held as float32 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048  #: vectors per matrix product
MOST = 16_384  #: clusters; more records make larger clusters, which their users compare in blocks
DRIVER_BYTES = 64 << 20  #: partial sums that come to the driver without being added up on the way


def matrix(column: pa.Array | pa.ChunkedArray | list, dims: int) -> np.ndarray:
    """(n, dims) float32 from a column of float32 bytes."""
    values = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, dims)


def unit_random(ids: np.ndarray, seed: int) -> np.ndarray:
    """A uniform number in [0, 1) from each id, the same wherever and whenever it is computed."""
    x = ids.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest centres of each row, nearest first, and squared distances."""
    half = (centres * centres).sum(1) / 2
    n = min(n, len(centres))
    which, far = np.empty((len(x), n), np.int32), np.empty((len(x), n), np.float32)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        score = half - part @ centres.T
        best = np.argpartition(score, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(n), (len(part), 1))
        order = np.argsort(np.take_along_axis(score, best, 1), axis=1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        which[at : at + BLOCK] = best
        far[at : at + BLOCK] = 2 * np.take_along_axis(score, best, 1) + (part * part).sum(1)[:, None]
    return which, np.maximum(far, 0)


def weighted_kmeans(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """k-means++ and Lloyd on the driver, for the candidates of the seeding only."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    chosen = [int(np.argmax(weights))]
    d2 = ((points - points[chosen[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        p = weights * d2
        total = p.sum()
        at = int(np.searchsorted(np.cumsum(p), rng.random() * total)) if total > 0 else int(rng.integers(len(points)))
        chosen.append(min(at, len(points) - 1))
        d2 = np.minimum(d2, ((points - points[chosen[-1]]) ** 2).sum(1))
    centres = points[chosen].copy()
    for _ in range(rounds):
        label = nearest(points, centres)[0][:, 0]
        mass = np.bincount(label, weights, k)
        sums = np.zeros((k, points.shape[1]))
        np.add.at(sums, label, points * weights[:, None])
        full = mass > 0
        centres[full] = (sums[full] / mass[full, None]).astype(np.float32)
    return centres


def _rows(df: DataFrame, function, schema: str) -> list:
    return df.mapInArrow(function, schema).collect()


def _partial_sums(vectors: DataFrame, centres: np.ndarray, dims: int, decode) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sizes of the clusters; partitions send one row per cluster they hold, added up before the driver sees them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros((len(centres), dims)), np.zeros(len(centres), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = decode(batch)
            label = nearest(x, centres)[0][:, 0]
            order = np.argsort(label, kind="stable")
            held, first = np.unique(label[order], return_index=True)
            total[held] += np.add.reduceat(x[order].astype(np.float64), first, axis=0) 
            size += np.bincount(label, minlength=len(centres))
        held = np.flatnonzero(size)
        for at in range(0, len(held), 4096):
            h = held[at : at + 4096]
            yield pa.RecordBatch.from_pydict({"cell": h.astype(np.int32), "n": size[h], "total": [total[i].tobytes() for i in h]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(b"".join(pdf["total"]), np.float64).reshape(-1, dims).sum(0)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "n": [pdf["n"].sum()], "total": [total.tobytes()]})

    schema = "cell INT, n BIGINT, total BINARY"
    parts = vectors.mapInArrow(sums, schema)
    several = vectors.rdd.getNumPartitions() * len(centres) * dims * 8 > DRIVER_BYTES  # then they are added up before
    rows = (parts.groupBy("cell").applyInPandas(add, schema) if several else parts).collect()
    total, size = np.zeros((len(centres), dims)), np.zeros(len(centres), np.int64)
    for r in rows:
        total[r["cell"]] += np.frombuffer(r["total"], np.float64)
        size[r["cell"]] += r["n"]
    return total, size


def fit(vectors: DataFrame, k: int, dims: int, seeding_rounds: int = 2, lloyd_rounds: int = 2, seed: int = 7, decode=None) -> np.ndarray:
    """(k', dims) centres, k' <= k, of vectors (id BIGINT, vec BINARY of float32), all of which take part in every step.

    decode: Arrow batch to (n, dims) matrix, where the features are more than the bytes in vec.

    Seeding: from one vector on, each round samples every vector with a probability in proportion to its squared
    distance from the centres so far, k expected per round; the candidates, weighted by the vectors nearest to them,
    are clustered on the driver. Then Lloyd rounds of partial sums. The driver holds centres only: about
    seeding_rounds * k of them (k is at most MOST, so their size is bounded); vectors never come to the driver.
    Sampling depends on ids alone, so a lost task repeats exactly. No vectors give no centres.
    """
    k = max(1, min(k, MOST))
    decode = decode or (lambda batch: matrix(batch["vec"], dims))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"vec": [decode(b.slice(0, 1))[0].tobytes()]})

    first = vectors.orderBy("id").limit(1).mapInArrow(one, "vec BINARY").collect()
    if not first:
        return np.zeros((0, dims), np.float32)
    candidates = matrix([first[0]["vec"]], dims)

    def cost_of(centres: np.ndarray) -> float:
        def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(float(nearest(decode(b), centres)[1].sum(dtype=np.float64)) for b in batches if b.num_rows)
            yield pa.RecordBatch.from_pydict({"cost": [float(total)]})

        return sum(r["cost"] for r in _rows(vectors, cost, "cost DOUBLE"))

    for r in range(seeding_rounds):
        phi, centres = cost_of(candidates), candidates
        if phi <= 0:
            break

        def sample(batches: Iterator[pa.RecordBatch], r=r, phi=phi, centres=centres) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = decode(b)
                    d2 = nearest(x, centres)[1][:, 0]
                    pick = unit_random(b["id"].to_numpy(), seed * 100 + r) < k * d2 / phi
                    yield pa.RecordBatch.from_pydict({"vec": [v.tobytes() for v in x[pick]]}, pa.schema({"vec": pa.binary()}))

        drawn = _rows(vectors, sample, "vec BINARY")
        if drawn:
            candidates = np.vstack([candidates, matrix(sorted(x["vec"] for x in drawn), dims)])
    candidates = np.unique(candidates, axis=0)
    _, weights = _partial_sums(vectors, candidates, dims, decode)
    centres = weighted_kmeans(candidates, weights.astype(np.float64), k)
    for _ in range(lloyd_rounds):
        total, size = _partial_sums(vectors, centres, dims, decode)
        full = size > 0
        centres = (total[full] / size[full, None]).astype(np.float32)
    return centres
