"""Placing records into the cells of a k-means so that close pairs meet in one of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kmeans

HOME_BLOCK, ALL_BLOCK = 8192, 32768  #: home rows and visiting rows of a cell that one task compares
TASK_BYTES = 16 << 20  #: rows that one task reads
MOST_VISITS = 6  #: cells that a record visits beside those of its dense group, unless all borders count
SLACK = 0.07  #: how near to the border of a distant cell a record must lie to visit it, see :func:`visits`
PLACED = "cell INT, i INT, j INT, role INT"


def visits(x: np.ndarray, centres: np.ndarray, radius: float, slack: float | None, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row, and (row, cell) of the other cells that it has to visit so that pairs within `radius` meet.

    The border between a home h and a cell c is the plane halfway between their centres, at the distance
    (|x-c|^2 - |x-h|^2) / 2|c-h|. Of two rows in different cells the distances to the border between these cells add
    up to at most their own distance, so one of the rows lies within half of it. With slack=None all rows within half
    the radius of a border visit: no pair can be missed.

    Else that holds between `dense` cells, those whose rows lie within the radius of each other on average, so that a
    dense group that fills several cells stays whole; across other borders only rows within `slack` visit, and each
    only the MOST_VISITS nearest. What is missed then are pairs whose connecting line runs almost straight across the
    border: in d dimensions the part of it across the border is about its length / sqrt(d), and one of its ends within
    half of that, so that border is among the nearest.
    """
    sure = radius / 2 + 1e-4
    home = np.empty(len(x), np.int32)
    half = (centres * centres).sum(1) / 2
    wide = centres.astype(np.float64)
    exact = (wide * wide).sum(1) / 2
    rows, cells = [], []
    block = max(16, min(kmeans.BLOCK, 4_000_000 // max(1, len(centres))))
    for at in range(0, len(x), block):
        score = half - x[at : at + block] @ centres.T  # half the squared distances, but for |x|^2 / 2
        every = np.arange(len(score))
        own = score.argmin(axis=1)
        home[at : at + block] = own
        used, back = np.unique(own, return_inverse=True)
        apart = np.sqrt(np.maximum(2 * (exact[used][:, None] + exact[None] - wide[used] @ wide.T), 1e-12)).astype(np.float32)[back]
        beyond = score - score[every, own][:, None]
        beyond[every, own] = np.inf
        border = beyond / apart
        within = beyond <= sure * apart + 2e-5  # float32 is not exact enough to be divided by the distance of close centres
        if slack is None:
            near = within
        else:
            near = border <= min(slack, sure)
            many = np.flatnonzero(near.sum(axis=1) > MOST_VISITS)
            if len(many):
                near[many] &= border[many] <= np.partition(border[many], MOST_VISITS - 1, axis=1)[:, MOST_VISITS - 1][:, None]
            thick = np.flatnonzero(dense[own])
            if len(thick):
                near[thick] |= within[thick] & dense
        r, c = np.nonzero(near)
        rows.append(r + at), cells.append(c)
    return home, np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(cells).astype(np.int32) if cells else np.zeros(0, np.int32)


def place(rows: DataFrame, centres: np.ndarray, radius: float, slack: float | None, decode: Callable[[pa.RecordBatch], np.ndarray], columns: list[str], of_unit: np.ndarray | None = None, larger: int = 1) -> DataFrame:
    """(cell, i, j, role, columns): rows (id BIGINT, ...) once for each block of pairs they take part in, partitioned by (cell, i, j).

    role is 1 for a row at home, 2 for one that the home rows of the block are compared with, 3 for both. Cells are
    counted first: one with more than HOME_BLOCK home rows or ALL_BLOCK visitors, `larger` times as many, is compared in blocks against
    blocks, and the partitions are as many as the counted bytes need, so no task grows with the table. of_unit: the columns of unit vectors among the features, all unless given; the
    mean of unit vectors is the shorter the more they differ, which tells dense cells.
    """
    n = len(centres)
    dense = 1 - ((centres if of_unit is None else centres[:, of_unit]) ** 2).sum(axis=1) <= radius**2 / 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, every = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            if b.num_rows:
                own, _, cells = visits(decode(b), centres, radius, slack, dense)
                home += np.bincount(own, minlength=n)
                every += np.bincount(cells, minlength=n)
        held = np.flatnonzero(home + every)
        yield pa.RecordBatch.from_pydict({"cell": held.astype(np.int32), "home": home[held], "every": (home + every)[held]})

    home_blocks, all_blocks, total = np.ones(n, np.int64), np.ones(n, np.int64), 0
    for r in rows.mapInArrow(count, "cell INT, home BIGINT, every BIGINT").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("every").alias("every")).collect():  # one row per cell
        home_blocks[r["cell"]] = hb = max(1, -(-r["home"] // (HOME_BLOCK * larger)))
        all_blocks[r["cell"]] = ab = max(1, -(-r["every"] // (ALL_BLOCK * larger)))
        total += r["home"] * (ab - 1) + r["every"] * hb

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b["id"].to_numpy()
            own, guests, cells = visits(decode(b), centres, radius, slack, dense)
            u = kmeans.unit_random(ids, 3)
            row, cell = np.concatenate([np.arange(len(ids)), guests]), np.concatenate([own, cells])
            at_home = np.arange(len(row)) < len(ids)
            hb, ab = home_blocks[cell], all_blocks[cell]
            own_i, own_j = (u[row] * hb).astype(np.int64), (u[row] * ab).astype(np.int64)
            out = []
            for k in range(int(hb.max())):  # among the compared: once per home block
                m = np.flatnonzero(hb > k)
                out.append((m, np.full(len(m), k), own_j[m], np.where(at_home[m] & (own_i[m] == k), 3, 2)))
            for k in range(int(ab[at_home].max())):  # as a home row: in the other blocks of compared rows
                m = np.flatnonzero(at_home & (ab > k) & (own_j != k))
                out.append((m, own_i[m], np.full(len(m), k), np.full(len(m), 1)))
            for m, i, j, role in out:
                if len(m):
                    part = b.take(pa.array(row[m]))
                    ints = [pa.array(v.astype(np.int32)) for v in (cell[m], i, j, role)]
                    yield pa.RecordBatch.from_arrays([*ints, *(part[c] for c in columns)], ["cell", "i", "j", "role", *columns])

    types = dict(rows.dtypes)
    schema = PLACED + "".join(f", {c} {types[c]}" for c in columns)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * 400 // TASK_BYTES))
    return rows.mapInArrow(spread, schema).repartition(parts, "cell", "i", "j")


def roles(pdf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of a block, where each first stands, and the positions among them of home rows and of compared rows."""
    given = pdf["id"].to_numpy()
    ids, first = np.unique(given, return_index=True)
    role = np.zeros(len(ids), np.int64)
    np.bitwise_or.at(role, np.searchsorted(ids, given), pdf["role"].to_numpy())
    return ids, first, np.flatnonzero(role & 1), np.flatnonzero(role & 2)
