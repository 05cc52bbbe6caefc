"""Most similar vectors: inverted file of coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialise
from . import cells, kmeans
from .vectors import DIMS, directions, unit, unit32

PARTS, CODES = 8, 256  #: sub-vectors and codewords of each
FOUND = "id BIGINT, neighbour BIGINT, cosine DOUBLE"


class Index:
    """Coarse centroids and codebooks; small (lists * DIMS + DIMS * CODES floats), so it travels with the tasks."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of residuals, and how far each residual is from what its codes stand for."""
        width = residuals.shape[1] // PARTS
        found = [kmeans.nearest(np.ascontiguousarray(residuals[:, p * width : (p + 1) * width]), self.books[p]) for p in range(PARTS)]
        return np.column_stack([which[:, 0] for which, _ in found]), np.sqrt(sum(far[:, 0] for _, far in found))

    def tables(self, residual_queries: np.ndarray) -> np.ndarray:
        """Asymmetric distances (query, part, code): squared distance of each sub-query to each codeword."""
        width = residual_queries.shape[1] // PARTS
        out = np.empty((len(residual_queries), PARTS, self.books.shape[1]), np.float32)
        for p in range(PARTS):
            q, book = residual_queries[:, p * width : (p + 1) * width], self.books[p]
            out[:, p] = (q * q).sum(1)[:, None] - 2 * q @ book.T + (book * book).sum(1)
        return out


def fit_index(vectors: DataFrame, n: int, sample_rows: int = 65_536) -> Index:
    """An index of about sqrt(n) lists, fitted on at most about `sample_rows` vectors (at least 64 a list), drawn by a hash of the id."""
    lists = max(1, min(math.isqrt(n), kmeans.MOST))
    want = max(sample_rows, 64 * lists)
    sample = vectors if n <= want else vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * want / n))
    sample = materialise(sample.select("id", "vec"), "sample")
    centres = kmeans.fit(sample, lists, DIMS, decode=unit32, seeding_rounds=2, lloyd_rounds=2)
    if not len(centres):
        return Index(centres, np.zeros((PARTS, 1, DIMS // PARTS), np.float32))

    few = min(1.0, 16_384 / max(1, min(n, want)))

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pick = kmeans.unit_random(b["id"].to_numpy(), 11) < few
            if pick.any():
                x = unit32(b)[pick]
                r = x - centres[kmeans.nearest(x, centres)[0][:, 0]]
                yield pa.RecordBatch.from_pydict({"vec": [v.tobytes() for v in r]})

    drawn = sample.mapInArrow(residuals, "vec BINARY").collect()  # about 16 384 residuals, 4 MB
    discard(sample)
    r = kmeans.matrix(sorted(x["vec"] for x in drawn), DIMS) if drawn else np.zeros((1, DIMS), np.float32)
    width = DIMS // PARTS
    books = np.zeros((PARTS, CODES, width), np.float32)
    for p in range(PARTS):
        book = kmeans.weighted_kmeans(np.ascontiguousarray(r[:, p * width : (p + 1) * width]), np.ones(len(r)), CODES, rounds=4, seed=p)
        books[p, : len(book)] = book
        books[p, len(book) :] = book[0]
    return Index(centres, books)


def _best(a: np.ndarray, b: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct links a -> b the k of each a with the greatest score, then the smallest b."""
    order = np.lexsort((b, -score, a))
    a, b, score = a[order], b[order], score[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    a, b, score = a[new], b[new], score[new]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    return a[rank < k], b[rank < k], score[rank < k]


def _search(index: Index, k: int, least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, first, home, every = cells.roles(pdf)
        none = pd.DataFrame({"id": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        if not len(home) or not len(every):
            return none
        x = unit(kmeans.matrix(pdf["vec"].iloc[first].tolist(), DIMS))
        centre = index.centres[int(pdf["cell"].iloc[0])]
        listed, whole = x[home], np.arange(len(home))
        codes, error = index.encode((listed - centre).astype(np.float32))
        # What lies within the radius lies, by its codes, within the radius and its own coding error: nothing is missed.
        within = ((math.sqrt(max(0.0, 2 - 2 * least)) + error + 1e-3) ** 2).astype(np.float32)
        links: list[tuple[np.ndarray, ...]] = []
        chunk = max(16, min(512, 2_000_000 // len(home)))
        for at in range(0, len(every), chunk):
            rows = every[at : at + chunk]
            q = x[rows]
            tables = index.tables((q - centre).astype(np.float32))
            distance = np.take(tables[:, 0], codes[:, 0], axis=1)
            for p in range(1, PARTS):
                distance += np.take(tables[:, p], codes[:, p], axis=1)
            i, j = np.nonzero(distance <= within)
            if len(i) > distance.size // 32:
                cosine = np.round(q @ listed.T, 6)
                i, j = np.nonzero((cosine >= least) & (distance <= within))
                cosine = cosine[i, j]
            else:
                cosine = np.round(np.einsum("ij,ij->i", q[i], listed[j]), 6)
            keep = (cosine >= least) & (rows[i] != home[j])
            i, j, cosine = rows[i[keep]], home[j[keep]], cosine[keep]
            links.append(_best(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([cosine, cosine]), k))
            if len(links) > 32:
                links = [_best(*map(np.concatenate, zip(*links)), k)]
        a, b, cosine = map(np.concatenate, zip(*links)) if links else (whole[:0],) * 3
        if not len(a):
            return none
        a, b, cosine = _best(a, b, cosine, k)
        return pd.DataFrame({"id": ids[a], "neighbour": ids[b], "cosine": cosine})

    return run


def most_similar(vectors: DataFrame, k: int = 5, least: float = 0.90, slack: float | None = cells.SLACK) -> DataFrame:
    """(id, neighbour, cosine, rank): for every vector its k most similar others with a cosine of `least` or more.

    vectors (id, vec BINARY of float32), one row per id; rows with a null are left out. Equal directions are merged
    first: the smallest id of each is indexed and asks for all, so a third of all rows being copies costs a third
    less. Every vector lies in the list of its nearest coarse centroid, and visits the lists whose border it is near
    (see cells.visits); a list is scanned by asymmetric distances to the product codes of its vectors, and all within the
    radius plus the coding error of the vector are reranked by exact cosines, rounded to six decimals, ties to the
    smaller id. What meets in a list is found for both sides, and nothing within it is missed.

    With slack=None no pair can be missed at all, at several times the cost; the recall of the default is in the README. Lists too large for one
    task are searched in blocks. An empty table gives an empty result.
    """
    keyed = materialise(directions(vectors.select("id", "vec").where("id is not null and vec is not null")).select("id", "key", "vec"), "directions")
    groups = materialise(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "groups", n=F.count(F.lit(1)), most=F.max("n"))
    n, several = groups.measured["n"], (groups.measured["most"] or 0) > 1
    base = keyed.select("id", "vec")
    if several:
        copies = materialise(keyed.join(groups.where("n > 1").select("key", "rep"), "key").select("rep", "id"), "copies")
        base = materialise(keyed.join(groups.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "vec"), "base")
        discard(keyed)
    discard(groups)
    index = fit_index(base, n)
    if not len(index.centres):
        return base.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(1).alias("rank")).limit(0)
    placed = cells.place(base, index.centres, math.sqrt(2 - 2 * least), slack, unit32, ["id", "vec"])
    found = placed.groupBy("cell", "i", "j").applyInPandas(_search(index, k, least), FOUND)
    # A pair may be found in two lists. One shuffle by id serves both the merging and the choice.
    links = found.repartition("id").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    order = [F.desc("cosine"), F.col("neighbour")]
    if several:
        # k keys hold the k best ids: of each of them the first k ids are enough, and k + 1 of the own key.
        firsts = copies.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("at") <= k + 1)
        held = materialise(firsts.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids")), "copies")
        links = links.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("at") <= k)
        links = links.join(held.withColumnRenamed("rep", "neighbour"), "neighbour", "left").select("id", F.explode(F.coalesce("ids", F.array("neighbour"))).alias("neighbour"), "cosine")
        links = links.unionByName(held.select(F.col("rep").alias("id"), F.explode("ids").alias("neighbour"), F.lit(1.0).alias("cosine")))
        links = materialise(links.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("at") <= k + 1).drop("at"), "links")
        others = links.withColumnRenamed("id", "rep").join(copies.where("id <> rep"), "rep").select("id", "neighbour", "cosine")
        links = links.unionByName(others).where("id <> neighbour")
    best = links.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("id", "neighbour", "cosine", "rank")
