"""Vector and score expressions on arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double; null where a length differs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """-1 where lengths differ, a vector is empty or has no length."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (n == 0), -1.0).otherwise(dot(a, b) / n)


def cosine_prefix(a: Column, b: Column) -> Column:
    """Over the common length, 0 where a vector has no length; another function than :func:`cosine` on purpose."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    d = norm(x) * norm(y)
    return F.when(d == 0, 0.0).otherwise(dot(x, y) / d)


QUERIES, ROWS = 1024, 8192  #: queries and compared rows of one block


def top_similar(rows: DataFrame, chosen: Column, least: float, k: int) -> DataFrame:
    """(query_id, vec_id, similarity): for each row (vec_id, embedding) that is `chosen`, its k most similar other rows.

    Similarity is the cosine to six decimals, at least `least`; ties go to the smaller id. Every query meets every row:
    blocks of queries against blocks of rows, of which each query keeps its top k. Vectors of another length or
    without length have cosine -1; null vectors are left out.
    """
    rows = rows.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n, m = rows.agg(F.count(F.lit(1)), F.count_if(chosen)).first()
    across, down = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    queries = rows.where(chosen).select("vec_id", "embedding", F.lit(True).alias("asks"), own(down).alias("i"), every(across).alias("j"))
    placed = queries.unionByName(rows.select("vec_id", "embedding", F.lit(False).alias("asks"), every(down).alias("i"), own(across).alias("j")))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        lengths = pdf["embedding"].map(len)
        for size in lengths[pdf["asks"]].unique():
            part = pdf[lengths == size]
            x = np.array(part["embedding"].tolist(), np.float64).reshape(len(part), size)
            norms = np.sqrt(np.einsum("ij,ij->i", x, x))
            ids, asks = part["vec_id"].to_numpy(), part["asks"].to_numpy()
            q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
            for b in range(0, len(q), 256):
                h = q[b : b + 256]
                scale = norms[h][:, None] * norms[r]
                s = np.round(np.divide(x[h] @ x[r].T, scale, out=np.full(scale.shape, -1.0), where=scale > 0), 6)
                i, j = np.nonzero((s >= least) & (ids[h][:, None] != ids[r]))
                found = pd.DataFrame({"query_id": ids[h[i]], "vec_id": ids[r[j]], "similarity": s[i, j]})
                out.append(found.sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

    best = placed.groupBy("i", "j").applyInPandas(block, "query_id BIGINT, vec_id BIGINT, similarity DOUBLE")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def strongest(a: Column, k: int = 4) -> Column:
    """Positions (from 0) of the k components of greatest absolute value, ties to the smaller position."""
    pairs = F.transform(a, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def sigmoid(x: Column) -> Column:
    """Stable on both sides."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
