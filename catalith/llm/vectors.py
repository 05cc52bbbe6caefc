"""Current usable embeddings of assets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cores
from ..sources.tables import clean_fingerprint, current, latest, table
from .kmeans import matrix

DIMS = 64


def packed(rows: DataFrame, column: str, dims: int = DIMS) -> DataFrame:
    """`rows` with ARRAY<FLOAT> `column` as `vec`, BINARY of float32; rows whose array is null, of another length, all zero or not finite are left out."""
    others = [c for c in rows.columns if c != column]
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in others) + ", vec BINARY"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b[column]
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
            good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
            kept = b.filter(pa.array(good))
            vec = pa.array([v.tobytes() for v in values[good]], pa.binary())
            yield pa.RecordBatch.from_arrays([*(kept[c] for c in others), vec], [*others, "vec"])

    return rows.where(F.size(column) == dims).mapInArrow(run, schema)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def unit32(batch: pa.RecordBatch) -> np.ndarray:
    return unit(matrix(batch["vec"], DIMS)).astype(np.float32)


def directions(rows: DataFrame) -> DataFrame:
    """`rows` (vec BINARY of float32) with `key`, a hash of the direction of vec: equal for vectors that differ in length only."""
    others = [c for c in rows.columns if c != "key"]
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in others) + ", key STRING"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = [hashlib.md5(v.tobytes()).hexdigest() for v in unit32(b) + np.float32(0)]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in others), pa.array(keys)], [*others, "key"])

    return rows.select(*others).mapInArrow(run, schema)


def current_vectors(spark: SparkSession, d: str, version: str = "2.1") -> DataFrame:
    """(id, vec): the vector of each asset whose row is of `version` and of the fingerprint of the asset's current row.

    Of several such rows the one generated last counts. Null and odd fingerprints match nothing.
    """
    outputs = table(spark, d, "semantic_outputs").where(F.col("model_version") == version).select(F.col("asset_id").alias("id"), clean_fingerprint("source_fingerprint").alias("fp"), "generated_at", "embedding")
    if outputs.rdd.getNumPartitions() < cores(spark):
        outputs = outputs.repartition(cores(spark) * 2)
    prints = current(spark, d, "assets", "id", "fingerprint").select("id", clean_fingerprint("fingerprint").alias("fp"))
    # Exact copies are merged while the rows are still spread by id.
    rows = packed(outputs.where("id is not null and fp is not null"), "embedding").join(prints, ["id", "fp"])
    return latest(rows.select("id", "generated_at", "vec"), "id", "generated_at").select("id", "vec")
