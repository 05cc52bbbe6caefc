"""Ranks and running sums within keys of any size, over all tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def running(rows: DataFrame, keys: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """`rows` with the running sum of each of `sums` within equal `keys` (none: over all rows), in `order`; F.lit(1) gives row numbers.

    The rows are sorted by range of key and order, so a key with a third of all rows lies in many partitions: each
    sums up its own stretch, and the totals of the stretches before, one row per partition and key, are added. Rows
    that are equal in order share a partition but come in no particular order, so `order` should tell rows apart. Null
    keys are a key. An empty table stays empty.
    """
    by = [F.col(k) for k in keys]
    parts = rows.repartitionByRange(*by, *order) if by or order else rows.repartition(1)
    values = {f"_v{i}": c for i, c in enumerate(sums.values())}
    held = materialise(parts.withColumns({**values, "_part": F.spark_partition_id()}), "running")
    totals = held.groupBy(*keys, "_part").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_ahead") for v in values])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    upto = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.select("*", *[F.sum(v).over(upto).alias(f"{v}_here") for v in values]).join(ahead, same)
    return out.select(*rows.columns, *[(F.col(f"{v}_here") + F.col(f"{v}_ahead")).alias(n) for v, n in zip(values, sums)])


def numbered(rows: DataFrame, order: list[Column], as_: str) -> DataFrame:
    """Row numbers from 1 in a global order."""
    return running(rows, [], order, **{as_: F.lit(1)})


def nearest_rank(rows: DataFrame, key: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(key, n and one column per rank): values at zero-based ranks, each a function of `n`, the number of values of the key.

    Equal values are counted first, so no list of values is collected and a key is spread by ranges of its values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_count"))
    upto = running(counts, [key], [F.col(value)], _upto=F.col("_count"))
    n = upto.groupBy(F.col(key).alias("_key")).agg(F.max("_upto").alias("n"))
    x = upto.join(n, F.col(key).eqNullSafe(F.col("_key")))
    return x.groupBy(key).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(name) for name, rank in ranks.items()])
