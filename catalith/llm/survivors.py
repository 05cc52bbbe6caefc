"""One surviving record per group of copies, by skyline selection."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cores, discard, materialise

BLOCK = 100_000  #: members that one task lays out in layers; larger groups are peeled layer by layer over all tasks


def layers(triples: list[tuple]) -> list[int]:
    """The dominance layer of each (completeness, recency, trust): 1 for the undominated, else 1 + the deepest layer that dominates it.

    A triple dominates another when it is at least as great in all three and not equal; equal ones share their layer.
    In falling order a triple comes behind all that dominate it. Each layer keeps the staircase of its undominated
    (recency, trust); being dominated by a layer implies being dominated by those before it, so the layer is found by
    bisection: n log n comparisons for any group.
    """
    stairs: list[tuple[list, list]] = []
    found: dict[tuple, int] = {}
    for triple in sorted(set(triples), reverse=True):
        _, t, u = triple
        low, high = 0, len(stairs)
        while low < high:
            mid = (low + high) // 2
            ts, us = stairs[mid]
            at = bisect_left(ts, t)
            low, high = (mid + 1, high) if at < len(ts) and us[at] >= u else (low, mid)
        if low == len(stairs):
            stairs.append(([], []))
        ts, us = stairs[low]
        at = bisect_left(ts, t)
        while at and us[at - 1] <= u:
            at -= 1
            del ts[at], us[at]
        if at < len(ts) and ts[at] == t:
            del ts[at], us[at]
        ts.insert(at, t)
        us.insert(at, u)
        found[triple] = low + 1
    return [found[t] for t in triples]


def _groups(table: pa.Table) -> Iterator[list[tuple]]:
    """Groups of (grp, complete, recency, trust, key, fields), members in policy order: completeness, recency, trust, then the smallest key."""
    held: dict[object, list[tuple]] = {}
    for row in zip(*(c.to_pylist() for c in table.columns)):
        held.setdefault(row[0], []).append(row)
    for members in held.values():
        members.sort(key=lambda r: (r[1], r[2], r[3], -r[4]), reverse=True)
        yield members


def _table(rows: list[tuple], fields: list[pa.Field]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], [f.name for f in fields])


def _fold(least: int):
    """Whole groups to one row each: (grp, survivor, members, skyline, fields)."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for members in _groups(table):
            if len(members) < least:
                continue
            depth = layers([m[1:4] for m in members])
            ranked = [m for _, m in sorted(zip(depth, members), key=lambda x: x[0])]
            filled = [next((m[f] for m in ranked if m[f] is not None), None) for f in range(5, len(members[0]))]
            out.append((members[0][0], members[0][4], len(members), depth.count(1), *filled))
        types = list(table.schema)
        return _table(out, [types[0], pa.field("survivor", pa.int64()), pa.field("members", pa.int64()), pa.field("skyline", pa.int32()), *types[5:]])

    return run


def _skyline(table: pa.Table) -> pa.Table:
    """The undominated rows of each group; rows whose triple equals an undominated one stay too."""
    keep: list[tuple] = []
    for members in _groups(table):
        keep += [m for m, d in zip(members, layers([m[1:4] for m in members])) if d == 1]
    return _table(keep, list(table.schema))


def _peeled(rows: DataFrame, hot: DataFrame, fields: list[str], schema: str) -> DataFrame:
    """(grp, layer, row columns) of groups too large for one task, as many layers as their fields need.

    A layer is the skyline of what is left: skylines of blocks first, then of their union. A group leaves when every
    field that any of its members has has been met.
    """
    names = rows.columns
    have = [F.max(F.col(f).isNotNull()).alias(f) for f in fields]
    wanted = materialise(rows.groupBy("grp").agg(*have), "wanted")
    left, done, depth = materialise(rows.join(hot, "grp").withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK))).select(*names, "block"), "left"), [], 0
    while True:
        depth += 1
        part = left.groupBy("grp", "block").applyInArrow(lambda t: _skyline(t.drop_columns("block")), schema)
        front = materialise(part.groupBy("grp").applyInArrow(lambda t: _skyline(t), schema), "front", n=F.count(F.lit(1)))
        if not front.measured["n"]:
            break
        done.append(front.withColumn("layer", F.lit(depth)))
        got = front.groupBy("grp").agg(*have)
        after = materialise(wanted.join(got.select("grp", *[F.col(f).alias(f"{f}_got") for f in fields]), "grp").select("grp", *[(F.col(f) & ~F.col(f"{f}_got")).alias(f) for f in fields]), "wanted")
        open_ = after.where(" or ".join(fields)).select("grp")
        rest = materialise(left.join(open_, "grp", "left_semi").join(front.select("grp", "key"), ["grp", "key"], "left_anti").select(*names, "block"), "left")
        discard(left), discard(wanted)
        left, wanted = rest, after
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def best_records(rows: DataFrame, group: str, key: str, recency: str, fields: list[str], trust: str | None = None, least: int = 1) -> DataFrame:
    """(group, survivor, members, skyline, fields): one row per group of at least `least` members.

    rows: `key` (BIGINT) is unique in a group; a field counts as filled when it is not null (make invalid values null
    first). The skyline are the members of a group that none other dominates in (completeness, recency, trust), where
    completeness counts the filled fields, and trust is a number, the seniority of the key (the smaller the more)
    unless a column is named. The survivor is the first of the skyline by completeness, then recency, then trust, then
    smallest key. A field that it lacks comes from the first record that has it, going through the dominance layers
    of all members in turn, each in the same order; a field that no member has stays null.

    Null groups and keys are ignored, a null recency is the oldest, a null trust the least; NaN in a field is null.
    Groups of up to BLOCK members are laid out many to a task; larger ones, which may hold a third of all rows, are
    peeled a layer a round with skylines of blocks, until all their fields are met. An empty table gives no rows.
    """
    f = [f"f{i}" for i in range(len(fields))]
    types = dict(rows.dtypes)
    valid = lambda c: F.when(~F.isnan(c), F.col(c)) if types[c] in ("double", "float") else F.col(c)
    seniority = F.coalesce(F.col(trust).cast("double"), F.lit(float("-inf"))) if trust else -F.col(key).cast("bigint")
    x = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(
        F.col(group).alias("grp"), F.coalesce(F.col(recency).cast("string"), F.lit("")).alias("recency"), seniority.alias("trust"), F.col(key).cast("bigint").alias("key"), *[valid(c).alias(a) for c, a in zip(fields, f)]
    )
    x = x.select("grp", sum((F.col(c).isNotNull().cast("int") for c in f), F.lit(0)).alias("complete"), "recency", "trust", "key", *f)
    kinds = dict(x.dtypes)
    hot = materialise(x.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "hot", n=F.count(F.lit(1)), rows=F.sum("n"))
    small = x.join(hot.select("grp"), "grp", "left_anti") if hot.measured["n"] else x
    columns = ["grp", "survivor", "members", "skyline", *f]
    schema = f"grp {kinds['grp']}, survivor BIGINT, members BIGINT, skyline INT" + "".join(f", {c} {kinds[c]}" for c in f)
    bins = max(cores(rows.sparkSession) * 2, x.rdd.getNumPartitions())
    out = small.withColumn("bin", F.pmod(F.xxhash64("grp"), F.lit(bins))).groupBy("bin").applyInArrow(lambda t: _fold(least)(t.drop_columns("bin")), schema)
    if hot.measured["n"]:
        peeled = _peeled(x.join(hot.select("grp"), "grp", "left_semi"), hot, f, ", ".join(f"{c} {t}" for c, t in kinds.items()))
        w = Window.partitionBy("grp").orderBy("layer", F.desc("complete"), F.desc("recency"), F.desc("trust"), "key")
        placed = peeled.withColumn("at", F.row_number().over(w))
        first = placed.groupBy("grp").agg(F.min_by("key", "at").alias("survivor"), F.count_if(F.col("layer") == 1).cast("int").alias("skyline"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in f])
        out = out.unionByName(first.join(hot.select("grp", F.col("n").alias("members")), "grp").where(F.col("members") >= least).select(columns))
    return out.select(F.col("grp").alias(group), "survivor", "members", "skyline", *[F.col(a).alias(c) for c, a in zip(fields, f)])


def most_common(rows: DataFrame, group: str, value: str, as_: str) -> DataFrame:
    """(group, as_): the value most rows of the group have, the larger on ties; nulls are no value."""
    counts = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.max(F.struct("n", value))[value].alias(as_))
