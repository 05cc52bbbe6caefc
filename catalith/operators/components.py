"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise


def _jump(parents: DataFrame) -> DataFrame:
    """Follow pointers (node, parent) to the end by doubling; parents never exceed their node, so there are no cycles."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        once = parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("grand"), F.col("parent").alias("first"))
        far = up.select(F.col("parent").alias("grand"), F.col("grand").alias("far"))
        twice = once.join(far, "grand", "left").select("node", F.coalesce("far", "grand").alias("parent"), "first")
        step = materialise(twice, "jump", moved=F.max((F.col("first") != F.col("parent")).cast("int")))
        discard(parents)
        parents = step.select("node", "parent")
        parents._catalith_path = step._catalith_path
        if not step.measured["moved"]:
            return parents


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an undirected edge list with the smallest node of its component.

    Each round lets every node point to its smallest neighbour, follows the pointers to their ends by doubling, and
    contracts the edges; the edges of a path or a star vanish in one round. A hub with many neighbours costs a
    map-side combined minimum, never a collected list, and its joins are split by AQE. Null ends and loops are
    ignored, except that a loop makes its node known. No edges give an empty table.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    labels = None
    while True:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        nearest = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("parent"))
        roots = _jump(materialise(nearest, "hook"))
        if labels is None:
            merged = materialise(roots.withColumnRenamed("parent", "component"), "labels")
        else:
            merged = materialise(labels.join(roots.select(F.col("node").alias("component"), "parent"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        left = links.where("a <> b").join(roots.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a").join(roots.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        rest = materialise(left.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links", n=F.count(F.lit(1)))
        for old in (roots, labels, links):
            if old is not None:
                discard(old)
        labels, links = merged, rest
        if not rest.measured["n"]:
            discard(rest)
            return labels
