"""Scores of models made into topics, surroundings and subjects. Inference is a plug-in; scores are columns here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import SUBJECT_TOPICS, TOPICS

#: What the group of a scene stands for, and the topic of that, where it has one.
GROUP_CLUSTERS = {
    "scene_nature": "photo_landscape", "scene_urban": "photo_urban", "scene_architecture": "photo_architecture", "scene_commerce": "photo_commercial", "scene_residential": "photo_indoor",
    "scene_public": "photo_indoor", "scene_transport": "photo_transport", "scene_sports": "photo_event", "scene_industrial": "photo_documentary", "scene_agriculture": "photo_landscape",
}
CLUSTER_TOPICS = {
    "photo_landscape": "photo_landscape", "photo_urban": "photo_street", "photo_architecture": "photo_architecture", "photo_food": "photo_food", "photo_commercial": "photo_still_life",
    "photo_event": "photo_activity", "photo_transport": "photo_vehicle", "photo_plant": "photo_macro",
}
#: Least sum and lead of a scene's topic, share of the ten best leaves that decides in or out of doors, kept evidence.
LEAST_SUM, LEAST_LEAD, OUTDOOR, INDOOR, BEST_LEAVES, KEPT = 0.24, 0.045, 0.65, 0.35, 10, 8
#: Least scores of a person and a face, and the detector's classes of each subject.
PERSON, FACE = 0.45, 0.65
CLASSES = {"animal": list(range(14, 24)), "vehicle": list(range(1, 9)), "food": [39, 40, 41, *range(45, 56)], "plant": [58]}


def leaf_topic(leaf: str, groups: dict[str, str], special: dict[str, str]) -> str | None:
    """Topic of a scene leaf: `special` (leaf to cluster) goes before the cluster of its group in `groups` (leaf to group)."""
    return CLUSTER_TOPICS.get(special.get(leaf) or GROUP_CLUSTERS.get(groups.get(leaf, ""), ""))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def topic_sums(probabilities: Column, topics_of_leaves: list[str | None]) -> Column:
    """Array over TOPICS: the sum of the probabilities of each topic's leaves; leaves without topic count nowhere."""
    sums = []
    for topic in TOPICS:
        of = [F.coalesce(F.get(probabilities, F.lit(i)).cast("double"), F.lit(0.0)) for i, t in enumerate(topics_of_leaves) if t == topic]
        sums.append(reduce(lambda a, b: a + b, of, F.lit(0.0)))
    return F.array(*sums)


def ranked(scores: Column, labels: list[str]) -> Column:
    """Array of (label, score) by falling score, equal ones in the order of `labels`."""
    names = F.array(*map(F.lit, labels))
    return F.transform(F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))), lambda x: F.struct(F.element_at(names, x["i"] + 1).alias("label"), (-x["s"]).alias("score")))


def scene_topic(sums: Column) -> Column:
    """(label, score) of the topic with the greatest sum, if that is enough and leads by enough; else null."""
    order = ranked(sums, TOPICS)
    return F.when((order[0]["score"] >= LEAST_SUM) & (order[0]["score"] - order[1]["score"] >= LEAST_LEAD), order[0])


def surroundings(probabilities: Column, outdoor: list[bool]) -> Column:
    """(label, score): outdoor or indoor by the share of the ten most probable leaves, null between or without any probability."""
    flags = F.array(*map(F.lit, outdoor))
    best = F.slice(F.array_sort(F.transform(probabilities, lambda p, i: F.struct((-p.cast("double")).alias("s"), i.alias("i")))), 1, BEST_LEAVES)
    out = _total(F.transform(F.filter(best, lambda x: F.coalesce(F.get(flags, x["i"]), F.lit(False))), lambda x: -x["s"]))
    share = F.try_divide(out, _total(F.transform(best, lambda x: -x["s"])))
    return F.when(share >= OUTDOOR, F.struct(F.lit("outdoor").alias("label"), share.alias("score"))).when(share <= INDOOR, F.struct(F.lit("indoor").alias("label"), (1 - share).alias("score")))


def best_evidence(evidence: Column) -> Column:
    """The KEPT greatest of an array of (label, score), equal scores by label."""
    return F.transform(F.slice(F.array_sort(F.transform(evidence, lambda x: F.struct((-x["score"]).alias("s"), x["label"].alias("label")))), 1, KEPT), lambda x: F.struct(x["label"].alias("label"), (-x["s"]).alias("score")))


def classified(rows: DataFrame, topics_of_leaves: list[str | None], outdoor: list[bool], leaves: list[str]) -> DataFrame:
    """`rows` (probabilities over `leaves`, scores over TOPICS) with primary, surroundings and evidence: the best of topic scores and leaf probabilities together."""
    p = F.col("probabilities")
    both = F.concat(ranked(F.transform("scores", lambda s: s.cast("double")), TOPICS), ranked(F.transform(p, lambda s: s.cast("double")), leaves))
    return rows.withColumns({"primary": scene_topic(topic_sums(p, topics_of_leaves)), "surroundings": surroundings(p, outdoor), "evidence": best_evidence(both)})


def subjects(detections: DataFrame, faces: DataFrame, key: str = "asset_id") -> DataFrame:
    """(key, label, score): one person or several, never both, and the best of each other class of subject.

    detections (key, class_id, score), faces (key, score: the best face). One person stands with the greater of body and
    face; several with the second best body; a clear face without a body is one person. All are map-side combined
    aggregates: of the persons only the two best are kept.
    """
    is_person = (F.col("class_id") == 0) & (F.col("score") >= PERSON)
    first = detections.groupBy(key).agg(F.count_if(is_person).alias("people"), F.max(F.when(is_person, F.col("score"))).alias("best"), *[F.max(F.when(F.col("class_id").isin(ids) & (F.col("score") > 0), F.col("score"))).alias(n) for n, ids in CLASSES.items()])
    persons = detections.where(is_person).groupBy(key, "score").agg(F.count(F.lit(1)).alias("n"))
    second = persons.groupBy(key).agg(F.max(F.struct("score", "n")).alias("top"), F.max("score").alias("m")).join(persons, key).where((F.col("score") < F.col("m")) | (F.col("top.n") > 1)).groupBy(key).agg(F.max("score").alias("second"))
    x = first.join(second, key, "left").join(faces.groupBy(key).agg(F.max("score").alias("face")), key, "full")
    people = F.coalesce("people", F.lit(0))
    one = F.when(people == 1, F.greatest("best", F.coalesce("face", F.lit(0.0)))).when((people == 0) & (F.col("face") >= FACE), F.col("face"))
    rows = [("single_person", one), ("multiple_people", F.when(people > 1, F.col("second"))), *[(n, F.col(n)) for n in CLASSES]]
    return x.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("label"), c.alias("score")) for n, c in rows])).alias("x")).where("x.score is not null").select(key, "x.label", "x.score")


def fused(topics: DataFrame, found: DataFrame, key: str = "asset_id") -> DataFrame:
    """`topics` (key, primary, evidence) with the subjects of `found` (key, label, score) fused in.

    The best subject that stands for a topic replaces the primary; in the evidence its topic takes the greater score,
    or is added; the KEPT greatest stay. Equal subjects: the last label wins.
    """
    topic = F.create_map(*[F.lit(v) for kv in SUBJECT_TOPICS.items() for v in kv])
    best = found.withColumn("t", topic[F.col("label")]).where("t is not null").groupBy(key).agg(F.max(F.struct("score", "label", "t")).alias("b"))
    x = topics.join(best, key, "left")
    entry = F.struct(F.col("b.t").alias("label"), F.col("b.score").cast("double").alias("score"))
    raised = F.transform("evidence", lambda e: F.struct(e["label"].alias("label"), F.when(e["label"] == F.col("b.t"), F.greatest(e["score"], F.col("b.score").cast("double"))).otherwise(e["score"]).alias("score")))
    there = F.exists("evidence", lambda e: e["label"] == F.col("b.t"))
    mixed = F.when(F.col("b").isNull(), F.col("evidence")).when(there, best_evidence(raised)).otherwise(best_evidence(F.concat(F.col("evidence"), F.array(entry))))
    return x.withColumns({"primary": F.when(F.col("b").isNotNull(), entry).otherwise(F.col("primary")), "evidence": mixed}).drop("b")


def detections(boxes: Column, least: float) -> Column:
    """Best face of one picture from (class, objectness) pairs: the greatest root of their product that reaches `least`, else null."""
    score = F.array_max(F.transform(boxes, lambda b: F.sqrt(F.greatest(b["cls"], F.lit(0.0)) * F.greatest(b["obj"], F.lit(0.0)))))
    return F.when(score >= least, score)
