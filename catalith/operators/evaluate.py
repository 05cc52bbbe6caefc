"""Choosing labels from scores, and measuring the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running

#: The margins of the sweep.
MARGINS = [0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10]


def select_primary(scores: Column, thresholds: Column, labels: Column, margin: float) -> Column:
    """The best label if it reaches its threshold and leads the second by `margin`; ties go to the earlier one."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    best, second = ranked[0], ranked[1]
    ok = (-best["s"] >= F.element_at(thresholds, best["i"] + 1)) & (second["s"] - best["s"] >= margin - 1e-12)
    return F.when(ok, F.element_at(labels, best["i"] + 1))


def classification_report(rows: DataFrame) -> DataFrame:
    """Per label: expected, predicted and true positives, precision and recall (null where nothing was predicted or expected).

    rows (expected, predicted): arrays of labels.
    """
    pairs = rows.select(F.explode(F.array_union("expected", "predicted")).alias("label"), "expected", "predicted")
    flags = pairs.select("label", F.array_contains("expected", F.col("label")).alias("e"), F.array_contains("predicted", F.col("label")).alias("p"))
    sums = flags.groupBy("label").agg(F.count_if("e").alias("expected"), F.count_if("p").alias("predicted"), F.count_if(F.col("e") & F.col("p")).alias("hits"))
    return sums.withColumns({"precision": F.try_divide("hits", "predicted"), "recall": F.try_divide("hits", "expected")})


def confusion(rows: DataFrame) -> DataFrame:
    """(expected, predicted, n): how often each expected label met each best guess; a missing guess is 'inference_error'.

    rows (expected ARRAY, top ARRAY: guesses, the best first).
    """
    guess = F.coalesce(F.get("top", F.lit(0)), F.lit("inference_error"))
    return rows.select(F.explode("expected").alias("expected"), guess.alias("predicted")).groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: samples, top1, top3, micro and macro precision and recall, unknown ratio; null where there is nothing to divide by.

    rows (expected ARRAY, predicted ARRAY, top ARRAY). 'unknown' counts in none of the micro and macro figures; the
    macro figures run over the labels that are expected somewhere, missing ratios as 0.
    """
    known = lambda c: F.array_except(c, F.array(F.lit("unknown")))
    x = rows.select(
        "expected", "predicted", F.coalesce(F.array_contains("expected", F.get("top", F.lit(0))), F.lit(False)).alias("t1"), F.arrays_overlap("expected", F.slice("top", 1, 3)).alias("t3"), F.array_contains("predicted", "unknown").alias("unknown"),
        F.size(F.array_intersect(known("expected"), known("predicted"))).alias("tp"), F.size(known("predicted")).alias("p"), F.size(known("expected")).alias("e"),
    )
    whole = x.agg(
        F.count(F.lit(1)).alias("samples"), F.try_divide(F.count_if("t1"), F.count(F.lit(1))).alias("top1"), F.try_divide(F.count_if(F.coalesce("t3", F.lit(False))), F.count(F.lit(1))).alias("top3"),
        F.try_divide(F.sum("tp"), F.sum("p")).alias("micro_precision"), F.try_divide(F.sum("tp"), F.sum("e")).alias("micro_recall"), F.try_divide(F.count_if("unknown"), F.count(F.lit(1))).alias("unknown_ratio"),
    )
    per = classification_report(rows).where("label <> 'unknown' and expected > 0")
    macro = per.agg(F.avg(F.coalesce("precision", F.lit(0.0))).alias("macro_precision"), F.avg(F.coalesce("recall", F.lit(0.0))).alias("macro_recall"))
    return whole.join(F.broadcast(macro))  # one row beside one row


def margin_sweep(rows: DataFrame, thresholds: DataFrame, target_precision: float) -> DataFrame:
    """(margin, accepted, hits, precision, macro_recall, coverage, recommended) for every margin of the sweep, in one pass.

    rows (label: best guess, score, second, correct BOOLEAN), thresholds (label, threshold, positives: expected
    samples). A guess is accepted when it reaches the threshold of its label and leads by the margin; macro recall is
    the average over the labels of `thresholds`. Recommended is the margin of the greatest macro recall among those
    that meet the precision, the smallest of equal ones; none may.
    """
    x = rows.join(F.broadcast(thresholds), "label", "left").where("threshold is null or score >= threshold").withColumn("lead", F.col("score") - F.col("second"))
    m = F.explode(F.array(*[F.lit(float(v)) for v in MARGINS])).alias("margin")
    per = x.select("label", "positives", "lead", "correct", m).where(F.col("lead") >= F.col("margin") - 1e-12).groupBy("margin", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"), F.max("positives").alias("positives"))
    labels, everything = thresholds.agg(F.count(F.lit(1)).alias("labels")), rows.agg(F.count(F.lit(1)).alias("all"))
    recall = F.sum(F.when(F.col("positives").isNotNull(), F.col("k") / F.greatest("positives", F.lit(1))))
    sums = per.groupBy("margin").agg(F.sum("n").alias("accepted"), F.sum("k").alias("hits"), recall.alias("recalls"))
    margins = rows.sparkSession.createDataFrame([(float(v),) for v in MARGINS], "margin DOUBLE")
    zero = F.lit(0).cast("bigint")
    y = margins.join(sums, "margin", "left").join(F.broadcast(labels)).join(F.broadcast(everything)).select(
        "margin", F.coalesce("accepted", zero).alias("accepted"), F.coalesce("hits", zero).alias("hits"), F.try_divide("hits", "accepted").alias("precision"),
        F.try_divide(F.coalesce("recalls", F.lit(0.0)), "labels").alias("macro_recall"), F.try_divide(F.coalesce("accepted", zero), "all").alias("coverage"),
    )
    best = y.where(F.col("precision") >= target_precision).agg(F.max(F.struct(F.coalesce("macro_recall", F.lit(0.0)).alias("r"), (-F.col("margin")).alias("m")))["m"].alias("b"))
    return y.join(F.broadcast(best)).select("margin", "accepted", "hits", "precision", "macro_recall", "coverage", F.coalesce(F.col("margin") == -F.col("b"), F.lit(False)).alias("recommended"))


def recommended_thresholds(rows: DataFrame, target_precision: float = 0.85, least: int = 8) -> DataFrame:
    """(label, threshold, accepted, hits): the distinct score that keeps the precision and has the most hits, the lowest such.

    rows (label, score, correct). Running counts over the distinct scores of each label, spread by ranges of scores;
    labels with fewer than `least` correct rows get none.
    """
    per = rows.groupBy("label", "score").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"))
    cum = running(per, ["label"], [F.desc("score")], accepted=F.col("n"), hits=F.col("k"))
    cum = cum.join(cum.groupBy("label").agg(F.max("hits").alias("all")), "label")
    good = cum.where((F.col("all") >= least) & (F.col("hits") >= target_precision * F.col("accepted")))
    best = good.groupBy("label").agg(F.max(F.struct("hits", (-F.col("score")).alias("low"), "accepted")).alias("b"))
    return best.select("label", (-F.col("b.low")).alias("threshold"), "b.accepted", "b.hits")
