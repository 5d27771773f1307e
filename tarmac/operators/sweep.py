"""Evaluation over all thresholds (STA-07, CLS-04).

Scores are counted per value and class first. Prefix sums then run in two levels: inside blocks
of close scores, and over the blocks' totals, of which there are at most BLOCKS + 1. No task sorts
all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCKS = 1 << 14


def score_counts(scored: DataFrame, score: str, target: str) -> DataFrame:
    """THRESHOLD (a score), POS and NEG of every score; rows without score or class don't count."""
    late = F.col(target) == 1
    return scored.where(F.col(score).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(score).alias("THRESHOLD")).agg(
        F.count(F.when(late, 1)).alias("POS"), F.count(F.when(~late, 1)).alias("NEG"))


def with_below(counts: DataFrame) -> DataFrame:
    """Adds POS_BELOW and NEG_BELOW, the rows of smaller scores, and the totals P and N."""
    d = counts.withColumn("_block", F.floor(F.col("THRESHOLD") * BLOCKS))  # scores lie in 0 .. 1
    totals = d.groupBy("_block").agg(F.sum("POS").alias("_p"), F.sum("NEG").alias("_n"))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    zero = F.lit(0).cast("long")
    totals = totals.select("_block", F.coalesce(F.sum("_p").over(before), zero).alias("_pb"),
                           F.coalesce(F.sum("_n").over(before), zero).alias("_nb"),
                           F.sum("_p").over(whole).alias("P"), F.sum("_n").over(whole).alias("N"))
    inside = W.partitionBy("_block").orderBy("THRESHOLD").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({"_pi": F.coalesce(F.sum("POS").over(inside), zero), "_ni": F.coalesce(F.sum("NEG").over(inside), zero)})
    return d.join(totals, "_block").select("THRESHOLD", "POS", "NEG", (F.col("_pi") + F.col("_pb")).alias("POS_BELOW"),
                                           (F.col("_ni") + F.col("_nb")).alias("NEG_BELOW"), "P", "N")


def threshold_sweep(scored: DataFrame, score: str, target: str) -> DataFrame:
    """Confusion counts and rates of ``score >= THRESHOLD`` for every score that occurs; a rate
    over nothing is null."""
    s = with_below(score_counts(scored, score, target))
    tp, fp = F.col("P") - F.col("POS_BELOW"), F.col("N") - F.col("NEG_BELOW")
    s = s.select("THRESHOLD", tp.alias("TP"), fp.alias("FP"), F.col("NEG_BELOW").alias("TN"), F.col("POS_BELOW").alias("FN"))
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    return s.withColumns({
        "PRECISION": rate(F.col("TP"), F.col("TP") + F.col("FP")), "RECALL": rate(F.col("TP"), F.col("TP") + F.col("FN")),
        "FALL_OUT": rate(F.col("FP"), F.col("FP") + F.col("TN")),
        "ACCURACY": rate(F.col("TP") + F.col("TN"), F.expr("TP + FP + TN + FN"))})


def metrics(scored: DataFrame, score: str, target: str, threshold: float) -> DataFrame:
    """One row: confusion counts at the threshold, area under the curve (ties count half), log loss.

    Without rows of both classes the area is null; without rows so is the log loss. Scores of 0
    and 1 are taken as 1e-15 from the end, so a sure miss costs a finite amount.
    """
    s = with_below(score_counts(scored, score, target))
    p = F.greatest(F.least(F.col("THRESHOLD"), F.lit(1 - 1e-15)), F.lit(1e-15))
    up = F.col("THRESHOLD") >= F.lit(threshold)
    n = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c)).otherwise(F.lit(0))), F.lit(0)).cast("long")
    area = F.sum(F.col("POS").cast("double") * (2 * F.col("NEG_BELOW") + F.col("NEG")))
    return s.agg(
        n(up, "POS").alias("TP"), n(up, "NEG").alias("FP"), n(~up, "NEG").alias("TN"), n(~up, "POS").alias("FN"),
        F.round(F.try_divide(area, F.lit(2.0) * F.max("P") * F.max("N")), 6).alias("AUC"),
        F.round(F.try_divide(-F.sum(F.col("POS") * F.log(p) + F.col("NEG") * F.log(1 - p)), F.max("P") + F.max("N")), 6)
        .alias("LOG_LOSS"))
