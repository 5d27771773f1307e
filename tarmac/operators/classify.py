"""Gaussian naive Bayes of late arrival, fitted and scored relationally
(CLS-*, WIN-06).

Fitting is one grouped aggregate over the training rows (count, mean,
population variance per class and feature) -- a single pass with map-side
partial aggregation, no iteration. The fitted parameters (about twenty
numbers) come back to the driver like any MLlib model and enter scoring as
literals: a narrow projection (no join, no shuffle). Label codes are dense ranks
over the distinct values of the filtered training frame, as a fitted
LabelEncoder would give.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FEATURES = ["CARRIER", "ORIGIN", "DEST", "WEEK_OF_YEAR"]
ENCODED = ["CARRIER", "ORIGIN", "DEST"]
TARGET = "ARR_DEL15"
VAR_SMOOTHING = 1e-9


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """WIN-06: (value, code) with code = rank of the value in byte order - 1.

    The window runs over the distinct values only (a dimension-sized set).
    """
    d = df.select(col).where(F.col(col).isNotNull()).distinct()
    return d.select(F.col(col).alias("VALUE"),
                    (F.dense_rank().over(W.orderBy(col)) - 1).alias("CODE"))


def encode(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """Replace each encoded column by its code (left join; unknown -> NULL)."""
    out = df
    for c, table in codes.items():
        t = table.select(F.col("VALUE").alias(c), F.col("CODE").alias(f"__{c}"))
        out = out.join(t, c, "left").withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
    return out


def training_frame(sub: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """CLS-01: drop rows with any null, label-encode the string columns."""
    clean = sub.dropna(how="any")
    codes = {c: label_codes(clean, c) for c in ENCODED}
    return encode(clean, codes).select(*sub.columns), codes


@dataclass
class GaussianNB:
    """Fitted two-class Gaussian naive Bayes: a handful of numbers."""
    features: list[str]
    params: dict[str, float]  # PRIOR{k}, MEAN{k}_{f}, VAR{k}_{f}, N{k}

    def table(self, spark) -> DataFrame:
        rows = []
        for k in (0, 1):
            rows.append((k, int(self.params[f"N{k}"]), self.params[f"PRIOR{k}"],
                         *[self.params[f"MEAN{k}_{f}"] for f in self.features],
                         *[self.params[f"VAR{k}_{f}"] for f in self.features]))
        cols = (["CLASS int", "N bigint", "PRIOR double"] + [f"MEAN_{f} double" for f in self.features]
                + [f"VAR_{f} double" for f in self.features])
        return spark.createDataFrame(rows, ", ".join(cols))

    @property
    def threshold(self) -> float:
        """CLS-04: share of positive labels in the training rows (= prior)."""
        return self.params["PRIOR1"]


def fit(train: DataFrame, features: list[str] = FEATURES, target: str = TARGET) -> GaussianNB:
    """CLS-02: per-class count, prior, mean and population variance.

    One grouped aggregate (two output rows) plus the global variances, in a
    single job; only those ~20 numbers reach the driver. Like the reference's
    estimator, ``VAR_SMOOTHING * max_j var(x_j)`` is added to every variance.
    A class without rows has prior 0 and no moments; scores are then the
    share of the other class. Without any row all scores are NULL.
    """
    y = F.col(target).cast("int")
    row = train.agg(
        *[F.var_pop(f).alias(f"ALLVAR_{f}") for f in features],
        *[F.count(F.when(y == k, 1)).alias(f"N{k}") for k in (0, 1)],
        *[F.avg(F.when(y == k, F.col(f))).alias(f"MEAN{k}_{f}") for k in (0, 1) for f in features],
        *[F.var_pop(F.when(y == k, F.col(f))).alias(f"VAR{k}_{f}") for k in (0, 1) for f in features],
    ).first().asDict()
    eps = VAR_SMOOTHING * max(row[f"ALLVAR_{f}"] or 0.0 for f in features)
    n = row["N0"] + row["N1"]
    params = {}
    for k in (0, 1):
        params[f"N{k}"] = row[f"N{k}"]
        params[f"PRIOR{k}"] = row[f"N{k}"] / n if n else None
        for f in features:
            params[f"MEAN{k}_{f}"] = row[f"MEAN{k}_{f}"]
            params[f"VAR{k}_{f}"] = None if row[f"VAR{k}_{f}"] is None else row[f"VAR{k}_{f}"] + eps
    return GaussianNB(list(features), params)


def save(model: GaussianNB, codes: dict[str, DataFrame], path: str) -> None:
    """SNK-07: the parameters and the label codes, as two small tables."""
    from functools import reduce

    spark = next(iter(codes.values())).sparkSession
    model.table(spark).write.mode("overwrite").parquet(f"{path}/params")
    parts = [t.select(F.lit(c).alias("FEATURE"), "VALUE", "CODE") for c, t in codes.items()]
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{path}/codes")


def load(spark, path: str) -> tuple[GaussianNB, dict[str, DataFrame]]:
    """The stored model and label codes."""
    t = spark.read.parquet(f"{path}/params")
    features = [c[len("MEAN_"):] for c in t.columns if c.startswith("MEAN_")]
    params = {}
    for r in t.collect():
        k = r["CLASS"]
        params[f"N{k}"], params[f"PRIOR{k}"] = r["N"], r["PRIOR"]
        for f in features:
            params[f"MEAN{k}_{f}"], params[f"VAR{k}_{f}"] = r[f"MEAN_{f}"], r[f"VAR_{f}"]
    codes = spark.read.parquet(f"{path}/codes")
    return GaussianNB(features, params), {c: codes.where(F.col("FEATURE") == c).select("VALUE", "CODE") for c in ENCODED}


def _joint_log_likelihood(m: GaussianNB, k: int) -> Column:
    p = m.params
    acc = F.lit(math.log(p[f"PRIOR{k}"]))
    for f in m.features:
        var = p[f"VAR{k}_{f}"]
        diff = F.col(f).cast("double") - F.lit(p[f"MEAN{k}_{f}"])
        acc = acc - F.lit(0.5 * math.log(2 * math.pi * var)) - diff * diff / F.lit(2.0 * var)
    return acc


def proba(df: DataFrame, model: GaussianNB, name: str = "PROBA") -> DataFrame:
    """CLS-03: posterior P(late | x) = 1 / (1 + exp(jll0 - jll1)); a narrow
    projection with the parameters as literals (stays in codegen). With one
    class, or features that are all constant, it is the share of late rows."""
    constant = not any(model.params[f"VAR{k}_{f}"] for k in (0, 1) for f in model.features)
    if not model.params["N0"] or not model.params["N1"] or constant:
        share = model.params["PRIOR1"]
        known = F.col(model.features[0]).isNotNull()
        for f in model.features[1:]:
            known = known & F.col(f).isNotNull()
        return df.withColumn(name, F.when(known, F.lit(share).cast("double")))
    return df.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(_joint_log_likelihood(model, 0)
                                                                  - _joint_log_likelihood(model, 1))))


def evaluate(scored: DataFrame, thr: float, target: str = TARGET) -> DataFrame:
    """CLS-05 / STA-07: MSE and accuracy of ``PROBA >= threshold``."""
    pred = (F.col("PROBA") >= F.lit(thr)).cast("double")
    err = F.col(target) - pred
    return scored.agg(F.round(F.avg(err * err), 6).alias("MSE"),
                      F.round(F.avg((F.col(target) == pred).cast("double")), 6).alias("ACCURACY"),
                      F.count(F.lit(1)).alias("N"))


def score_requests(parsed: DataFrame, codes: dict[str, DataFrame], model: GaussianNB) -> DataFrame:
    """CLS-06: batch scoring of parsed requests -> percent with 2 decimals.

    Unknown codes give a NULL probability instead of an exception.
    """
    enc = parsed.select("variables", "YEAR", "WEEK_OF_YEAR",
                        F.col("ORIGIN").alias("ORIGIN_CODE"), F.col("DEST").alias("DEST_CODE"),
                        F.col("CARRIER").alias("CARRIER_CODE"),
                        F.col("CARRIER"), F.col("ORIGIN"), F.col("DEST"))
    enc = encode(enc, codes)
    scored = proba(enc, model)
    return scored.select(
        "variables", F.col("ORIGIN_CODE").alias("ORIGIN"), F.col("DEST_CODE").alias("DEST"),
        F.col("CARRIER_CODE").alias("CARRIER"), "YEAR", "WEEK_OF_YEAR",
        F.round(F.col("PROBA") * 100, 2).alias("PROBABILITY"))
