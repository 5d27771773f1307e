"""Column statistics (STA-*, ML-04).

Every statistic over many columns is computed in ONE aggregate pass; the
histogram bins rows with a column expression and counts per bin.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(cols: list[str], with_diag: bool) -> list[tuple[str, str]]:
    p = list(combinations(cols, 2))
    if with_diag:
        p += [(c, c) for c in cols]
    return p


def corr_matrix(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """STA-02: Pearson correlation of every ordered pair, pairwise-complete
    (per group of ``by``).

    A row becomes one row per pair of features, NULL in both where either is;
    covariance and deviations of a pair come from one grouped aggregate with
    partial aggregation, whatever the number of features. A constant column
    has no correlation (NULL; Spark's ``corr`` fails on it under ANSI mode).
    """
    by = by or []

    # one small expression for any number of features: values by position,
    # then every pair of positions
    n = len(cols)
    values = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in cols])

    def pair(a, b):
        both = a["v"].isNotNull() & b["v"].isNotNull()
        return F.struct(a["f"].alias("F1"), b["f"].alias("F2"), F.when(both, a["v"]).alias("x"), F.when(both, b["v"]).alias("y"))

    each = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.transform(
        F.slice("_values", i, F.lit(n)), lambda y: pair(F.element_at("_values", i), y)))
    pairs = df.select(*by, values.alias("_values")).select(*by, F.inline(F.flatten(each)))
    m = pairs.groupBy(*by, "F1", "F2").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"),
                                           F.stddev_pop("y").alias("sy"))
    r = F.col("c") / (F.col("sx") * F.col("sy"))
    r = F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.when(F.col("F1") == F.col("F2"), F.lit(1.0)).otherwise(
        F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)), 6)))
    m = m.select(*by, "F1", "F2", r.alias("CORR"))
    sides = F.when(F.col("F1") == F.col("F2"), F.array(F.struct("F1", "F2"))).otherwise(
        F.array(F.struct("F1", "F2"), F.struct(F.col("F2").alias("F1"), F.col("F1").alias("F2"))))
    return m.select(*by, F.explode(sides).alias("p"), "CORR").select(*by, "p.F1", "p.F2", "CORR")


def corr_filter(corr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """STA-03: largest |r| of each feature with any other feature, and
    whether it stays below the threshold (a 'low correlation' feature)."""
    m = (corr.where(F.col("F1") != F.col("F2")).groupBy("F1")
         .agg(F.max(F.abs("CORR")).alias("MAX_ABS_CORR")))
    return m.select(F.col("F1").alias("FEATURE"), "MAX_ABS_CORR",
                    F.coalesce(F.col("MAX_ABS_CORR") < threshold, F.lit(True)).alias("LOW"))


def covariance(df: DataFrame, cols: list[str]) -> DataFrame:
    """ML-04: sample covariance of every unordered pair and the diagonal."""
    aggs = [F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in _pairs(cols, True)]
    row = df.agg(*aggs)
    long = row.unpivot([], row.columns, "PAIR", "COV")
    parts = F.split(F.col("PAIR"), r"\|")
    return long.select(parts.getItem(0).alias("F1"), parts.getItem(1).alias("F2"), F.round("COV", 6).alias("COV"))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """STA-04: fixed-width histogram on [min, max] with the right edge in
    the last bin; density = count / (n * width). A constant column uses
    [min - 0.5, max + 0.5]. Empty bins are reported with count 0.

    min / max / n are one aggregate row (fitted first, like bin edges);
    binning is then a projection with literal edges and the counts a grouped
    aggregate -- no sort, no collect of values.
    """
    x = F.col(col).cast("double")
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    lo_v, hi_v, n_v = r["lo"], r["hi"], r["n"]
    if lo_v is None:
        lo_v, hi_v = 0.0, 1.0
    if lo_v == hi_v:
        lo_v, hi_v = lo_v - 0.5, hi_v + 0.5
    lo = F.lit(float(lo_v))
    width = F.lit((float(hi_v) - float(lo_v)) / bins)
    st = {"n": F.lit(int(n_v))}
    b = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("BIN")).agg(F.count(F.lit(1)).alias("CNT"))
    spark = df.sparkSession
    allbins = spark.range(bins).select(F.col("id").cast("int").alias("BIN"))
    j = allbins.join(counts, "BIN", "left")
    return j.select(
        "BIN",
        F.round(lo + F.col("BIN") * width, 6).alias("LOWER"),
        F.round(lo + (F.col("BIN") + 1) * width, 6).alias("UPPER"),
        F.coalesce("CNT", F.lit(0)).alias("CNT"),
        F.round(F.coalesce("CNT", F.lit(0)) / (st["n"] * width), 6).alias("DENSITY"))


def three_sigma(df: DataFrame, col: str) -> DataFrame:
    """STA-06: keep rows within mean +- 3 sample std of ``col`` (NULL kept
    out). Mean and std are a one-row scalar subquery."""
    st = df.agg(F.struct(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).alias("s")).scalar()
    return df.where(F.abs(F.col(col) - st["m"]) <= F.lit(3.0) * st["s"])
