"""Scaling, projection and clustering (ML-01..13).

Deterministic kernels (scalers, fixed-centroid assignment, one Lloyd step,
SSE, class merging) are column expressions and grouped aggregates, so they
have an exact SQL twin. Estimators that iterate (k-means, PCA) use MLlib,
which runs each iteration as a distributed aggregate and only keeps the
model (k centroids / n loadings) on the driver.

The inputs here are per-entity aggregate tables (year x airport, year x
route, year x carrier): their size is bounded by the number of entities,
not by the number of flights. Fitted statistics (means, deviations,
quartiles, centroids) are a few numbers per column and enter later stages
as literals.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Blocks of distinct values that exact quantiles are cumulated over.
BLOCKS = 256


# ----------------------------------------------------------------- scalers
def fit_standard(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (std 0 or undefined -> 1)."""
    r = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
               *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (r[f"m_{c}"], r[f"s_{c}"] if r[f"s_{c}"] else 1.0) for c in cols}


def standard_scale(df: DataFrame, cols: list[str], stats: dict | None = None) -> DataFrame:
    """ML-01: (x - mean) / population std, as the reference's scaler."""
    stats = stats or fit_standard(df, cols)
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def quantiles(df: DataFrame, cols: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(FEATURE, SHARE, VALUE): exact quantiles with linear interpolation.

    Values are counted first (partial aggregate), cumulated per feature over
    blocks of about equally many distinct values (cut at sketched quantiles of
    the distinct values, so outliers do not fill one block), and the one or
    two values around each rank are kept: no buffer ever holds a column's
    values. A block has about a 256th of a feature's distinct values.
    """
    counts = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "FEATURE", "V") \
        .where(F.col("V").isNotNull()).groupBy("FEATURE", "V").agg(F.count(F.lit(1)).alias("n"))
    cuts = [i / BLOCKS for i in range(1, BLOCKS)]
    span = counts.groupBy("FEATURE").agg(F.sum("n").alias("total"), F.percentile_approx("V", cuts, 100 * BLOCKS).alias("cuts"))
    d = counts.join(span, "FEATURE").withColumn("part", F.size(F.filter("cuts", lambda e: e < F.col("V")))).drop("cuts")
    parts = d.groupBy("FEATURE", "part").agg(F.sum("n").alias("m"))
    earlier = W.partitionBy("FEATURE").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("FEATURE", "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("FEATURE", "part").orderBy("V").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("upto", F.sum("n").over(inside)).join(parts, ["FEATURE", "part"])
    d = d.withColumn("upto", F.col("upto") + F.col("before"))
    wanted = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("SHARE")
    d = d.select("FEATURE", "V", "n", "upto", "total", wanted)
    rank = F.col("SHARE") * (F.col("total") - 1)
    at = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r), F.col("V")))
    low, high = at(F.floor(rank)), at(F.ceil(rank))
    d = d.groupBy("FEATURE", "SHARE").agg(low.alias("a"), high.alias("b"), F.max(rank - F.floor(rank)).alias("w"))
    return d.select("FEATURE", "SHARE", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("VALUE"))


def fit_robust(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Median and inter-quartile range (exact, linear interpolation)."""
    q = {(r["FEATURE"], r["SHARE"]): r["VALUE"] for r in quantiles(df, cols).collect()}
    return {c: (q[c, 0.5], (q[c, 0.75] - q[c, 0.25]) or 1.0) for c in cols if (c, 0.5) in q}


def robust_scale(df: DataFrame, cols: list[str], stats: dict | None = None) -> DataFrame:
    """ML-02: (x - median) / IQR."""
    stats = stats or fit_robust(df, cols)
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


# ----------------------------------------------------- fixed-centroid kernels
def first_rows(df: DataFrame, order: list[str], cols: list[str], k: int) -> list[list[float]]:
    """Initial centroids: the first k rows in key order (k small)."""
    return [[float(r[c]) for c in cols] for r in df.orderBy(*order).select(*cols).limit(k).collect()]


def _centroid_array(centroids: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centroids])


def nearest(cols: list[str], centroids: list[list[float]]) -> Column:
    """struct(d2, id) of the nearest centroid; ties go to the lower id.

    The centroids are a literal array, so assignment is a projection: no
    join and no pairing of rows with centroids in the plan.
    """
    xs = [F.col(c).cast("double") for c in cols]

    def dist(cen: Column, i: Column) -> Column:
        acc = F.lit(0.0)
        for j, x in enumerate(xs):
            d = x - cen.getItem(j)
            acc = acc + d * d
        return F.struct(acc.alias("d2"), i.alias("id"))

    return F.array_min(F.transform(_centroid_array(centroids), dist))


def assign(df: DataFrame, cols: list[str], centroids: list[list[float]], name: str = "CLASS") -> DataFrame:
    """ML-06: class = index of the nearest centroid; D2 = its squared distance."""
    n = nearest(cols, centroids)
    return df.withColumns({name: n["id"], "D2": F.round(n["d2"], 6)})


def lloyd_step(assigned: DataFrame, cols: list[str], name: str = "CLASS") -> DataFrame:
    """ML-07: new centroid = mean of the members of each class."""
    return assigned.groupBy(name).agg(F.count(F.lit(1)).alias("N"),
                                      *[F.round(F.avg(c), 6).alias(c) for c in cols])


def sse(assigned: DataFrame, name: str = "CLASS") -> DataFrame:
    """ML-08: SSE per class (distance of each row to its own centroid)."""
    return assigned.groupBy(name).agg(F.count(F.lit(1)).alias("N"), F.round(F.sum("D2"), 6).alias("SSE"))


def merge_small(df: DataFrame, by: list[str], name: str = "CLASS", min_size: int = 10,
                other: int = 10000) -> DataFrame:
    """ML-11 + WIN-05: classes with fewer than ``min_size`` members become
    one class, then class ids are re-labelled densely 0..n-1 per group.

    Class sizes come from a grouped count joined back (no window over the
    rows); the relabel window runs over the distinct (group, class) pairs.
    """
    sizes = df.groupBy(*by, name).agg(F.count(F.lit(1)).alias("__n"))
    merged = (df.join(sizes, [*by, name], "left")
              .withColumn(name, F.when(F.col("__n") < min_size, F.lit(other)).otherwise(F.col(name)))
              .drop("__n"))
    return dense_relabel(merged, by, name)


def dense_relabel(df: DataFrame, by: list[str], name: str = "CLASS") -> DataFrame:
    """WIN-05: sorted distinct class ids -> 0..n-1 (per group)."""
    distinct = df.select(*by, name).distinct()
    w = W.partitionBy(*by).orderBy(name) if by else W.orderBy(name)
    codes = distinct.withColumn("__new", F.dense_rank().over(w) - 1)
    return df.join(codes, [*by, name], "left").withColumn(name, F.col("__new")).drop("__new")


def merge_map(df: DataFrame, mapping: dict[int, int], name: str = "CLASS") -> DataFrame:
    """ML-12: manual class merge by a {from: to} map."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(name, F.coalesce(m[F.col(name)], F.col(name)))


def merge_nearest(df: DataFrame, cols: list[str], by: list[str], name: str = "CLASS", min_size: int = 40) -> DataFrame:
    """ML-12, driven by the data: a class (per group) with fewer than
    ``min_size`` members joins the large class whose centroid is nearest to
    its own; ties go to the lower id.

    Sizes and centroids are one aggregate; large classes meet small ones as an
    array of the group's classes, whose number is the k of the clustering, not
    the data's. Groups without a large class, and rows whose class or group is
    NULL, keep their classes. Squared distances are compared to 6 places.
    """
    classes = df.where(F.col(name).isNotNull()).groupBy(*by, name).agg(
        F.count(F.lit(1)).alias("__n"), F.array(*[F.avg(c) for c in cols]).alias("__at"))
    entry = F.when(F.col("__n") >= min_size, F.struct(F.col(name).alias("id"), F.col("__at").alias("at")))
    large = F.collect_list(entry).over(W.partitionBy(*by))

    def dist(c: Column) -> Column:
        sq = F.zip_with("__at", c["at"], lambda a, b: (a - b) * (a - b))
        d2 = F.aggregate(sq, F.lit(0.0), lambda s, v: s + v)
        return F.struct(F.coalesce(F.round(d2, 6), F.lit(float("inf"))).alias("d2"), c["id"].alias("id"))

    target = F.array_min(F.transform("__large", dist))["id"]
    moves = classes.withColumn("__large", large).where(F.col("__n") < min_size) \
        .select(*by, name, target.alias("__to")).where(F.col("__to").isNotNull())
    return df.join(moves, [*by, name], "left").withColumn(name, F.coalesce("__to", name)).drop("__to") \
        .select(*df.columns)


# ------------------------------------------------------------ MLlib fits
def _vec(df: DataFrame, cols: list[str]) -> DataFrame:
    """A NULL feature is an error: rows are imputed before, never dropped."""
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error").transform(df)


def kmeans(df: DataFrame, cols: list[str], k: int, seed: int = 1234, name: str = "CLASS",
           max_iter: int = 30) -> tuple[DataFrame, float, list[list[float]]]:
    """ML-05: k-means fit + assignment; returns (rows with class, cost,
    centroids). Fewer distinct points than k give fewer centroids."""
    v = _vec(df, cols)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol=name).fit(v)
    out = model.transform(v).drop("features")
    return out, float(model.summary.trainingCost), [list(map(float, c)) for c in model.clusterCenters()]


def total_ss(df: DataFrame, cols: list[str]) -> float:
    """SSE of a single cluster (k = 1): squared distance to the mean."""
    r = df.agg(*[(F.var_pop(c) * F.count(c)).alias(c) for c in cols]).first()
    return float(sum(r[c] or 0.0 for c in cols))


def pca(df: DataFrame, cols: list[str], n: int, keep: list[str]) -> tuple[DataFrame, list[float]]:
    """ML-03: PCA to n components on mean-centred data (MLlib's transform
    does not centre). Each component's sign is fixed so that its largest
    loading is positive. Returns (keep + PC1..PCn, explained variance)."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centred = df.withColumns({c: F.col(c) - F.lit(means[c]) for c in cols})
    v = _vec(centred, cols)
    model = PCA(k=n, inputCol="features", outputCol="pc").fit(v)
    pcs = model.pc.toArray()  # (n_features, n)
    signs = []
    for j in range(n):
        col = pcs[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    arr = vector_to_array(F.col("pc"))
    out = model.transform(v).select(*keep, *[(arr.getItem(j) * F.lit(signs[j])).alias(f"PC{j + 1}")
                                             for j in range(n)])
    return out, [float(x) for x in model.explainedVariance.toArray()]
