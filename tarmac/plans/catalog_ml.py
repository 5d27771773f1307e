"""Registrations of the iterative estimators (k-means, PCA) and the
clustering plans built on them. Their results depend on the random start
and on partitioning, so they are checked by invariants (tests/), not by an
oracle. Every fit is an MLlib job over the per-entity feature tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators import aggregates as agg
from tarmac.operators import clean, cluster, stored_fit
from tarmac.plans import features as feat
from tarmac.plans.context import Ctx
from tarmac.registry import query
from tarmac.session import cut_lineage, scratch_path

SEED = feat.SEED
#: Values of the reference's searches (fixed values).
GRID_N, GRID_K = range(1, 6), range(1, 25)
YEAR_AIRPORT_K, YEAR_ROUTE_K, AIRLINE_K, MIN_SIZE = 10, 200, 3, 10
PARALLEL_FITS = 8


def _each(spark, fit: Callable, items: Iterable) -> list:
    """Independent fits side by side: each is a chain of small jobs that
    leaves most of a cluster idle (as MLlib's tuning does)."""
    with ThreadPool(PARALLEL_FITS) as pool:
        return pool.map(inheritable_thread_target(spark)(fit), list(items))


def _airport_pca(c: Ctx, n: int = 2) -> tuple[DataFrame, list[float]]:
    return cluster.pca(c.airport_features, feat.AIRPORT_CLUSTER_FEATURES, n, ["YEAR", "IATA"])


@query("ml_pca")
def q_ml_pca(c: Ctx) -> DataFrame:
    """ML-03: two principal components of the six airport delay features."""
    out, _ = _airport_pca(c, 2)
    return out.select("YEAR", "IATA", F.round("PC1", 6).alias("PC1"), F.round("PC2", 6).alias("PC2"))


@query("ml_pca_norms")
def q_ml_pca_norms(c: Ctx) -> DataFrame:
    """ML-03 with all components: they only turn the space, so a row's
    squared length is its squared distance to the mean (whatever the signs)."""
    n = len(feat.AIRPORT_CLUSTER_FEATURES)
    out, _ = _airport_pca(c, n)
    norm = sum(F.col(f"PC{j + 1}") * F.col(f"PC{j + 1}") for j in range(n))
    return out.select("YEAR", "IATA", F.round(norm, 4).alias("D2"))


@query("ml_kmeans_airport")
def q_ml_kmeans_airport(c: Ctx) -> DataFrame:
    """ML-05: PCA(2) then k-means (K = 10, seed 1234) of airport-years."""
    pcs = cut_lineage(_airport_pca(c, 2)[0])
    out, _, _ = cluster.kmeans(pcs, ["PC1", "PC2"], feat.AIRPORT_K, SEED)
    return out.select("YEAR", "IATA", F.col("CLASS").cast("int").alias("CLASS"))


@query("ml_kmeans_geo")
def q_ml_kmeans_geo(c: Ctx) -> DataFrame:
    """ML-05: k-means (K = 6) on coordinates (the C2 class)."""
    out, _, _ = cluster.kmeans(c.airport_features, feat.GEO, feat.GEO_K, SEED, name="C2")
    return out.select("YEAR", "IATA", F.col("C2").cast("int").alias("C2"))


@query("ml_kmeans_nearest")
def q_ml_kmeans_nearest(c: Ctx) -> DataFrame:
    """ML-05, what any k-means result must hold: every row has one class, its
    centre is the nearest of those returned, and is the mean of its members."""
    f = c.airport_features
    out, _, centres = cluster.kmeans(f, feat.GEO, feat.GEO_K, SEED, max_iter=200)
    near = cluster.assign(out, feat.GEO, centres, "NEAR")
    mean = out.groupBy("CLASS").agg(*[F.avg(x).alias(f"M_{x}") for x in feat.GEO])
    centre = F.element_at(F.array(*[F.array(*[F.lit(v) for v in m]) for m in centres]), F.col("CLASS").cast("int") + 1)
    own = sum((F.col(x) - centre.getItem(j)) ** 2 for j, x in enumerate(feat.GEO))
    off = sum((F.col(f"M_{x}") - centre.getItem(j)) ** 2 for j, x in enumerate(feat.GEO))
    return near.join(mean, "CLASS").select("YEAR", "IATA", (own <= F.col("D2") + 1e-6).alias("NEAREST"),
                                           (off < 1e-6).alias("MEAN"))


@query("ml_kmeans_route")
def q_ml_kmeans_route(c: Ctx) -> DataFrame:
    """ML-05: routes -> 22 scaled features -> PCA(2) -> k-means (K = 21)."""
    return c.route_clusters.select("YEAR", "ORIGIN", "DEST", "C")


@query("ml_airport_clusters")
def q_ml_airport_clusters(c: Ctx) -> DataFrame:
    """ML-14: the cluster table that the modelling table is built from."""
    return c.airport_clusters


@query("pipe_model_table")
def q_pipe_model_table(c: Ctx) -> DataFrame:
    """JOIN-06 with the k-means classes of the cluster tables."""
    from tarmac.plans.catalog_more import model_table
    return model_table(c, c.airport_clusters.select("YEAR", "IATA", "C1", "C2"),
                       c.route_clusters.select("YEAR", "ORIGIN", "DEST", "C"))


def _years(df: DataFrame) -> list[int]:
    return sorted(r["YEAR"] for r in df.select("YEAR").distinct().collect())


@query("ml_kmeans_airline")
def q_ml_kmeans_airline(c: Ctx) -> DataFrame:
    """ML-05 / ML-13: carriers of each year: impute, scale all sums (FLIGHTS
    included), k-means (K = 3)."""
    a = agg.per_airline(c.fl)
    cols = [x for x in a.columns if x not in ("YEAR", "CARRIER")]
    imp = cut_lineage(clean.impute_modes_by(a, cols, ["YEAR"]))

    def fit(y: int) -> DataFrame:
        out, _, _ = cluster.kmeans(cluster.standard_scale(imp.where(F.col("YEAR") == y), cols), cols, AIRLINE_K, SEED)
        return out.select("YEAR", "CARRIER", F.col("CLASS").cast("int").alias("CLASS"))

    return reduce(DataFrame.unionByName, _each(c.spark, fit, _years(imp)))


def grid(c: Ctx, base: DataFrame, features: list[str], keys: list[str], ns: Iterable[int], ks: Iterable[int]) -> DataFrame:
    """ML-09: SSE of k-means over n components x k clusters (k = 1: total sum
    of squares around the mean). Each projection is stored once."""
    rows = []
    for n in ns:
        pcs = cut_lineage(cluster.pca(base, features, n, keys)[0])
        cols = [f"PC{j + 1}" for j in range(n)]

        def fit(k: int, pcs=pcs, cols=cols, n=n) -> tuple[int, int, float]:
            return n, k, cluster.total_ss(pcs, cols) if k == 1 else cluster.kmeans(pcs, cols, k, SEED)[1]

        rows += _each(c.spark, fit, ks)
    return c.spark.createDataFrame(rows, "N int, K int, SSE double")


@query("ml_grid_nk")
def q_ml_grid_nk(c: Ctx) -> DataFrame:
    return grid(c, c.airport_features, feat.AIRPORT_CLUSTER_FEATURES, ["YEAR", "IATA"], GRID_N, GRID_K)


@query("ml_grid_nk_routes")
def q_ml_grid_nk_routes(c: Ctx) -> DataFrame:
    """ML-09 as the reference runs it: over the 22 rescaled route features."""
    scaled = cut_lineage(feat.scaled_routes(c.route_features))
    return grid(c, scaled, feat.ROUTE_CLUSTER_FEATURES, ["YEAR", "ORIGIN", "DEST"], GRID_N, GRID_K)


@query("ml_grid_bounds")
def q_ml_grid_bounds(c: Ctx) -> DataFrame:
    """ML-09, what any grid must hold: no SSE is above that of one class over
    as many components, or below 0; one class over all components has the total
    sum of squares of the features, whatever the random start."""
    cols = feat.AIRPORT_CLUSTER_FEATURES
    g = grid(c, c.airport_features, cols, ["YEAR", "IATA"], range(1, len(cols) + 1), (1, 2, 4, 8))
    one = g.where(F.col("K") == 1).select("N", F.col("SSE").alias("ONE"))
    total = F.when((F.col("N") == len(cols)) & (F.col("K") == 1), F.round("SSE", 2))
    within = (F.col("SSE") >= 0) & (F.col("SSE") <= F.col("ONE") * (1 + 1e-9) + 1e-6)
    return g.join(one, "N").select("N", "K", within.alias("WITHIN"), total.alias("TOTAL_SS"))


@query("ml_elbow")
def q_ml_elbow(c: Ctx) -> DataFrame:
    """ML-10: SSE of k-means over k on scaled airport features."""
    s = cut_lineage(cluster.standard_scale(c.airport_features, feat.AIRPORT_YEAR_FEATURES))

    def fit(k: int) -> tuple[int, float]:
        cols = feat.AIRPORT_YEAR_FEATURES
        return k, cluster.total_ss(s, cols) if k == 1 else cluster.kmeans(s, cols, k, SEED)[1]

    return c.spark.createDataFrame(_each(c.spark, fit, GRID_K), "K int, SSE double")


@query("ml_total_ss")
def q_ml_total_ss(c: Ctx) -> DataFrame:
    """ML-10 at k = 1, which no random start touches: the total sum of
    squares of the scaled airport features, by feature."""
    s = cluster.standard_scale(c.airport_features, feat.AIRPORT_YEAR_FEATURES)
    row = s.agg(*[(F.var_pop(x) * F.count(x)).alias(x) for x in feat.AIRPORT_YEAR_FEATURES])
    return row.unpivot([], feat.AIRPORT_YEAR_FEATURES, "FEATURE", "SSE").withColumn("SSE", F.round("SSE", 4))


def cluster_by_year(c: Ctx, imputed: DataFrame, keys: list[str], scaled: list[str], used: list[str], k: int,
                    min_size: int = MIN_SIZE) -> DataFrame:
    """ML-13: per year: scale -> k-means -> merge classes with fewer than
    ``min_size`` members -> dense re-label."""
    imp = cut_lineage(imputed)

    def fit(y: int) -> DataFrame:
        s = cluster.standard_scale(imp.where(F.col("YEAR") == y), scaled)
        out, _, _ = cluster.kmeans(s, used, k, SEED)
        return out.select("YEAR", *keys, F.col("CLASS").cast("int").alias("CLASS"))

    every = reduce(DataFrame.unionByName, _each(c.spark, fit, _years(imp)))
    return cluster.merge_small(every, ["YEAR"], "CLASS", min_size=min_size)


@query("ml_cluster_airports_by_year")
def q_ml_cluster_airports_by_year(c: Ctx, k: int = YEAR_AIRPORT_K, min_size: int = MIN_SIZE) -> DataFrame:
    """ML-13: airports on (SEC_DEL, WEA_DEL, LAT, LON), modes of the year imputed."""
    imp = clean.impute_modes_by(c.airport_base, feat.AIRPORT_NUMERIC, ["YEAR"])
    return cluster_by_year(c, imp, ["IATA"], feat.AIRPORT_NUMERIC + feat.GEO, feat.AIRPORT_YEAR_FEATURES, k, min_size)


@query("ml_year_classes")
def q_ml_year_classes(c: Ctx, k: int = 3, min_size: int = 2) -> DataFrame:
    """ML-13 with so few classes that years keep several, and what the result
    must hold: ids of a year run from 0, and at most one class (the merged
    one, which has the last id) is smaller than ``min_size``."""
    out = cut_lineage(q_ml_cluster_airports_by_year(c, k, min_size))
    sizes = out.groupBy("YEAR", "CLASS").agg(F.count(F.lit(1)).alias("n"))
    last = F.max("CLASS")
    year = sizes.groupBy("YEAR").agg(
        ((F.min("CLASS") == 0) & (last == F.count(F.lit(1)) - 1) & (last < k + 1)).alias("DENSE"),
        (F.coalesce(F.min(F.when(F.col("n") < min_size, F.col("CLASS"))), last) == last).alias("MERGED"))
    return out.join(year, "YEAR").select("YEAR", "IATA", "DENSE", "MERGED")


@query("ml_cluster_routes_by_year")
def q_ml_cluster_routes_by_year(c: Ctx, k: int = YEAR_ROUTE_K, min_size: int = MIN_SIZE) -> DataFrame:
    """ML-13: routes on all their sums (K = 200)."""
    r = agg.per_route(c.fl)
    cols = [x for x in r.columns if x not in ("YEAR", "ORIGIN", "DEST")]
    return cluster_by_year(c, clean.impute_modes_by(r, cols, ["YEAR"]), ["ORIGIN", "DEST"], cols, cols, k, min_size)


@query("snk_cluster_pipeline")
def q_snk_cluster_pipeline(c: Ctx) -> DataFrame:
    """SNK-07 + ML-03 + ML-05: the route clustering fitted on all years but the
    last, stored, reloaded and applied to all, with what must hold: a row's
    class is that of the model before it was stored, and its centre is the
    nearest of the reloaded ones, in the unseen year too."""
    f, keys = c.route_features, ["YEAR", "ORIGIN", "DEST"]
    years = _years(f)
    path = scratch_path(c.spark, "cluster-pipeline")
    fitted = stored_fit.cluster_pipeline(feat.ROUTE_CLUSTER_FEATURES, 2, feat.ROUTE_K, SEED) \
        .fit(f.where(F.col("YEAR").isin(years[:-1] or years)))
    fitted.save(path)
    again = PipelineModel.load(path)
    out = again.transform(f)
    centres = [list(map(float, m)) for m in again.stages[-1].clusterCenters()]
    before = fitted.transform(f).select(*keys, F.col("CLASS").alias("BEFORE"))
    out = out.select(*keys, "CLASS", stored_fit.holds_nearest(out, centres).alias("NEAREST"))
    return out.join(before, keys).select(*keys, (F.col("CLASS") == F.col("BEFORE")).alias("SAME"), "NEAREST")
