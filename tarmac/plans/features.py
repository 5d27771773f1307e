"""Airport and route feature tables (ML-14, ML-15) and their class tables.

Order matters and follows the reference: impute -> derive -> normalise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions.derived import normalize, ratio
from tarmac.operators import aggregates as agg
from tarmac.operators import clean, cluster, joins
from tarmac.session import cut_lineage

# Feature lists of the reference's notebooks (fixed values).
AIRPORT_NUMERIC = ["DEP_FLIGHTS", "DEP_DEL", "DDEL1", "DDEL2", "CANCELLED", "SEC_DEL", "CAR_DEL", "NAS_DEL",
                   "WEA_DEL", "LAD_DEL", "ARR_FLIGHTS", "ARR_DEL", "ADEL1", "ADEL2", "DIVERTED"]
ROUTE_NUMERIC = ["FLIGHTS", "CARRIER", "DEP_DEL", "ARR_DEL", "DISTANCE", "AIR_TIME", "DDEL1", "DDEL2", "ADEL1",
                 "ADEL2", "DIVERTED", "CANCELLED", "SEC_DEL", "CAR_DEL", "NAS_DEL", "WEA_DEL", "LAD_DEL"]
ROUTE_NORM = ["DEP_DEL", "ARR_DEL", "DDEL1", "DDEL2", "ADEL1", "ADEL2", "DIVERTED", "CANCELLED", "SEC_DEL",
              "CAR_DEL", "NAS_DEL", "WEA_DEL", "LAD_DEL", "REC_TIME", "REL_DDEL", "REL_ADEL", "REL_RTIME"]
AIRPORT_CLUSTER_FEATURES = ["REC_TIME", "LAD_DEL", "CAR_DEL", "NAS_DEL", "WEA_DEL", "SEC_DEL"]
AIRPORT_YEAR_FEATURES = ["SEC_DEL", "WEA_DEL", "LAT", "LON"]
ROUTE_CLUSTER_FEATURES = ROUTE_NUMERIC + ["AVE_SPEED", "REC_TIME", "REL_DDEL", "REL_ADEL", "REL_RTIME"]
GEO = ["LAT", "LON"]
# Clusters and manual class merges {from: to} of the reference (fixed values).
AIRPORT_K, GEO_K, ROUTE_K = 10, 6, 21
AIRPORT_MERGE, GEO_MERGE = {6: 1, 8: 3}, {3: 4}
MIN_MEMBERS = 40  # smaller classes are merged
SEED = 1234


def airport_base(fl: DataFrame, airports: DataFrame) -> DataFrame:
    """JOIN-01 + JOIN-02: origin and destination aggregates with coordinates."""
    return joins.with_coords(joins.origin_dest(agg.per_origin(fl), agg.per_destination(fl)), airports)


def airport_features(fl: DataFrame, airports: DataFrame) -> DataFrame:
    """ML-14 feature part: impute (whole-table mode), REC_TIME, then every
    numeric feature but DEP_FLIGHTS divided by DEP_FLIGHTS."""
    # fit (modes) and transform both read the aggregate: checkpoint it once
    # instead of aggregating the flights twice
    base = cut_lineage(airport_base(fl, airports))
    imp = clean.impute_modes(base, AIRPORT_NUMERIC)
    d = imp.withColumn("REC_TIME", F.col("DDEL2") - F.col("ADEL2"))
    return normalize(d, AIRPORT_NUMERIC[1:] + ["REC_TIME"], "DEP_FLIGHTS")


def route_features(fl: DataFrame) -> DataFrame:
    """ML-15: 17 imputed base features + 5 derived, 17 of them per flight."""
    base = cut_lineage(agg.per_route_v2(fl))
    imp = clean.impute_modes(base, ROUTE_NUMERIC)
    d = imp.withColumns({
        "AVE_SPEED": ratio("DISTANCE", "AIR_TIME"),
        "REC_TIME": F.col("DDEL2") - F.col("ADEL2"),
        "REL_DDEL": ratio("DDEL1", "AIR_TIME"),
        "REL_ADEL": ratio("ADEL1", "AIR_TIME"),
    })
    d = d.withColumn("REL_RTIME", ratio("REC_TIME", "AIR_TIME"))
    return normalize(d, ROUTE_NORM, "FLIGHTS")


def airport_classes(features: DataFrame, k1: int = 4, k2: int = 3) -> DataFrame:
    """Deterministic airport classes: C1 on the delay features, C2 on the
    coordinates, each the nearest of fixed centroids (the first k rows in
    (YEAR, IATA) order). Gives the model table stable class ids."""
    c1 = cluster.first_rows(features, ["YEAR", "IATA"], AIRPORT_CLUSTER_FEATURES, k1)
    c2 = cluster.first_rows(features, ["YEAR", "IATA"], GEO, k2)
    return features.select(
        "YEAR", "IATA",
        cluster.nearest(AIRPORT_CLUSTER_FEATURES, c1)["id"].alias("C1"),
        cluster.nearest(GEO, c2)["id"].alias("C2"))


def route_classes(features: DataFrame, k: int = 5) -> DataFrame:
    """Deterministic route classes: fixed first-k-rows centroids on the 22
    scaled features."""
    scaled = scaled_routes(features)
    cen = cluster.first_rows(scaled, ["YEAR", "ORIGIN", "DEST"], ROUTE_CLUSTER_FEATURES, k)
    return scaled.select("YEAR", "ORIGIN", "DEST",
                         cluster.nearest(ROUTE_CLUSTER_FEATURES, cen)["id"].alias("C"))


def scaled_routes(features: DataFrame) -> DataFrame:
    """All 22 route features, imputed (a ratio over zero air time takes the
    feature's mode) and standard-scaled."""
    return cluster.standard_scale(clean.impute_modes(features, ROUTE_CLUSTER_FEATURES), ROUTE_CLUSTER_FEATURES)


def airport_clusters(features: DataFrame) -> DataFrame:
    """ML-14, the cluster table: the feature table with C1 (k-means on two
    principal components of the six delay features) and C2 (k-means on the
    coordinates), each with its manual merge."""
    pcs, _ = cluster.pca(features, AIRPORT_CLUSTER_FEATURES, 2, ["YEAR", "IATA"])
    c1, _, _ = cluster.kmeans(pcs, ["PC1", "PC2"], AIRPORT_K, SEED, name="C1")
    c2, _, _ = cluster.kmeans(features.select("YEAR", "IATA", *GEO), GEO, GEO_K, SEED, name="C2")
    c1 = cluster.merge_map(c1, AIRPORT_MERGE, "C1").select("YEAR", "IATA", F.col("C1").cast("int").alias("C1"))
    c2 = cluster.merge_map(c2, GEO_MERGE, "C2").select("YEAR", "IATA", F.col("C2").cast("int").alias("C2"))
    return features.join(c1, ["YEAR", "IATA"]).join(c2, ["YEAR", "IATA"])


def route_clusters(features: DataFrame) -> DataFrame:
    """ML-15, the cluster table: route features with C (k-means on two
    principal components of the 22 scaled features)."""
    pcs, _ = cluster.pca(scaled_routes(features), ROUTE_CLUSTER_FEATURES, 2, ["YEAR", "ORIGIN", "DEST"])
    c, _, _ = cluster.kmeans(pcs, ["PC1", "PC2"], ROUTE_K, SEED, name="C")
    return features.join(c.select("YEAR", "ORIGIN", "DEST", F.col("C").cast("int").alias("C")),
                         ["YEAR", "ORIGIN", "DEST"])
