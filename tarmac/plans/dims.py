"""Dimension plans: major airlines / airports, large hubs, flight subsets.

Membership tests are left-semi joins against the (small, aggregated)
dimension instead of IN-lists built on the driver; AQE turns them into
broadcast hash joins once the dimension's real size is known, and falls back
to a shuffled join if it is not small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.aggregates import top_per_year


def major_carriers(fl: DataFrame, max_year: int | None = None) -> DataFrame:
    """PRE-09: carriers with flights in every year present in the data.

    (YEAR, CARRIER) is reduced first (partial aggregate); years per carrier
    and years overall (a one-row scalar subquery) are counted from it.
    """
    src = fl if max_year is None else fl.where(F.col("YEAR") <= max_year)
    yc = src.groupBy("CARRIER", "YEAR").agg(F.count(F.lit(1)).alias("n"))
    n_years = yc.select(F.countDistinct("YEAR")).scalar()
    return (yc.where(F.col("CARRIER").isNotNull()).groupBy("CARRIER").agg(F.count(F.lit(1)).alias("N_YEARS"))
            .where(F.col("N_YEARS") == n_years).select("CARRIER"))


def major_airlines(fl: DataFrame, carriers: DataFrame) -> DataFrame:
    """SUM-05: major carriers with their names (CARRIER, CARRIER_NM)."""
    mc = major_carriers(fl)
    return (carriers.join(mc, carriers.Code == mc.CARRIER, "left_semi")
            .select(F.col("Code").alias("CARRIER"), F.col("Description").alias("CARRIER_NM")).distinct())


def major_airport_codes(fl: DataFrame, limit: int = 20) -> DataFrame:
    """SET-02: union over years of the per-year top airports."""
    return top_per_year(fl, "ORIGIN", limit).select("ORIGIN").distinct()


def major_airports(fl: DataFrame, airports: DataFrame, limit: int = 20) -> DataFrame:
    """SUM-06: major airports with names and coordinates."""
    codes = major_airport_codes(fl, limit)
    return (airports.join(codes, airports.iata == codes.ORIGIN, "left_semi")
            .select(F.col("iata").alias("CODE"), F.col("airport").alias("HUB_NM"), F.col("city").alias("CITY"),
                    F.col("state").alias("STATE"), F.col("lat").alias("LAT"), F.col("lon").alias("LON"))
            .distinct())


SUBSET_COLUMNS = ["YEAR", "MONTH", "DAY_OF_MONTH", "CARRIER", "ORIGIN", "DEST", "FLIGHTS", "DEP_DEL15",
                  "ARR_DEL15", "DEP_DELAY", "ARR_DELAY", "DEP_DELAY_NEW", "ARR_DELAY_NEW", "AIR_TIME",
                  "DISTANCE", "TAXI_IN", "TAXI_OUT", "CANCELLED", "DIVERTED"]


def flights_subset(fl: DataFrame, airlines: DataFrame, airports: DataFrame) -> DataFrame:
    """SUM-04: flights of major carriers between major airports + ISO week."""
    a = airports.select("CODE")
    sub = (fl.select(*SUBSET_COLUMNS)
           .join(airlines.select("CARRIER"), "CARRIER", "left_semi")
           .join(a.withColumnRenamed("CODE", "ORIGIN"), "ORIGIN", "left_semi")
           .join(a.withColumnRenamed("CODE", "DEST"), "DEST", "left_semi"))
    week = F.weekofyear(F.make_date("YEAR", "MONTH", "DAY_OF_MONTH"))
    return sub.select(*SUBSET_COLUMNS, week.alias("WEEK_OF_YEAR"))


def large_hubs(ranks: DataFrame) -> DataFrame:
    """SUM-07: distinct codes ranked as large hubs (Hub == 'L'), null codes out."""
    return ranks.where((F.col("Hub") == "L") & F.col("Locid").isNotNull()).select("Locid").distinct()


def year_sample(fl: DataFrame, airlines: DataFrame, hubs: DataFrame, year: int = 2010) -> DataFrame:
    """SUM-08: one year of flights at large hubs with major airlines."""
    h = hubs.select("Locid")
    return (fl.where(F.col("YEAR") == year)
            .join(airlines.select("CARRIER"), "CARRIER", "left_semi")
            .join(h.withColumnRenamed("Locid", "ORIGIN"), "ORIGIN", "left_semi")
            .join(h.withColumnRenamed("Locid", "DEST"), "DEST", "left_semi"))


def carrier_exclusion(airlines: DataFrame, subset: DataFrame) -> DataFrame:
    """SET-03: major airlines with no flight between major airports."""
    return airlines.join(subset.select("CARRIER").distinct(), "CARRIER", "left_anti")
