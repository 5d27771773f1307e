"""Grouped aggregates over the flights table (AGG-*).

All are single ``groupBy().agg()`` calls: Spark runs a partial (map-side)
hash aggregate before the shuffle, so a hot key (one airport holding a third
of the flights) costs one pre-aggregated row per task, not a skewed shuffle.
SQL semantics are kept: SUM over an all-null group is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _sums(pairs: list[tuple[str, str]]) -> list[Column]:
    return [F.sum(src).alias(name) for name, src in pairs]


# Output name <- source column, fixed by the reference's aggregate tables.
ORIGIN_SUMS = [("FLIGHTS", "FLIGHTS"), ("DEP_DEL", "DEP_DEL15"), ("DDEL1", "DEP_DELAY"),
               ("DDEL2", "DEP_DELAY_NEW"), ("CANCELLED", "CANCELLED"), ("SEC_DEL", "SECURITY_DELAY"),
               ("CAR_DEL", "CARRIER_DELAY"), ("NAS_DEL", "NAS_DELAY"), ("WEA_DEL", "WEATHER_DELAY"),
               ("LAD_DEL", "LATE_AIRCRAFT_DELAY")]
DEST_SUMS = [("FLIGHTS", "FLIGHTS"), ("ARR_DEL", "ARR_DEL15"), ("ADEL1", "ARR_DELAY"),
             ("ADEL2", "ARR_DELAY_NEW"), ("DIVERTED", "DIVERTED")]
AIRLINE_SUMS = [("FLIGHTS", "FLIGHTS"), ("ARR_DEL", "ARR_DEL15"), ("ADEL1", "ARR_DELAY"),
                ("ADEL2", "ARR_DELAY_NEW"), ("DIVERTED", "DIVERTED"), ("DEP_DEL", "DEP_DEL15"),
                ("DDEL1", "DEP_DELAY"), ("DDEL2", "DEP_DELAY_NEW"), ("CANCELLED", "CANCELLED"),
                ("SEC_DEL", "SECURITY_DELAY"), ("CAR_DEL", "CARRIER_DELAY"), ("NAS_DEL", "NAS_DELAY"),
                ("WEA_DEL", "WEATHER_DELAY"), ("LAD_DEL", "LATE_AIRCRAFT_DELAY")]
ROUTE_SUMS = [("FLIGHTS", "FLIGHTS"), ("ARR_DEL", "ARR_DEL15"), ("DISTANCE", "DISTANCE"),
              ("AIR_TIME", "AIR_TIME"), ("ADEL1", "ARR_DELAY"), ("ADEL2", "ARR_DELAY_NEW"),
              ("DIVERTED", "DIVERTED"), ("DEP_DEL", "DEP_DEL15"), ("DDEL1", "DEP_DELAY"),
              ("DDEL2", "DEP_DELAY_NEW"), ("CANCELLED", "CANCELLED"), ("SEC_DEL", "SECURITY_DELAY"),
              ("CAR_DEL", "CARRIER_DELAY"), ("NAS_DEL", "NAS_DELAY"), ("WEA_DEL", "WEATHER_DELAY"),
              ("LAD_DEL", "LATE_AIRCRAFT_DELAY")]
ROUTE_V2_SUMS = [("DEP_DEL", "DEP_DEL15"), ("ARR_DEL", "ARR_DEL15"), ("DISTANCE", "DISTANCE"),
                 ("AIR_TIME", "AIR_TIME"), ("DDEL1", "DEP_DELAY"), ("DDEL2", "DEP_DELAY_NEW"),
                 ("ADEL1", "ARR_DELAY"), ("ADEL2", "ARR_DELAY_NEW"), ("DIVERTED", "DIVERTED"),
                 ("CANCELLED", "CANCELLED"), ("SEC_DEL", "SECURITY_DELAY"), ("CAR_DEL", "CARRIER_DELAY"),
                 ("NAS_DEL", "NAS_DELAY"), ("WEA_DEL", "WEATHER_DELAY"), ("LAD_DEL", "LATE_AIRCRAFT_DELAY")]


def carrier_bits(fl: DataFrame, codes: DataFrame) -> DataFrame:
    """AGG-05: carriers of each route and month as exact bitmaps that can be merged: one word of
    63 bits per (route, month, WORD). ``codes`` numbers the carriers from 0 (CARRIER, CODE)."""
    bit = F.expr("shiftleft(1L, cast(CODE % 63 as int))")
    return fl.join(codes, "CARRIER").groupBy("YEAR", "MONTH", "ORIGIN", "DEST", F.expr("CODE div 63").alias("WORD")) \
        .agg(F.bit_or(bit).alias("BITS"))


def carriers_over(bits: DataFrame, period: list[str]) -> DataFrame:
    """Distinct carriers per route over longer periods: words are merged, then their bits counted."""
    return bits.groupBy(*period, "ORIGIN", "DEST", "WORD").agg(F.bit_or("BITS").alias("BITS")) \
        .groupBy(*period, "ORIGIN", "DEST").agg(F.sum(F.bit_count("BITS").cast("long")).alias("CARRIERS"))


def per_origin(fl: DataFrame) -> DataFrame:
    """AGG-01: year x origin, ten sums."""
    return fl.groupBy("YEAR", "ORIGIN").agg(*_sums(ORIGIN_SUMS))


def per_destination(fl: DataFrame) -> DataFrame:
    """AGG-02: year x destination, five sums."""
    return fl.groupBy("YEAR", "DEST").agg(*_sums(DEST_SUMS))


def per_airline(fl: DataFrame) -> DataFrame:
    """AGG-03: year x carrier, fourteen sums."""
    return fl.groupBy("YEAR", "CARRIER").agg(*_sums(AIRLINE_SUMS))


def per_route(fl: DataFrame) -> DataFrame:
    """AGG-04: year x origin x destination, sixteen sums."""
    return fl.groupBy("YEAR", "ORIGIN", "DEST").agg(*_sums(ROUTE_SUMS))


def per_route_v2(fl: DataFrame) -> DataFrame:
    """AGG-05: route aggregate with distinct carriers; DISTANCE and AIR_TIME
    become per-flight means (sum / sum(FLIGHTS)).

    Two-level aggregation instead of COUNT(DISTINCT): sums per (route,
    carrier) first (partial aggregation as usual), then per route, where the
    carrier count is a plain count. This avoids the row expansion of Spark's
    distinct-aggregate rewrite; the sums are of integer-valued doubles, so
    the regrouping does not change them.
    """
    names = ["FLIGHTS"] + [n for n, _ in ROUTE_V2_SUMS]
    per_carrier = fl.groupBy("YEAR", "ORIGIN", "DEST", "CARRIER").agg(
        F.sum("FLIGHTS").alias("FLIGHTS"), *_sums(ROUTE_V2_SUMS))
    agg = per_carrier.groupBy("YEAR", "ORIGIN", "DEST").agg(
        F.sum("FLIGHTS").alias("FLIGHTS"),
        F.count("CARRIER").alias("CARRIER"),
        *[F.sum(n).alias(n) for n in names[1:]])
    return agg.withColumns({
        "DISTANCE": F.try_divide("DISTANCE", "FLIGHTS"),
        "AIR_TIME": F.try_divide("AIR_TIME", "FLIGHTS"),
    })


def carrier_year_count(fl: DataFrame, max_year: int | None = None) -> DataFrame:
    """AGG-06: non-null carrier count per (YEAR, CARRIER); optional YEAR bound."""
    src = fl if max_year is None else fl.where(F.col("YEAR") <= max_year)
    return src.groupBy("YEAR", "CARRIER").agg(F.count("CARRIER").alias("CNT"))


def origin_month(fl: DataFrame, airports: DataFrame) -> DataFrame:
    """AGG-07: monthly departure summary for the given airports."""
    src = fl.join(airports.select(F.col("CODE").alias("ORIGIN")), "ORIGIN", "left_semi")
    return src.groupBy("ORIGIN", "YEAR", "MONTH").agg(
        F.sum("FLIGHTS").alias("FLIGHTS"), F.sum("DEP_DELAY_NEW").alias("DELAY"),
        F.sum("DEP_DEL15").alias("DEL15"), F.sum("CANCELLED").alias("CANCELLED"))


def dest_month(fl: DataFrame, airports: DataFrame) -> DataFrame:
    """AGG-08: monthly arrival summary for the given airports."""
    src = fl.join(airports.select(F.col("CODE").alias("DEST")), "DEST", "left_semi")
    return src.groupBy("DEST", "YEAR", "MONTH").agg(
        F.sum("FLIGHTS").alias("FLIGHTS"), F.sum("ARR_DELAY_NEW").alias("DELAY"),
        F.sum("ARR_DEL15").alias("DEL15"), F.sum("DIVERTED").alias("DIVERTED"))


def indicator(c: str) -> Column:
    """FN-12: ``(x > 0) * 1`` with null -> 0."""
    return F.coalesce((F.col(c) > 0).cast("int"), F.lit(0))


def cause_by_weekday(fl: DataFrame, causes: list[str]) -> DataFrame:
    """AGG-09: number of flights delayed by each cause, per weekday."""
    return fl.groupBy("DAY_OF_WEEK").agg(*[F.sum(indicator(c)).alias(c) for c in causes])


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG-12: DISTINCT projection."""
    return df.select(*cols).distinct()


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """AGG-13: counts and shares per value (share over the grand total).

    The total comes from a one-row scalar subquery, not a global window.
    """
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("CNT"))
            .withColumn("SHARE", F.round(F.col("CNT") / total, 6)))


def airport_mean(features: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """AGG-16: mean of every feature per entity over all years."""
    return features.groupBy(key).agg(*[F.round(F.avg(c), 6).alias(c) for c in cols])


def airport_day_traffic(fl: DataFrame) -> DataFrame:
    """WIN-07: departures and arrivals per (date, airport).

    Two partial aggregates joined on (date, airport); both sides are already
    reduced to one row per key so the join is small relative to the input.
    """
    out = fl.groupBy("FL_DATE", F.col("ORIGIN").alias("AIRPORT")).agg(F.sum("FLIGHTS").alias("OUT_FLIGHTS"))
    inn = fl.groupBy("FL_DATE", F.col("DEST").alias("AIRPORT")).agg(F.sum("FLIGHTS").alias("IN_FLIGHTS"))
    return (out.join(inn, ["FL_DATE", "AIRPORT"], "full")
            .select("FL_DATE", "AIRPORT",
                    F.coalesce("OUT_FLIGHTS", F.lit(0.0)).alias("OUT_FLIGHTS"),
                    F.coalesce("IN_FLIGHTS", F.lit(0.0)).alias("IN_FLIGHTS")))


def top_per_year(fl: DataFrame, key: str = "ORIGIN", limit: int = 20) -> DataFrame:
    """WIN-01: top-``limit`` airports per year by departures, code breaks ties.

    The window runs over the per-(year, airport) counts, so each window
    partition holds one row per airport of a year, not the raw flights.
    """
    cnt = fl.groupBy("YEAR", key).agg(F.count(key).alias("CNT"))
    rn = F.row_number().over(W.partitionBy("YEAR").orderBy(F.desc("CNT"), F.asc(key)))
    return cnt.withColumn("RANK", rn).where(F.col("RANK") <= limit)
