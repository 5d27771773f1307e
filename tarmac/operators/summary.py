"""Per-slice delay summaries and the batch request answer (SUM-01..03, 09).

The reference answers one (year, week, carrier, airport) slice per web
request with its own SQL query. Here every slice is computed in one grouped
aggregate and requests are answered by a join on the slice key, so a batch
of a million requests costs one shuffle, not a million queries.

Rates divide by the row count (rows with a null flag count as not late),
mean/std skip nulls, and Python-2 ``int(round(x))`` is HALF_UP ``round``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pct(num: str) -> Column:
    return F.round(F.lit(100.0) * F.sum(num) / F.count(F.lit(1)), 0).cast("int")


def _iround(c: Column) -> Column:
    return F.round(c, 0).cast("int")


def std_samp(col: str) -> Column:
    """Sample standard deviation from exact sums.

    The delays are whole minutes, so the sums are taken as bigint and
    n*sum(x^2) - sum(x)^2 as decimal(38, 0): exact while sum(x^2) is below
    2^63 (4 * 10^12 flights of a day's delay in one slice; beyond, the sum
    raises). Only the final division and square root round. A true 12.5 therefore stays 12.5 and rounds to 13 (an
    incremental algorithm can land on 12.4999... and round to 12).
    """
    x = F.col(col).cast("bigint")
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731  a product of two has 38 digits and one of carry
    n = F.count(x)
    num = (whole(n) * whole(F.sum(x * x)) - whole(F.sum(x)) * whole(F.sum(x))).cast("double")
    return F.when(n >= 2, F.sqrt(F.greatest(num, F.lit(0.0)) / (n * (n - 1))))


ORIGIN_KEY = ["YEAR", "WEEK_OF_YEAR", "CARRIER", "ORIGIN"]
DEST_KEY = ["YEAR", "WEEK_OF_YEAR", "CARRIER", "DEST"]
ROUTE_KEY = ["YEAR", "WEEK_OF_YEAR", "CARRIER", "ORIGIN", "DEST"]


def origin_summary(sub: DataFrame) -> DataFrame:
    """SUM-01: departures per (year, week, carrier, origin)."""
    return sub.groupBy(*ORIGIN_KEY).agg(
        F.count(F.lit(1)).alias("nflights"),
        _pct("DEP_DEL15").alias("delay_rate"),
        _pct("CANCELLED").alias("cd_rate"),
        _iround(F.avg("DEP_DELAY_NEW")).alias("mean_delay_time"),
        _iround(std_samp("DEP_DELAY_NEW")).alias("std_delay_time"))


def destination_summary(sub: DataFrame) -> DataFrame:
    """SUM-02: arrivals per (year, week, carrier, destination)."""
    return sub.groupBy(*DEST_KEY).agg(
        F.count(F.lit(1)).alias("nflights"),
        _pct("ARR_DEL15").alias("delay_rate"),
        _pct("DIVERTED").alias("cd_rate"),
        _iround(F.avg("ARR_DELAY_NEW")).alias("mean_delay_time"),
        _iround(std_samp("ARR_DELAY_NEW")).alias("std_delay_time"))


def _txt(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("NA"))


def route_summary(sub: DataFrame) -> DataFrame:
    """SUM-03: per route slice, values as text, 'NA' where undefined."""
    return sub.groupBy(*ROUTE_KEY).agg(
        F.count(F.lit(1)).cast("string").alias("nflights"),
        _txt(_iround(F.avg("ARR_DELAY_NEW"))).alias("mean_adelay_time"),
        _txt(_iround(F.avg("DEP_DELAY_NEW"))).alias("mean_ddelay_time"),
        _txt(_iround(std_samp("ARR_DELAY_NEW"))).alias("std_adelay_time"),
        _txt(_iround(std_samp("DEP_DELAY_NEW"))).alias("std_ddelay_time"),
        _txt(_pct("ARR_DEL15")).alias("adel_rate"),
        _txt(_pct("DEP_DEL15")).alias("ddel_rate"))


def parse_requests(req: DataFrame) -> DataFrame:
    """FN-05: ``origin__dest__airline__m/d/yyyy`` -> typed request columns."""
    parts = F.split(F.col("variables"), "__")
    d = F.try_to_date(parts.getItem(3), "M/d/yyyy")
    return req.select(
        "variables",
        parts.getItem(0).alias("ORIGIN"), parts.getItem(1).alias("DEST"), parts.getItem(2).alias("CARRIER"),
        d.alias("FL_DATE"), F.year(d).alias("YEAR"), F.weekofyear(d).alias("WEEK_OF_YEAR"))


def _last_year(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("PREV_YEAR", F.col("YEAR") - 1)


def with_defaults(parsed: DataFrame, osum: DataFrame) -> DataFrame:
    """FN-17: origin summary of the same week last year, 100 when empty."""
    p = _last_year(parsed)
    o = osum.withColumnRenamed("YEAR", "PREV_YEAR")
    j = p.join(o, ["PREV_YEAR", "WEEK_OF_YEAR", "CARRIER", "ORIGIN"], "left")
    hundred = F.lit(100)
    return j.select(
        "variables", "ORIGIN", "CARRIER", "PREV_YEAR", "WEEK_OF_YEAR",
        F.coalesce("nflights", F.lit(0).cast("bigint")).alias("nflights"),
        F.when(F.col("nflights").isNull(), hundred).otherwise(F.col("delay_rate")).alias("delay_rate"),
        F.when(F.col("nflights").isNull(), hundred).otherwise(F.col("cd_rate")).alias("cd_rate"),
        F.when(F.col("nflights").isNull(), hundred).otherwise(F.col("mean_delay_time")).alias("mean_delay_time"),
        F.when(F.col("nflights").isNull(), hundred).otherwise(F.col("std_delay_time")).alias("std_delay_time"))


def _prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def requested_slices(sub: DataFrame, parsed: DataFrame) -> DataFrame:
    """The flights that some request asks about: a semi join on (year - 1,
    week, carrier) before anything is aggregated. The distinct years asked for
    (calendar years, so few) become a filter: with flights stored by YEAR only
    those are read."""
    wanted = parsed.select((F.col("YEAR") - 1).alias("YEAR"), "WEEK_OF_YEAR", "CARRIER").distinct()
    years = sorted(r["YEAR"] for r in wanted.select("YEAR").where("YEAR IS NOT NULL").distinct().collect())
    return sub.where(F.col("YEAR").isin(years)).join(wanted, ["YEAR", "WEEK_OF_YEAR", "CARRIER"], "left_semi")


def request_answer(scored: DataFrame, osum: DataFrame, dsum: DataFrame, rsum: DataFrame) -> DataFrame:
    """SUM-09: probability + origin / destination / route summaries of the
    same ISO week one year earlier, with the reference's empty-slice
    defaults (100 for airports, '0' / 'NA' for the route)."""
    p = scored.withColumn("PREV_YEAR", F.col("YEAR") - 1)
    o = _prefixed(osum.withColumnRenamed("YEAR", "PREV_YEAR"), ["PREV_YEAR", "WEEK_OF_YEAR", "CARRIER", "ORIGIN"], "o_")
    d = _prefixed(dsum.withColumnRenamed("YEAR", "PREV_YEAR"), ["PREV_YEAR", "WEEK_OF_YEAR", "CARRIER", "DEST"], "d_")
    r = _prefixed(rsum.withColumnRenamed("YEAR", "PREV_YEAR"),
                  ["PREV_YEAR", "WEEK_OF_YEAR", "CARRIER", "ORIGIN", "DEST"], "r_")
    j = (p.join(o, ["PREV_YEAR", "WEEK_OF_YEAR", "CARRIER", "ORIGIN"], "left")
         .join(d, ["PREV_YEAR", "WEEK_OF_YEAR", "CARRIER", "DEST"], "left")
         .join(r, ["PREV_YEAR", "WEEK_OF_YEAR", "CARRIER", "ORIGIN", "DEST"], "left"))
    out = [F.col("variables"), F.col("PROBABILITY")]
    for side in ("o_", "d_"):
        empty = F.col(side + "nflights").isNull()
        out.append(F.coalesce(F.col(side + "nflights"), F.lit(0).cast("bigint")).alias(side + "nflights"))
        for c in ("delay_rate", "cd_rate", "mean_delay_time", "std_delay_time"):
            out.append(F.when(empty, F.lit(100)).otherwise(F.col(side + c)).alias(side + c))
    out.append(F.coalesce(F.col("r_nflights"), F.lit("0")).alias("r_nflights"))
    for c in ("mean_adelay_time", "mean_ddelay_time", "std_adelay_time", "std_ddelay_time", "adel_rate", "ddel_rate"):
        out.append(F.coalesce(F.col("r_" + c), F.lit("NA")).alias("r_" + c))
    return j.select(*out)
