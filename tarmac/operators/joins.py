"""Joins of the airport / route feature work (JOIN-*).

All joins are equi-joins. Dimension-sized sides (airports, ranks, per-year
aggregates, holiday calendars) are left to AQE, which broadcasts them once
their materialised size is known and keeps a shuffled join otherwise; the
skew-join rule splits a hot key if a shuffled side is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarmac.functions.dates import iso_dow
from tarmac.functions.derived import label_text


def origin_dest(per_origin: DataFrame, per_dest: DataFrame) -> DataFrame:
    """JOIN-01: origin aggregate x destination aggregate on (YEAR, airport),
    colliding names resolved as DEP_FLIGHTS / ARR_FLIGHTS, key -> IATA."""
    o = per_origin.withColumnsRenamed({"ORIGIN": "IATA", "FLIGHTS": "DEP_FLIGHTS"})
    d = per_dest.withColumnsRenamed({"DEST": "IATA", "FLIGHTS": "ARR_FLIGHTS"})
    return o.join(d, ["YEAR", "IATA"], "inner")


def with_coords(df: DataFrame, airports: DataFrame, key: str = "IATA") -> DataFrame:
    """JOIN-02: inner join with coordinates (airports without any drop out)."""
    a = airports.select(F.col("iata").alias(key), F.col("lat").alias("LAT"), F.col("lon").alias("LON"))
    return df.join(a, key, "inner")


def rank_left(classes: DataFrame, ranks: DataFrame) -> DataFrame:
    """JOIN-03: classes LEFT JOIN ranks on (YEAR, IATA) = (Year, Locid);
    the result's names are upper-cased (PRJ-05)."""
    r = ranks.select(F.col("Year").alias("__y"), F.col("Locid").alias("__l"), "Rank", "Enplanement", "Change")
    j = classes.join(r, (F.col("YEAR") == F.col("__y")) & (F.col("IATA") == F.col("__l")), "left")
    j = j.drop("__y", "__l")
    return j.toDF(*[c.upper() for c in j.columns])


def role_join(flights: DataFrame, airports: DataFrame, role: str, suffix: str) -> DataFrame:
    """JOIN-04/05: attach an airport table in one role (ORIGIN or DEST);
    its columns get the role suffix."""
    feats = [c for c in airports.columns if c not in ("YEAR", "IATA")]
    a = airports.select(F.col("YEAR"), F.col("IATA").alias(role),
                        *[F.col(c).alias(f"{c}_{suffix}") for c in feats])
    return flights.join(a, ["YEAR", role], "left")


def holiday_week(weekly: DataFrame, hol: DataFrame) -> DataFrame:
    """JOIN-09: weekly series LEFT JOIN holidays of the same (year, ISO week),
    by the year of the date itself (New Year may be observed a year early);
    the holidays of a week become one label 'weekday - name; ...' ordered by
    date (a week holds at most a few holidays)."""
    h = (hol.select(F.year("Date").alias("YEAR"), F.col("Week").alias("WEEK_OF_YEAR"), "Date",
                    label_text(iso_dow(F.col("Date")), F.col("Holiday")).alias("label"))
         .groupBy("YEAR", "WEEK_OF_YEAR")
         .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("Date", "label"))),
                                       lambda s: s["label"]), "; ").alias("HOLIDAYS")))
    return weekly.join(h, ["YEAR", "WEEK_OF_YEAR"], "left")


def nearest_asof(left: DataFrame, right: DataFrame, day: str, by: list[str] | None = None, width: int = 32) -> DataFrame:
    """JOIN-10 for calendars of any size: the nearest day of ``right`` to each distinct
    (by, day) of ``left``, the earlier one on ties.

    Days are cut into buckets of ``width``. Inside a bucket (of one ``by``) sorted windows carry
    the last day seen and the next one; each bucket's first and last day are carried across
    buckets on a table of one row per (by, bucket). So nothing is paired, and a window holds one
    bucket's distinct days. Returns by, day, NEAREST and DAYS_TO (signed); both are null where
    ``right`` has no day. Null days are left out; null ``by`` values meet each other.
    """
    by = by or []
    one = F.col(day)
    mine = left.where(one.isNotNull()).select(*by, one.alias("_d")).distinct().withColumn("_r", F.lit(None).cast("date"))
    theirs = right.where(one.isNotNull()).select(*by, one.alias("_d")).distinct().withColumn("_r", F.col("_d"))
    bucket = F.floor(F.unix_date("_d") / F.lit(width))
    rows = mine.withColumn("_mine", F.lit(True)).unionByName(theirs.withColumn("_mine", F.lit(False))) \
        .groupBy(*by, "_d").agg(F.max("_r").alias("_r"), F.max("_mine").alias("_mine")).withColumn("_b", bucket)

    inside = W.partitionBy(*by, "_b").orderBy("_d")
    rows = rows.withColumns({"_before": F.max("_r").over(inside.rowsBetween(W.unboundedPreceding, 0)),
                             "_after": F.min("_r").over(inside.rowsBetween(0, W.unboundedFollowing))})
    across = W.partitionBy(*by, F.lit(0)).orderBy("_b")
    edges = rows.groupBy(*by, "_b").agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    edges = edges.select(*by, "_b", F.max("_hi").over(across.rowsBetween(W.unboundedPreceding, -1)).alias("_prev"),
                         F.min("_lo").over(across.rowsBetween(1, W.unboundedFollowing)).alias("_next"))
    same = F.col("a._b") == F.col("e._b")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"e.{c}"))
    got = rows.where("_mine").alias("a").join(edges.alias("e"), same).select(
        *[F.col(f"a.{c}").alias(c) for c in by], "_d", F.coalesce("_before", "_prev").alias("_before"),
        F.coalesce("_after", "_next").alias("_after"))
    # least and greatest distances skip nulls; a tie takes the earlier day
    nearer = F.col("_after").isNull() | (F.datediff("_d", "_before") <= F.datediff("_after", "_d"))
    near = F.when(F.col("_before").isNotNull() & nearer, F.col("_before")).otherwise(F.col("_after"))
    return got.select(*by, F.col("_d").alias(day), near.alias("NEAREST"), F.datediff(near, F.col("_d")).alias("DAYS_TO"))


def nearest_holiday(dates: DataFrame, hol: DataFrame, date_col: str = "FL_DATE") -> DataFrame:
    """JOIN-10: closest holiday to each distinct date (absolute distance,
    earlier holiday on ties).

    The calendar (ten rows a year, so bounded by the span of years) is read
    once and inlined as a literal array; each date picks the minimum of
    (|days|, holiday date) over it -- no join and no pairing of flights with
    holidays. Run on distinct dates, then join the result back if needed.
    """
    rows = hol.select("Date", "Holiday").orderBy("Date", "Holiday").collect()
    cal = F.array(*[F.struct(F.lit(r["Date"]).alias("Date"), F.lit(r["Holiday"]).alias("Holiday")) for r in rows])
    d = F.col(date_col)
    best = F.array_min(F.transform(
        cal, lambda h: F.struct(F.abs(F.datediff(h["Date"], d)).alias("dist"), h["Date"].alias("hdate"),
                                h["Holiday"].alias("name"))))
    return (dates.select(date_col).distinct()
            .select(date_col, best["hdate"].alias("HOLIDAY_DATE"), best["name"].alias("HOLIDAY"),
                    F.datediff(best["hdate"], d).alias("DAYS_TO_HOLIDAY")))
