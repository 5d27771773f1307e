"""Driver tables -> the flights data model.

The driver ships TPC-H-shaped parquet tables. ``flights`` maps them onto the
on-time-performance schema (one row per flight) with a frozen, documented
projection; the dimension tables (airports, carriers, ranks, requests,
holidays, lookups) are derived from the same inputs so that every query's
work grows with the data.

Everything is lazy DataFrame code: Catalyst prunes the unused columns out of
the parquet scans and AQE picks broadcast vs shuffle joins at run time from
the real sizes (the projection joins lineitem to orders, supplier, customer
and part, any of which can be large at 100 TB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _code(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 2, "0"))


def _block(hr: Column) -> Column:
    hh = F.lpad(hr.cast("string"), 2, "0")
    return F.when(hr < 6, F.lit("0001-0559")).otherwise(F.concat(hh, F.lit("00-"), hh, F.lit("59")))


def _group15(v: Column) -> Column:
    g = F.floor(v / F.lit(15.0))
    return F.when(v.isNull(), None).otherwise(F.greatest(F.lit(-2), F.least(F.lit(12), g)).cast("int"))


def _cause(h: Column, ad: Column, k: int) -> Column:
    part = (F.when(h % 5 == k, ad - h % 7)
            .when((h + 1) % 5 == k, h % 7)
            .otherwise(F.lit(0)))
    return F.when(ad >= 15, part.cast("double"))


def flight_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every column of the flights table follows from: eight narrow columns per flight, so
    that the table's rows are moved in this form. Customers are joined to the orders, not to the
    several times as many lines."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    p = load(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 10).cast("int").alias("bn"))
    oc = o.join(c, c.c_custkey == o.o_custkey).select("o_orderkey", "c_nationkey")
    bn, yr = F.col("bn"), F.col("yr")
    return (li.join(oc, li.l_orderkey == oc.o_orderkey)
            .join(s, s.s_suppkey == li.l_suppkey)
            .where(F.col("s_nationkey") != F.col("c_nationkey"))
            .join(p, p.p_partkey == li.l_partkey)
            .select(
                F.add_months(F.col("l_shipdate"), 180).cast("date").alias("FL_DATE"),
                F.col("s_nationkey").alias("sn"),
                F.col("c_nationkey").alias("cn"),
                "bn",
                F.col("l_partkey").alias("pk"),
                F.col("l_suppkey").alias("sk"),
                (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_suppkey") * 7
                 + F.col("l_linenumber")).alias("h"))
            .withColumn("yr", F.year("FL_DATE"))
            .where((bn <= 15) | (yr >= F.lit(2011) + bn % 4)))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flights table (upper snake case, the reference's ``data`` table)."""
    return flights_of(flight_keys(spark, sf_dir))


def flights_of(keys: DataFrame) -> DataFrame:
    """The flights table of ``flight_keys``, row by row and in their order."""
    h, bn, sn, cn = F.col("h"), F.col("bn"), F.col("sn"), F.col("cn")
    x = (h * 13) % 100
    d = keys.withColumns({
        "x": x,
        "hr": ((h * 7) % 24).cast("int"),
        "dist": F.lit(100) + 25 * ((sn * 7 + cn * 11) % 97),
        "canc": F.when(h % 53 == 0, 1).otherwise(0),
    })
    d = d.withColumn("divt", F.when((h % 53 != 0) & (h % 97 == 1), 1).otherwise(0))
    e = d.withColumns({
        "hr2": ((F.col("hr") + 1 + F.floor(F.col("dist") / F.lit(500.0))) % 24).cast("int"),
        # floor(x^4 / 10^6) in exact integer arithmetic
        "dd": F.when(F.col("canc") == 1, None).otherwise(
            F.floor((F.col("x") * F.col("x") * F.col("x") * F.col("x")) / F.lit(1000000))
            - 15 + bn % 5),
    })
    f = e.withColumn("ad", F.when((F.col("canc") == 1) | (F.col("divt") == 1), None)
                     .otherwise(F.col("dd") + (h * 29) % 31 - 17))

    dd, ad, canc, divt, dist = F.col("dd"), F.col("ad"), F.col("canc"), F.col("divt"), F.col("dist")
    flown = (canc == 0) & (divt == 0)
    base_air = F.floor(dist / F.lit(8.0))
    dbl = lambda v: v.cast("double")
    return f.select(
        F.col("yr").cast("int").alias("YEAR"),
        F.quarter("FL_DATE").alias("QUARTER"),
        F.month("FL_DATE").alias("MONTH"),
        F.dayofmonth("FL_DATE").alias("DAY_OF_MONTH"),
        (F.weekday("FL_DATE") + 1).alias("DAY_OF_WEEK"),
        F.weekofyear("FL_DATE").alias("WEEK_OF_YEAR"),
        F.col("FL_DATE"),
        (F.lit(19000) + bn).cast("int").alias("AIRLINE_ID"),
        _code("C", bn).alias("CARRIER"),
        F.when(h % 211 == 0, None).otherwise(F.concat(F.lit("N"), F.col("pk").cast("string"))).alias("TAIL_NUM"),
        (F.col("sk") * 100 + bn).cast("bigint").alias("FL_NUM"),
        (F.lit(10000) + sn).cast("int").alias("ORIGIN_AIRPORT_ID"),
        _code("A", sn).alias("ORIGIN"),
        F.concat(F.lit("CITY_"), sn.cast("string")).alias("ORIGIN_CITY_NAME"),
        F.concat(F.lit("STATE_"), (sn % 5).cast("string")).alias("ORIGIN_STATE_NM"),
        (F.lit(10000) + cn).cast("int").alias("DEST_AIRPORT_ID"),
        _code("A", cn).alias("DEST"),
        F.concat(F.lit("CITY_"), cn.cast("string")).alias("DEST_CITY_NAME"),
        F.concat(F.lit("STATE_"), (cn % 5).cast("string")).alias("DEST_STATE_NM"),
        dbl(dd).alias("DEP_DELAY"),
        dbl(F.when(dd > 0, dd).when(dd.isNotNull(), F.lit(0))).alias("DEP_DELAY_NEW"),
        dbl(F.when(dd >= 15, 1).when(dd.isNotNull(), 0)).alias("DEP_DEL15"),
        _group15(dd).alias("DEP_DELAY_GROUP"),
        _block(F.col("hr")).alias("DEP_TIME_BLK"),
        dbl(F.when(canc == 0, F.lit(8) + h % 17)).alias("TAXI_OUT"),
        dbl(F.when(canc == 0, F.lit(3) + h % 11)).alias("TAXI_IN"),
        dbl(ad).alias("ARR_DELAY"),
        dbl(F.when(ad > 0, ad).when(ad.isNotNull(), F.lit(0))).alias("ARR_DELAY_NEW"),
        dbl(F.when(ad >= 15, 1).when(ad.isNotNull(), 0)).alias("ARR_DEL15"),
        _group15(ad).alias("ARR_DELAY_GROUP"),
        _block(F.col("hr2")).alias("ARR_TIME_BLK"),
        dbl(canc).alias("CANCELLED"),
        F.when(canc == 1, F.lit("ABCD").substr((F.lit(1) + h % 4).cast("int"), F.lit(1)))
        .alias("CANCELLATION_CODE"),
        dbl(divt).alias("DIVERTED"),
        (F.col("hr") * 100 + h % 60).cast("int").alias("CRS_DEP_TIME"),
        (F.col("hr2") * 100 + h % 60).cast("int").alias("CRS_ARR_TIME"),
        dbl(base_air + 30).alias("CRS_ELAPSED_TIME"),
        dbl(F.when(flown, base_air + h % 20)).alias("AIR_TIME"),
        dbl(F.when(flown, base_air + h % 20 + 8 + h % 17 + 3 + h % 11)).alias("ACTUAL_ELAPSED_TIME"),
        F.lit(1.0).cast("double").alias("FLIGHTS"),
        dbl(dist).alias("DISTANCE"),
        (F.floor(dist / F.lit(250.0)) + 1).cast("int").alias("DISTANCE_GROUP"),
        _cause(h, ad, 0).alias("CARRIER_DELAY"),
        _cause(h, ad, 1).alias("WEATHER_DELAY"),
        _cause(h, ad, 2).alias("NAS_DELAY"),
        _cause(h, ad, 3).alias("SECURITY_DELAY"),
        _cause(h, ad, 4).alias("LATE_AIRCRAFT_DELAY"),
    )


# Column order of the flights table (the partitioned store moves YEAR last;
# readers restore this order).
FLIGHT_COLUMNS = [
    "YEAR", "QUARTER", "MONTH", "DAY_OF_MONTH", "DAY_OF_WEEK", "WEEK_OF_YEAR", "FL_DATE", "AIRLINE_ID", "CARRIER",
    "TAIL_NUM", "FL_NUM", "ORIGIN_AIRPORT_ID", "ORIGIN", "ORIGIN_CITY_NAME", "ORIGIN_STATE_NM", "DEST_AIRPORT_ID",
    "DEST", "DEST_CITY_NAME", "DEST_STATE_NM", "DEP_DELAY", "DEP_DELAY_NEW", "DEP_DEL15", "DEP_DELAY_GROUP",
    "DEP_TIME_BLK", "TAXI_OUT", "TAXI_IN", "ARR_DELAY", "ARR_DELAY_NEW", "ARR_DEL15", "ARR_DELAY_GROUP",
    "ARR_TIME_BLK", "CANCELLED", "CANCELLATION_CODE", "DIVERTED", "CRS_DEP_TIME", "CRS_ARR_TIME",
    "CRS_ELAPSED_TIME", "AIR_TIME", "ACTUAL_ELAPSED_TIME", "FLIGHTS", "DISTANCE", "DISTANCE_GROUP",
    "CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY",
]

# Camel-case names of the monthly on-time files, in file order, as
# (camel name, upper-snake source column). Fixed values of the data model.
CAMEL_COLUMNS = [
    ("Year", "YEAR"), ("Quarter", "QUARTER"), ("Month", "MONTH"), ("DayofMonth", "DAY_OF_MONTH"),
    ("DayOfWeek", "DAY_OF_WEEK"), ("FlightDate", "FL_DATE"), ("UniqueCarrier", "CARRIER"),
    ("AirlineID", "AIRLINE_ID"), ("Carrier", "CARRIER"), ("TailNum", "TAIL_NUM"), ("FlightNum", "FL_NUM"),
    ("Origin", "ORIGIN"), ("OriginCityName", "ORIGIN_CITY_NAME"), ("OriginState", "ORIGIN_STATE_NM"),
    ("OriginCityMarketID", "ORIGIN_AIRPORT_ID"), ("Dest", "DEST"), ("DestCityName", "DEST_CITY_NAME"),
    ("DestState", "DEST_STATE_NM"), ("DestCityMarketID", "DEST_AIRPORT_ID"), ("CRSDepTime", "CRS_DEP_TIME"),
    ("DepTime", "CRS_DEP_TIME"), ("DepDelay", "DEP_DELAY"), ("DepDelayMinutes", "DEP_DELAY_NEW"),
    ("DepDel15", "DEP_DEL15"), ("DepartureDelayGroups", "DEP_DELAY_GROUP"), ("DepTimeBlk", "DEP_TIME_BLK"),
    ("TaxiOut", "TAXI_OUT"), ("TaxiIn", "TAXI_IN"), ("CRSArrTime", "CRS_ARR_TIME"), ("ArrTime", "CRS_ARR_TIME"),
    ("ArrDelay", "ARR_DELAY"), ("ArrDelayMinutes", "ARR_DELAY_NEW"), ("ArrDel15", "ARR_DEL15"),
    ("ArrivalDelayGroups", "ARR_DELAY_GROUP"), ("ArrTimeBlk", "ARR_TIME_BLK"), ("Cancelled", "CANCELLED"),
    ("CancellationCode", "CANCELLATION_CODE"), ("Diverted", "DIVERTED"), ("CRSElapsedTime", "CRS_ELAPSED_TIME"),
    ("ActualElapsedTime", "ACTUAL_ELAPSED_TIME"), ("AirTime", "AIR_TIME"), ("Flights", "FLIGHTS"),
    ("Distance", "DISTANCE"), ("DistanceGroup", "DISTANCE_GROUP"), ("CarrierDelay", "CARRIER_DELAY"),
    ("WeatherDelay", "WEATHER_DELAY"), ("NASDelay", "NAS_DELAY"), ("SecurityDelay", "SECURITY_DELAY"),
    ("LateAircraftDelay", "LATE_AIRCRAFT_DELAY"),
]

CAUSE_COLUMNS = ["CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY"]


def flights_camel(fl: DataFrame) -> DataFrame:
    """The 49-column camel-case on-time layout (``flights_data``) + WeekofYear."""
    return fl.select(*[F.col(src).alias(camel) for camel, src in CAMEL_COLUMNS],
                     F.col("WEEK_OF_YEAR").alias("WeekofYear"))


# ---------------------------------------------------------------- dimensions

def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airport dimension (iata, airport, city, state, lat, lon), from nation.

    Nation 24 is left out so that inner coordinate joins really drop a row.
    """
    n = load(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.where(k != 24).select(
        _code("A", k).alias("iata"),
        F.col("n_name").alias("airport"),
        F.concat(F.lit("CITY_"), k.cast("string")).alias("city"),
        F.concat(F.lit("STATE_"), (k % 5).cast("string")).alias("state"),
        (F.lit(25) + (k * 7) % 24).cast("double").alias("lat"),
        (F.lit(-70) - (k * 11) % 53).cast("double").alias("lon"),
    )


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier dimension (Code, Description) from the part brands."""
    p = load(spark, sf_dir, "part").select("p_brand").distinct()
    return p.select(
        _code("C", F.substring("p_brand", 7, 10).cast("int")).alias("Code"),
        F.concat(F.col("p_brand"), F.lit(" Airways (1990 - )")).alias("Description"),
    )


def ranks(fl: DataFrame) -> DataFrame:
    """Yearly airport ranking (Year, Rank, Locid, Hub, Enplanement, Change).

    Departures per (year, airport) ranked within the year; A23 and the last
    year are left out and each year has a footer row with null code, so the
    left joins and null filters downstream have something to do.
    """
    from pyspark.sql import Window as W

    per = (fl.where((F.col("YEAR") <= 2015) & (F.col("ORIGIN") != "A23"))
           .groupBy("YEAR", "ORIGIN").agg(F.count(F.lit(1)).alias("n")))
    rk = F.row_number().over(W.partitionBy("YEAR").orderBy(F.desc("n"), F.asc("ORIGIN")))
    body = per.withColumn("rk", rk).select(
        F.col("YEAR").alias("Year"),
        F.col("rk").alias("Rank"),
        F.col("ORIGIN").alias("Locid"),
        F.when(F.col("rk") <= 8, "L").when(F.col("rk") <= 16, "M").otherwise("S").alias("Hub"),
        (F.col("n") * 1000).cast("double").alias("Enplanement"),
        ((F.col("n") * 7) % 21 - 10).cast("double").alias("Change"),
    )
    footer = (fl.where(F.col("YEAR") <= 2015).select(F.col("YEAR").alias("Year")).distinct()
              .select("Year", F.lit(None).cast("int").alias("Rank"), F.lit(None).cast("string").alias("Locid"),
                      F.lit(None).cast("string").alias("Hub"), F.lit(None).cast("double").alias("Enplanement"),
                      F.lit(None).cast("double").alias("Change")))
    return body.unionByName(footer)


def requests(fl: DataFrame) -> DataFrame:
    """Batch of prediction requests ``origin__dest__airline__m/d/yyyy``.

    Every distinct (route, carrier, date) that was flown, plus one request
    with an unknown destination code.
    """
    r = (fl.select("ORIGIN", "DEST", "CARRIER", "YEAR", "MONTH", "DAY_OF_MONTH").distinct()
         .select(F.concat_ws("__", "ORIGIN", "DEST", "CARRIER",
                             F.concat_ws("/", F.col("MONTH").cast("string"), F.col("DAY_OF_MONTH").cast("string"),
                                         F.col("YEAR").cast("string"))).alias("variables")))
    spark = fl.sparkSession
    unknown = spark.range(1).select(F.lit("A00__ZZZ__C01__6/15/2012").alias("variables"))
    return r.unionByName(unknown)
