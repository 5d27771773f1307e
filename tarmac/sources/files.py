"""File sources (SRC-01, 02, 04..12, 14) and the writers that land them.

Readers always pass an explicit schema (no inference pass over the data).
The only Python on the data path is the ZIP decoder (``archives``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.dates import iso_week
from tarmac.session import sql_conf
from tarmac.sources import archives

# ------------------------------------------------------------ on-time files
ONTIME_INT = {"Year", "Quarter", "Month", "DayofMonth", "DayOfWeek", "AirlineID", "OriginCityMarketID",
              "DestCityMarketID", "CRSDepTime", "DepTime", "CRSArrTime", "ArrTime", "DepartureDelayGroups",
              "ArrivalDelayGroups", "DistanceGroup"}
ONTIME_LONG = {"FlightNum"}
ONTIME_STR = {"UniqueCarrier", "Carrier", "TailNum", "Origin", "OriginCityName", "OriginState", "Dest",
              "DestCityName", "DestState", "DepTimeBlk", "ArrTimeBlk", "CancellationCode"}
ONTIME_DATE = {"FlightDate"}
OPEN_MONTHS = 200
ROWS_PER_FILE = 1_000_000


def ontime_schema(names: list[str]) -> T.StructType:
    def typ(n: str) -> T.DataType:
        if n in ONTIME_INT:
            return T.IntegerType()
        if n in ONTIME_LONG:
            return T.LongType()
        if n in ONTIME_STR:
            return T.StringType()
        if n in ONTIME_DATE:
            return T.DateType()
        return T.DoubleType()
    return T.StructType([T.StructField(n, typ(n), True) for n in names])


def land_csv_months(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Land gzipped monthly CSV files under ``Year=Y/Month=M`` (one write job).

    A task keeps one file open per month it holds, so its wide rows are not sorted; beyond
    ``OPEN_MONTHS`` Spark sorts the rest. Files end at ``ROWS_PER_FILE`` rows, since a gzipped
    file is read by one task.
    """
    with sql_conf(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_MONTHS)}):
        (df.write.mode(mode).partitionBy("Year", "Month").option("header", True).option("dateFormat", "yyyy-MM-dd")
         .option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE).csv(path))


def read_csv_months(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """SRC-02: one read over all ``Year=*/Month=*`` folders + ISO week."""
    schema = ontime_schema(names)
    df = (spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd")
          .option("mode", "PERMISSIVE").csv(path))
    return df.select(*names).withColumn("WeekofYear", iso_week("Year", "Month", "DayofMonth"))


def land_zip_months(df: DataFrame, path: str, names: list[str]) -> DataFrame:
    """Write ZIP'd monthly CSV archives (lazily: one row per archive)."""
    return archives.land_archives(df, path, names)


def read_zip_months(spark: SparkSession, path: str, names: list[str],
                    year: int | None = None, month: int | None = None) -> DataFrame:
    """SRC-01: flights of the intact archives (optionally of one year or month); a missing month
    gives an empty frame with the full schema, a corrupt archive no rows."""
    return archives.read_archives(spark, path, ontime_schema(names), year, month).where("fault IS NULL").select(*names)


def bad_archives(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """The archives that ``read_zip_months`` leaves out because they are corrupt."""
    return archives.read_archives(spark, path, ontime_schema(names or ["Year"])).where("fault IS NOT NULL") \
        .select(F.col("archive").alias("path"))


# ------------------------------------------------------------ coordinates (headerless, positional)
COORD_POSITIONS = {"Airport": 1, "Iata": 4, "Latitude": 6, "Longitude": 7, "Altitude": 8, "Timezone": 9}
COORD_TYPES = {6: T.DoubleType(), 7: T.DoubleType(), 8: T.IntegerType(), 9: T.DoubleType(), 0: T.IntegerType()}


def coords_file_frame(airports: DataFrame) -> DataFrame:
    """The 14-column airport file layout (id, name, city, country, IATA,
    ICAO, lat, lon, altitude, time zone, DST, tz name, type, source)."""
    k = F.substring("iata", 2, 2).cast("int")
    return airports.select(
        k.alias("c0"), F.col("airport").alias("c1"), F.col("city").alias("c2"),
        F.when(k % 4 == 3, F.lit("Canada")).otherwise(F.lit("United States")).alias("c3"),
        F.col("iata").alias("c4"), F.concat(F.lit("K"), F.col("iata")).alias("c5"),
        F.col("lat").alias("c6"), F.col("lon").alias("c7"), (k * 100).cast("int").alias("c8"),
        (F.lit(-5.0) - k % 4).alias("c9"), F.lit("A").alias("c10"), F.lit("America/New_York").alias("c11"),
        F.lit("airport").alias("c12"), F.lit("OurAirports").alias("c13"))


def read_coords(spark: SparkSession, path: str, country: str = "United States") -> DataFrame:
    """SRC-04: headerless file, columns picked by position, one country."""
    schema = T.StructType([T.StructField(f"_c{i}", COORD_TYPES.get(i, T.StringType()), True) for i in range(14)])
    df = spark.read.schema(schema).option("header", False).csv(path)
    return df.where(F.col("_c3") == country).select(
        *[F.col(f"_c{i}").alias(name) for name, i in COORD_POSITIONS.items()])


# ------------------------------------------------------------ yearly rank files
def land_rank_years(ranks: DataFrame, path: str, years: list[int]) -> None:
    """One CSV per year whose last two headers differ by year (as the
    published sheets do). ``years`` is the small list of years present."""
    for y in years:
        yy = f"{y % 100:02d}"
        (ranks.where(F.col("Year") == y)
         .select("Rank", "Locid", "Hub", F.col("Enplanement").alias(f"CY {yy} Enplanements"),
                 F.col("Change").alias(f"% Change {yy}"))
         .coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/year={y}"))


def read_rank_years(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: one scan over every year's file; columns go by position (the
    last two headers differ by year), the year is that of the folder."""
    df = (spark.read.schema("Rank int, Locid string, Hub string, Enplanement double, Change double, year int")
          .option("header", True).option("enforceSchema", True).csv(path))
    return df.select(F.col("year").alias("Year"), "Rank", "Locid", "Hub", "Enplanement", "Change")


# ------------------------------------------------------------ lookups
LOOKUP_SCHEMA = "Code string, Description string"


def land_lookup(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_lookup(spark: SparkSession, path: str, schema: str = LOOKUP_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


# Cancellation reasons of the on-time data (fixed values).
CANCELLATION_REASONS = {"A": "Carrier", "B": "Weather", "C": "National Air System", "D": "Security"}


def delay_group_text(g):
    """'Delay between a and b minutes' for the 15-minute groups."""
    lo = g * 15
    return (F.when(g <= -2, F.lit("Delay < -15 minutes"))
            .when(g == -1, F.lit("Delay between -15 and -1 minutes"))
            .when(g >= 12, F.lit("Delay >= 180 minutes"))
            .otherwise(F.concat(F.lit("Delay between "), lo.cast("string"), F.lit(" and "),
                                (lo + 14).cast("string"), F.lit(" minutes"))))


def distance_group_text(g):
    lo = (g - 1) * 250
    return (F.when(g == 1, F.lit("Less Than 250 Miles"))
            .otherwise(F.concat(lo.cast("string"), F.lit("-"), (lo + 249).cast("string"), F.lit(" Miles"))))


# ------------------------------------------------------------ holidays file
HOLIDAY_SCHEMA = "Year int, Date string, Holiday string"


def land_holidays(hol: DataFrame, path: str) -> None:
    (hol.select("Year", F.date_format("Date", "M/d/yy").alias("Date"), "Holiday")
     .coalesce(1).write.mode("overwrite").option("header", True).csv(path))


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: Year, Date ('M/d/yy'), Holiday -> parsed date, Month, ISO Week."""
    h = spark.read.schema(HOLIDAY_SCHEMA).option("header", True).csv(path)
    d = F.to_date("Date", "M/d/yy")
    return h.select("Year", d.alias("Date"), "Holiday").withColumns(
        {"Month": F.month("Date"), "Week": F.weekofyear("Date")})
