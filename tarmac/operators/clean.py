"""Cleaning: null profiles, deterministic mode imputation, typed casts,
column drops (PRE-06..08, PRJ-02/03/06, IMP-01..03, AGG-14).

Modes are computed as grouped counts, never by gathering a column's values
into one task: the table is unpivoted to (feature, value), counted with a
partial aggregate, and the most frequent value per feature (lowest value on
ties, as scipy's mode) is kept. The result has one row per feature (or per
year and feature), so it is safe to bring to the driver -- the same way an
MLlib ``Imputer`` fits its surrogates -- or to join back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.ByteType, T.DecimalType)
WHOLE = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DateType, T.BooleanType, T.TimestampType)
#: column type that each kind of value is counted in
CARRIER = {"int": "bigint", "num": "double", "str": "string"}


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, WHOLE):
        return "int"
    return "num" if isinstance(dtype, (T.DoubleType, T.FloatType)) else "str"


def _carried(df: DataFrame, c: str):
    """The column as the type it is counted in, without loss: whole numbers,
    dates, timestamps and booleans as bigint, decimals and text as text."""
    dt, x = df.schema[c].dataType, F.col(c)
    if isinstance(dt, T.DateType):
        x = F.unix_date(x)
    elif isinstance(dt, T.TimestampType):
        x = F.unix_micros(x)
    return x.cast(CARRIER[_kind(dt)]).alias(c)


def mode_table(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """AGG-14: (by..., FEATURE, INT, NUM, STR) with the mode of every column
    in the column of its kind.

    Columns of each kind are unpivoted (one Expand, no per-row structs),
    counted per (feature, value) with a partial aggregate, and reduced per
    feature; ties go to the lowest value (text in byte order, decimals by
    value). Whole numbers stay whole, so they are exact beyond 2^53.
    """
    by = by or []
    decimals = {c for c in cols if isinstance(df.schema[c].dataType, T.DecimalType)}
    parts = []
    for kind, typ in CARRIER.items():
        mine = [c for c in cols if _kind(df.schema[c].dataType) == kind]
        if not mine:
            continue
        cnt = (df.select(*by, *[_carried(df, c) for c in mine]).unpivot(by, mine, "FEATURE", "V")
               .where(F.col("V").isNotNull()).groupBy(*by, "FEATURE", "V").agg(F.count(F.lit(1)).alias("CNT")))
        rank = [(-F.col("CNT")).alias("c"), F.col("V").alias("v")]
        if decimals & set(mine):
            rank.insert(1, F.when(F.col("FEATURE").isin(*decimals), F.col("V").try_cast("decimal(38,18)")).alias("d"))
        parts.append(cnt.groupBy(*by, "FEATURE").agg(F.min_by("V", F.struct(*rank)).alias("V")).select(
            *by, "FEATURE", *[(F.col("V") if t == typ else F.lit(None).cast(t)).alias(k.upper())
                              for k, t in CARRIER.items()]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Whole-table mode per column, as Python values (one per column)."""
    kinds = {c: _kind(df.schema[c].dataType) for c in cols}
    out: dict[str, object] = {c: None for c in cols}
    for r in mode_table(df, cols).collect():
        out[r["FEATURE"]] = r[kinds[r["FEATURE"]].upper()]
    return out


def _restored(value, dt: T.DataType):
    """A carried value as a column of the original type."""
    if isinstance(dt, T.DateType):
        return F.date_from_unix_date(value.cast("int"))
    if isinstance(dt, T.TimestampType):
        return F.timestamp_micros(value)
    return value.cast(dt)


def impute_modes(df: DataFrame, cols: list[str], modes: dict[str, object] | None = None) -> DataFrame:
    """IMP-01/02: replace NULL by the column's whole-table mode; a column
    without any value stays NULL. Types are kept."""
    modes = fit_modes(df, cols) if modes is None else modes
    repl = {}
    for c in cols:
        v = modes.get(c)
        if v is None:
            continue
        repl[c] = F.coalesce(F.col(c), _restored(F.lit(v), df.schema[c].dataType))
    return df.withColumns(repl) if repl else df


def impute_modes_by(df: DataFrame, cols: list[str], by: list[str], default: float = 0.0) -> DataFrame:
    """IMP-03: NULL -> mode of the same group (e.g. year); all-null -> default.

    The per-group modes are pivoted to one row per group and joined back on
    the group key (a small table that AQE broadcasts).
    """
    modes = mode_table(df, cols, by).withColumn("V", F.coalesce(F.col("INT").cast("string"), F.col("NUM").cast("string"),
                                                                 F.col("STR")))
    modes = modes.groupBy(*by).pivot("FEATURE", cols).agg(F.first("V"))
    m = modes.select(*by, *[F.col(c).alias(f"__mode_{c}") for c in cols])
    j = df.join(m, by, "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"__mode_{c}").cast(df.schema[c].dataType),
                                 F.lit(default).cast(df.schema[c].dataType)).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def null_profile(df: DataFrame) -> DataFrame:
    """PRE-08 / IMP-04: (FEATURE, N_NULL) for every column with a NULL.

    One aggregate row with a null count per column, unpivoted.
    """
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = row.unpivot([], df.columns, "FEATURE", "N_NULL")
    return long.where(F.col("N_NULL") > 0)


# Column groups of the on-time file by target type (fixed by the reference).
DATE_FEATURES = ["FlightDate"]
INT_FEATURES = ["Year", "Quarter", "Month", "DayofMonth", "DayOfWeek", "WeekofYear", "AirlineID", "FlightNum",
                "OriginCityMarketID", "DestCityMarketID", "DepTime", "CRSDepTime", "DepDel15", "ArrTime",
                "CRSArrTime", "ArrDel15", "DepartureDelayGroups", "ArrivalDelayGroups", "Cancelled", "Diverted",
                "DistanceGroup", "Flights"]
FLOAT_FEATURES = ["DepDelay", "DepDelayMinutes", "TaxiOut", "TaxiIn", "ArrDelay", "ArrDelayMinutes",
                  "CRSElapsedTime", "ActualElapsedTime", "AirTime", "Distance", "CarrierDelay",
                  "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay"]
STR_FEATURES = ["UniqueCarrier", "Carrier", "TailNum", "Origin", "OriginCityName", "OriginState", "Dest",
                "DestCityName", "DestState", "DepTimeBlk", "ArrTimeBlk", "CancellationCode"]


def typed_cast(df: DataFrame) -> DataFrame:
    """PRJ-06: cast each feature group to its type (text via try_cast)."""
    out = []
    for c in DATE_FEATURES:
        out.append(F.col(c).cast("date").alias(c))
    for c in INT_FEATURES:
        out.append(F.col(c).try_cast("bigint").alias(c))
    for c in FLOAT_FEATURES:
        out.append(F.col(c).try_cast("double").alias(c))
    for c in STR_FEATURES:
        out.append(F.col(c).cast("string").alias(c))
    return df.select(*out)


# Leakage / duplicate columns dropped before modelling (fixed by the reference).
LEAKAGE = ["AirlineID", "FlightNum", "UniqueCarrier", "TailNum", "OriginCityName", "DestCityName",
           "OriginCityMarketID", "DestCityMarketID", "CRSDepTime", "CRSArrTime", "DepTime", "ArrTime",
           "DepDel15", "ArrDel15", "CRSElapsedTime", "ActualElapsedTime", "Year", "Quarter"]


def drop_leakage(df: DataFrame) -> DataFrame:
    """PRJ-02."""
    return df.drop(*LEAKAGE)


def drop_low_variance(df: DataFrame, cols: list[str], threshold: float = 0.1) -> DataFrame:
    """PRJ-03: ``df`` without the columns whose sample variance is below the
    threshold (one aggregate row decides)."""
    low = [r["FEATURE"] for r in variance_profile(df.select(*cols), threshold).where("LOW").collect()]
    return df.drop(*low)


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """SET-01: all rows of frames (one a year, say) matched by column name;
    a column that a frame lacks is NULL in its rows. No frame at all is an
    error, since it has no schema."""
    if not frames:
        raise ValueError("a union needs at least one frame")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def variance_profile(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """PRJ-03 / STA-01: sample variance of every numeric column, one pass,
    unpivoted to (FEATURE, VARIANCE, LOW) with LOW = variance < threshold."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in num])
    long = row.unpivot([], num, "FEATURE", "VARIANCE")
    return long.select("FEATURE", F.round("VARIANCE", 6).alias("VARIANCE"),
                       (F.col("VARIANCE") < threshold).alias("LOW"))
