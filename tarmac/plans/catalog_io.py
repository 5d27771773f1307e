"""Registrations of the file sources, sinks and the streaming ingest.

Each query lands data that Spark derives from the driver tables into a
fresh folder below the shared checkpoint location, reads it back with the
source operator and returns the result, so source and sink code runs on
the real data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import dates as fd
from tarmac.operators import aggregates as agg
from tarmac.operators import classify as cls
from tarmac.plans.catalog_more import block_label
from tarmac.plans.context import Ctx
from tarmac.registry import query
from tarmac.session import scratch_path
from tarmac.sources import archives, files
from tarmac.sources.materialize import gathered, materialize, small_splits
from tarmac.sources.tables import CAMEL_COLUMNS
from tarmac.streaming.ingest import ingest_available, read_table
from tarmac.streaming.refresh import Refreshed, compact, read_aggregate, refresh

ONTIME_NAMES = [c for c, _ in CAMEL_COLUMNS]
#: AGG-01 kept up to date from monthly files
PER_ORIGIN = Refreshed(("YEAR", "ORIGIN"), tuple(agg.ORIGIN_SUMS), {src: camel for camel, src in CAMEL_COLUMNS})


def append_months(df: DataFrame, path: str) -> None:
    """SNK-01: add months to a table laid out by (YEAR, MONTH); months that
    are there already are replaced, so a month can be run again."""
    (gathered(df, ["YEAR", "MONTH"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("YEAR", "MONTH").parquet(path))


@query("src_ontime_scan")
def q_src_ontime_scan(c: Ctx) -> DataFrame:
    """SRC-01: land ZIP'd monthly CSV archives, scan them back."""
    path = scratch_path(c.spark, "ontime-zip")
    with small_splits(c.spark):
        files.land_zip_months(c.camel, path, ONTIME_NAMES).count()
    return files.read_zip_months(c.spark, path, ONTIME_NAMES)


@query("src_ontime_source")
def q_src_ontime_source(c: Ctx) -> DataFrame:
    """SRC-01 as a stream: archives land twice and each run reads the new ones into a table, which
    also names corrupt archives."""
    path, table, ckpt = (scratch_path(c.spark, f"source-{x}") for x in ("zip", "table", "ckpt"))
    schema = files.ontime_schema(ONTIME_NAMES)
    src = c.camel.select(*ONTIME_NAMES)
    for part in (src.where(F.col("Year") <= 2012), src.where(F.col("Year") > 2012)):
        with small_splits(c.spark):
            files.land_zip_months(part, path, ONTIME_NAMES).count()
        archives.stream_archives(c.spark, path, schema).writeStream.format("parquet").option("path", table) \
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    return c.spark.read.parquet(table).where("fault IS NULL").select(*ONTIME_NAMES)


@query("src_multi_period")
def q_src_multi_period(c: Ctx) -> DataFrame:
    """SRC-02: one read over all landed months + ISO week."""
    path = scratch_path(c.spark, "ontime-csv")
    files.land_csv_months(c.camel.select(*ONTIME_NAMES), path)
    return files.read_csv_months(c.spark, path, ONTIME_NAMES)


@query("src_airport_coords")
def q_src_airport_coords(c: Ctx) -> DataFrame:
    path = scratch_path(c.spark, "coords")
    files.coords_file_frame(c.airports).write.mode("overwrite").option("header", False).csv(path)
    return files.read_coords(c.spark, path)


@query("src_airport_ranks")
def q_src_airport_ranks(c: Ctx) -> DataFrame:
    path = scratch_path(c.spark, "ranks")
    years = sorted(r["Year"] for r in c.ranks.select("Year").distinct().collect())
    files.land_rank_years(c.ranks, path, years)
    return files.read_rank_years(c.spark, path)


def _lookup(c: Ctx, name: str, df: DataFrame) -> DataFrame:
    path = scratch_path(c.spark, f"lookup-{name}")
    files.land_lookup(df, path)
    return files.read_lookup(c.spark, path)


@query("src_lookup_airport")
def q_src_lookup_airport(c: Ctx) -> DataFrame:
    """SRC-06: description cut at the first comma."""
    a = c.airports.select(F.col("iata").alias("Code"),
                          F.concat_ws("", "city", F.lit(", "), "state", F.lit(": "), "airport").alias("Description"))
    lk = _lookup(c, "airport", a)
    return lk.select("Code", F.split_part("Description", F.lit(","), F.lit(1)).alias("Description"))


@query("src_lookup_cancellation")
def q_src_lookup_cancellation(c: Ctx) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in files.CANCELLATION_REASONS.items() for x in kv])
    codes = c.fl.where(F.col("CANCELLATION_CODE").isNotNull()).select(
        F.col("CANCELLATION_CODE").alias("Code")).distinct()
    return _lookup(c, "cancellation", codes.withColumn("Description", m[F.col("Code")]))


@query("src_lookup_carrier")
def q_src_lookup_carrier(c: Ctx) -> DataFrame:
    """SRC-08: description cut at the first '(' (trailing blank kept)."""
    lk = _lookup(c, "carrier", c.carriers)
    return lk.select("Code", F.split_part("Description", F.lit("("), F.lit(1)).alias("Description"))


@query("src_lookup_delay_group")
def q_src_lookup_delay_group(c: Ctx) -> DataFrame:
    g = (c.fl.select(F.col("DEP_DELAY_GROUP").alias("g")).unionByName(c.fl.select(F.col("ARR_DELAY_GROUP").alias("g")))
         .where(F.col("g").isNotNull()).distinct())
    lk = _lookup(c, "delay", g.select(F.col("g").cast("string").alias("Code"),
                                      files.delay_group_text(F.col("g")).alias("Description")))
    return lk.select(F.col("Code").cast("int").alias("Code"), "Description")


@query("src_lookup_time_block")
def q_src_lookup_time_block(c: Ctx) -> DataFrame:
    b = (c.fl.select(F.col("DEP_TIME_BLK").alias("Code")).unionByName(c.fl.select(F.col("ARR_TIME_BLK").alias("Code")))
         .distinct())
    return _lookup(c, "block", b.withColumn("Description", block_label(F.col("Code"))))


@query("src_lookup_distance_group")
def q_src_lookup_distance_group(c: Ctx) -> DataFrame:
    g = c.fl.select(F.col("DISTANCE_GROUP").alias("g")).distinct()
    lk = _lookup(c, "distance", g.select(F.col("g").cast("string").alias("Code"),
                                         files.distance_group_text(F.col("g")).alias("Description")))
    return lk.select(F.col("Code").cast("int").alias("Code"), "Description")


@query("src_holidays")
def q_src_holidays(c: Ctx) -> DataFrame:
    """SRC-12: rule calendar for the years in the data, landed as
    'Year,Date,Holiday' text and parsed back."""
    path = scratch_path(c.spark, "holidays")
    files.land_holidays(fd.holidays(c.fl.select("YEAR")), path)
    return files.read_holidays(c.spark, path)


@query("snk_csv_roundtrip")
def q_snk_csv_roundtrip(c: Ctx) -> DataFrame:
    """SNK-04 + SRC-14: summary exported as CSV and reloaded with a schema."""
    path = scratch_path(c.spark, "origin-summary")
    om = agg.origin_month(c.fl, c.major_airports)
    om.write.mode("overwrite").option("header", True).csv(path)
    schema = "ORIGIN string, YEAR int, MONTH int, FLIGHTS double, DELAY double, DEL15 double, CANCELLED double"
    return c.spark.read.schema(schema).option("header", True).csv(path)


@query("src_table")
def q_src_table(c: Ctx) -> DataFrame:
    """SRC-15: named table scan (``SELECT * FROM agg_per_origin``)."""
    path = scratch_path(c.spark, "agg_per_origin")
    agg.per_origin(c.fl).write.mode("errorifexists").parquet(path)
    c.spark.read.parquet(path).createOrReplaceTempView("agg_per_origin")
    return c.spark.table("agg_per_origin")


@query("snk_append")
def q_snk_append(c: Ctx) -> DataFrame:
    """SNK-01: two batches of months appended to one table, the first of them
    twice: a re-run replaces its months and leaves every row once."""
    path = scratch_path(c.spark, "append")
    first = c.subset.where(F.col("YEAR") <= 2012)
    append_months(first, path)
    append_months(c.subset.where(F.col("YEAR") > 2012), path)
    append_months(first, path)
    return c.spark.read.parquet(path).select(*c.subset.columns)


@query("snk_create")
def q_snk_create(c: Ctx) -> DataFrame:
    """SNK-02: create, failing if the table exists."""
    path = scratch_path(c.spark, "create")
    c.subset.write.mode("errorifexists").parquet(path)
    return c.spark.read.parquet(path)


@query("snk_overwrite")
def q_snk_overwrite(c: Ctx) -> DataFrame:
    """SNK-03: replace a table (second write wins)."""
    path = scratch_path(c.spark, "overwrite")
    c.subset.where(F.col("YEAR") == 2010).write.mode("overwrite").parquet(path)
    c.subset.write.mode("overwrite").parquet(path)
    return c.spark.read.parquet(path)


@query("snk_materialize")
def q_snk_materialize(c: Ctx) -> DataFrame:
    """SNK-05: load-or-build; the second call reads the stored table."""
    path = scratch_path(c.spark, "materialize")
    materialize(c.spark, path, lambda: agg.per_origin(c.fl))
    return materialize(c.spark, path, lambda: agg.per_origin(c.fl))


@query("snk_model_params")
def q_snk_model_params(c: Ctx) -> DataFrame:
    """SNK-07: fitted model parameters stored as a table and reloaded."""
    path = scratch_path(c.spark, "model")
    cls.save(cls.fit(c.train), c.train_codes, path)
    model, _ = cls.load(c.spark, path)
    t = model.table(c.spark)
    return t.select("CLASS", "N", *[F.round(x, 6).alias(x) for x in t.columns[2:]])


@query("snk_model_score")
def q_snk_model_score(c: Ctx) -> DataFrame:
    """SNK-07: parameters and label codes stored, both reloaded, and requests
    scored with what was read back."""
    from tarmac.operators.summary import parse_requests

    path = scratch_path(c.spark, "model")
    cls.save(cls.fit(c.train), c.train_codes, path)
    model, codes = cls.load(c.spark, path)
    return cls.score_requests(parse_requests(c.requests), codes, model)


@query("snk_partitioned_layout")
def q_snk_partitioned_layout(c: Ctx) -> DataFrame:
    """SNK-08: (YEAR, MONTH) partitioned layout; a month read prunes to one
    folder (PartitionFilters in the scan)."""
    t = c.monthly_layout
    return t.where((F.col("YEAR") == 2012) & (F.col("MONTH") == 6)).select(
        "YEAR", "MONTH", "FL_DATE", "CARRIER", "ORIGIN", "DEST", "ARR_DELAY")


def _lookup_by(c: Ctx, column: str) -> DataFrame:
    """Rows of the least value of a column, read from the lookup layout."""
    value = c.fl.agg(F.min(column)).first()[0]
    return c.lookup_layout.where(F.col(column) == value).select(
        "FL_DATE", "CARRIER", "TAIL_NUM", "FL_NUM", "ORIGIN", "DEST", "ARR_DELAY")


@query("snk_lookup_carrier")
def q_snk_lookup_carrier(c: Ctx) -> DataFrame:
    """SNK-08: one carrier's flights from the layout over several columns."""
    return _lookup_by(c, "CARRIER")


@query("snk_lookup_origin")
def q_snk_lookup_origin(c: Ctx) -> DataFrame:
    return _lookup_by(c, "ORIGIN")


@query("snk_lookup_tail")
def q_snk_lookup_tail(c: Ctx) -> DataFrame:
    return _lookup_by(c, "TAIL_NUM")


@query("str_agg_refresh")
def q_str_agg_refresh(c: Ctx) -> DataFrame:
    """SNK-05 + STR-01: the stored per-origin aggregate after a first landing with a faulty June
    2012, a second landing, a compaction, and that month sent again."""
    landing, table, ckpt = (scratch_path(c.spark, f"refresh-{x}") for x in ("landing", "table", "ckpt"))
    src = c.camel.select(*ONTIME_NAMES)
    june = (F.col("Year") == 2012) & (F.col("Month") == 6)
    first = src.where(F.col("Year") <= 2012)
    faulty = first.where(~june | (F.col("DayofMonth") > 9)).withColumn(
        "DepDelay", F.when(june, F.col("DepDelay") + 7).otherwise(F.col("DepDelay")))
    files.land_csv_months(faulty, f"{landing}/delivery=1")
    refresh(c.spark, landing, ONTIME_NAMES, table, ckpt, PER_ORIGIN)
    files.land_csv_months(src.where(F.col("Year") > 2012), f"{landing}/delivery=1", mode="append")
    refresh(c.spark, landing, ONTIME_NAMES, table, ckpt, PER_ORIGIN)
    compact(c.spark, table, ONTIME_NAMES, PER_ORIGIN)
    files.land_csv_months(src.where(june), f"{landing}/delivery=2")
    refresh(c.spark, landing, ONTIME_NAMES, table, ckpt, PER_ORIGIN)
    return read_aggregate(c.spark, table, ONTIME_NAMES, PER_ORIGIN)


@query("str_monthly_ingest")
def q_str_monthly_ingest(c: Ctx) -> DataFrame:
    """STR-01: two landings, two availableNow runs; the table ends with
    every row exactly once."""
    landing = scratch_path(c.spark, "landing")
    table = scratch_path(c.spark, "ingested")
    ckpt = scratch_path(c.spark, "ingest-ckpt")
    src = c.camel.select(*ONTIME_NAMES)
    files.land_csv_months(src.where(F.col("Year") <= 2012), landing)
    ingest_available(c.spark, landing, ONTIME_NAMES, table, ckpt)
    files.land_csv_months(src.where(F.col("Year") > 2012), landing, mode="append")
    ingest_available(c.spark, landing, ONTIME_NAMES, table, ckpt)
    return read_table(c.spark, table)
