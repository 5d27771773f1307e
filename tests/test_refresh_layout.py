"""Incremental aggregates, the lookup layout and writers whose tasks follow the data."""

import datetime as dt
import glob
import os
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tarmac.operators import aggregates as agg
from tarmac.operators import layout
from tarmac.plans.catalog_io import ONTIME_NAMES, PER_ORIGIN, append_months
from tarmac.plans.context import FLIGHT_COLUMNS, LOOKUP_BLOOMS, LOOKUP_COLUMNS
from tarmac.session import scratch_path
from tarmac.sources.materialize import small_splits
from tarmac.sources import files
from tarmac.streaming import refresh as rf


def local(path):
    return path.removeprefix("file://")


def sums(df):
    return Counter(tuple(r[c] for c in ("YEAR", "ORIGIN", *[o for o, _ in agg.ORIGIN_SUMS])) for r in df.collect())


class Landed:
    """A landing folder, a table and a checkpoint."""

    def __init__(self, spark, ctx):
        self.spark = spark
        self.src = ctx.camel.select(*ONTIME_NAMES)
        self.landing, self.table, self.ckpt = (scratch_path(spark, x) for x in ("landing", "table", "ckpt"))

    def land(self, df, delivery):
        files.land_csv_months(df, f"{self.landing}/delivery={delivery}", mode="append")
        return df.count()

    def run(self):
        return rf.refresh(self.spark, self.landing, ONTIME_NAMES, self.table, self.ckpt, PER_ORIGIN)

    def now(self):
        return sums(rf.read_aggregate(self.spark, self.table, ONTIME_NAMES, PER_ORIGIN))


def expected(spark, ctx, rows):
    """The aggregate over camel-named rows."""
    up = rows.select(*[F.col(PER_ORIGIN.columns[c]).alias(c) for c in ("YEAR", "ORIGIN", *[s for _, s in agg.ORIGIN_SUMS])])
    return sums(agg.per_origin(up))


def test_refresh_reads_new_files_only_and_retracts(spark, ctx):
    t = Landed(spark, ctx)
    a, b = t.src.where("Year <= 2011"), t.src.where("Year = 2012")
    os.makedirs(local(t.landing))
    assert t.run() == 0 and t.now() == Counter()
    n = t.land(a, 1)
    assert t.run() == n
    assert t.now() == expected(spark, ctx, a)
    assert t.run() == 0
    faulty = b.withColumn("DepDelay", F.col("DepDelay") + 1)
    n = t.land(faulty, 3)
    assert t.run() == n
    assert t.now() == expected(spark, ctx, a.unionByName(faulty))
    # a month sent again, with fewer airports, and an older delivery that is late
    june = b.where("Month = 6 AND Origin < 'A10'")
    n = t.land(june, 4) + t.land(b.where("Month <= 6"), 2)
    assert t.run() == n
    want = expected(spark, ctx, a.unionByName(faulty.where("Month <> 6")).unionByName(june))
    assert t.now() == want
    rf.compact(spark, t.table, ONTIME_NAMES, PER_ORIGIN)
    assert t.now() == want
    assert rf.vacuum(spark, t.table) >= 3 and rf.vacuum(spark, t.table) == 0
    assert t.now() == want
    # more files of the newest delivery add to it, also after the compaction
    more = b.where("Month = 6 AND Origin >= 'A10'")
    t.land(more, 4)
    t.run()
    assert t.now() == expected(spark, ctx, a.unionByName(faulty.where("Month <> 6")).unionByName(b.where("Month = 6")))


def test_refresh_replays_a_lost_batch_once(spark, ctx):
    t = Landed(spark, ctx)
    rows = t.src.where("Year = 2011 AND Month < 4")
    t.land(rows, 1)
    t.run()
    done = sorted(glob.glob(f"{local(t.ckpt)}/commits/[0-9]*"))
    for f in (done[-1], os.path.join(os.path.dirname(done[-1]), f".{os.path.basename(done[-1])}.crc")):
        if os.path.exists(f):
            os.remove(f)  # the driver died before the batch was noted as done
    t.run()
    assert t.now() == expected(spark, ctx, rows)


# ------------------------------------------------------------- layout
def scanned(df):
    """Rows that the scan of ``df`` hands on after skipping row groups, and the result's rows."""
    n = len(df.collect())
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value(), n


@pytest.fixture(scope="module")
def laid_out(spark, ctx):
    path = scratch_path(spark, "layout")
    fl = ctx.fl.where("YEAR <= 2014")
    layout.ordered(fl, LOOKUP_COLUMNS, rows_per_file=16).write.options(**layout.bloom_options(LOOKUP_BLOOMS, 100)).parquet(path)
    return path, spark.read.parquet(path), fl


def test_lookups_skip_most_row_groups(spark, laid_out):
    path, t, fl = laid_out
    total = t.count()
    assert total == fl.count() > 2000
    first = fl.agg(*[F.min(c).alias(c) for c in ("CARRIER", "ORIGIN", "DEST", "TAIL_NUM", "ORIGIN_CITY_NAME")]).first()
    for c, most in (("CARRIER", 0.5), ("ORIGIN", 0.5), ("DEST", 0.5), ("TAIL_NUM", 0.5), ("ORIGIN_CITY_NAME", 0.6)):
        got = t.where(F.col(c) == first[c])
        read, n = scanned(got)
        assert n == fl.where(F.col(c) == first[c]).count()
        assert read < most * total, (c, read, total)
    read, _ = scanned(t.where((F.col("ORIGIN") == first["ORIGIN"]) & (F.col("CARRIER") == first["CARRIER"])))
    assert read < 0.25 * total
    read, _ = scanned(t.where(F.col("FL_DATE").between(dt.date(2012, 6, 1), dt.date(2012, 6, 30))))
    assert read < 0.5 * total


def test_layout_footers_and_file_count(spark, laid_out):
    path, t, fl = laid_out
    parts = sorted(glob.glob(f"{local(path)}/part-*.parquet"))
    total = t.count()
    assert 0.8 * total / 16 <= len(parts) <= total / 16 + 1
    value = fl.agg(F.min("CARRIER")).first()[0]
    groups = may = 0
    for p in parts:
        meta = pq.ParquetFile(p).metadata
        col = meta.schema.names.index("CARRIER")
        for g in range(meta.num_row_groups):
            st = meta.row_group(g).column(col).statistics
            groups += 1
            may += st.min <= value <= st.max
    assert may < 0.5 * groups
    few = scratch_path(spark, "layout-few")
    layout.ordered(fl, LOOKUP_COLUMNS, rows_per_file=1000).write.parquet(few)
    assert len(glob.glob(f"{local(few)}/part-*.parquet")) < len(parts) / 10


def test_layout_of_hot_null_and_no_values(spark):
    rng = random.Random(2)
    rows = [("hot", None, i) for i in range(400)] + [(rng.choice("abc"), rng.randint(0, 9), i) for i in range(100)]
    df = spark.createDataFrame(rows, "a string, b int, n long")
    path = scratch_path(spark, "layout-hot")
    layout.ordered(df, ["a", "b"], rows_per_file=50).write.parquet(path)
    got = spark.read.parquet(path)
    assert Counter(map(tuple, got.collect())) == Counter(rows)
    assert max(pq.ParquetFile(p).metadata.num_rows for p in glob.glob(f"{local(path)}/part-*.parquet")) < 200
    assert layout.ordered(df.limit(0), ["a", "b"]).collect() == []


def test_ranks_and_curve(spark):
    cuts = [10, 20, 30]
    df = spark.createDataFrame([(v,) for v in (5, 10, 19, 20, 30, 99, None)], "v int")
    assert [r[0] for r in df.select(layout.rank_of(F.col("v"), cuts)).collect()] == [0, 1, 1, 2, 3, 3, 3]
    df = spark.range(16).select((F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"))
    place = layout.interleaved(["x", "y"], {"x": [1, 2, 3], "y": [1, 2, 3]}, bits=2)
    got = {(r.x, r.y): r.p for r in df.select("x", "y", place.alias("p")).collect()}
    assert got == {(x, y): (x & 1) | (y & 1) << 1 | (x >> 1) << 2 | (y >> 1) << 3 for x in range(4) for y in range(4)}


# ------------------------------------------------------------- writers
def test_a_month_of_many_rows_is_written_by_many_tasks(spark):
    df = spark.range(0, 60_000, 1, 4).select(F.lit(2012).alias("YEAR"), F.when(F.col("id") < 59_000, 6).otherwise(7).alias("MONTH"),
                                              F.xxhash64("id").alias("v"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        path = scratch_path(spark, "big-month")
        append_months(df, path)
    finally:
        spark.conf.set(key, before)
    assert len(glob.glob(f"{local(path)}/YEAR=2012/MONTH=6/part-*.parquet")) > 3
    assert len(glob.glob(f"{local(path)}/YEAR=2012/MONTH=7/part-*.parquet")) <= 2
    assert spark.read.parquet(path).count() == 60_000


def test_flights_are_moved_as_keys(ctx):
    """The table's build gathers and sorts eight columns; its 47 are neither shuffled nor sorted by the write."""
    plan = ctx._build_flights()._jdf.queryExecution().optimizedPlan()
    assert plan.outputOrdering().head().child().name() == "YEAR"
    assert plan.output().size() == len(FLIGHT_COLUMNS)
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    assert plan.nodeName() == "Sort" and plan.output().size() == 8
    assert "Rebalance" in plan.children().head().nodeName()


def test_monthly_csv_is_landed_gzipped_without_sorting(spark, ctx, tmp_path):
    src = ctx.camel.select(*ONTIME_NAMES).coalesce(1)
    path = str(tmp_path / "csv")
    files.land_csv_months(src, path)
    found = glob.glob(f"{path}/Year=*/Month=*/*.csv*")
    assert found and all(f.endswith(".csv.gz") for f in found)
    assert len(found) == src.select("Year", "Month").distinct().count()  # one file per task and month
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    back = files.read_csv_months(spark, path, ONTIME_NAMES).drop("WeekofYear")
    assert back.exceptAll(src).isEmpty() and src.exceptAll(back).isEmpty()
    # more months than writers: the rest is sorted, nothing is lost
    files.OPEN_MONTHS, before = 3, files.OPEN_MONTHS
    try:
        files.land_csv_months(src, path)
    finally:
        files.OPEN_MONTHS = before
    again = files.read_csv_months(spark, path, ONTIME_NAMES).drop("WeekofYear")
    assert again.exceptAll(src).isEmpty() and again.count() == src.count()


def test_whole_rows_are_shuffled_from_small_splits(spark, ctx):
    with small_splits(spark):
        assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= 32 << 20
        with pytest.raises(ZeroDivisionError), small_splits(spark):
            1 / 0  # noqa: B018
        assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= 32 << 20
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "134217728b"
    assert layout.ROWS_PER_FILE * 550 < 300 << 20  # bytes of a flight in a sort
