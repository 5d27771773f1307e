"""The archive source: one decompression, faults in the result, nothing lost silently."""

import glob
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarmac.plans.catalog_io import ONTIME_NAMES
from tarmac.session import scratch_path
from tarmac.sources import archives, files

NAMES = ["Year", "Month", "FlightDate", "FlightNum", "Carrier", "DepDelay"]
SCHEMA = files.ontime_schema(NAMES)
HEAD = "Extra,Year,Month,FlightDate,FlightNum,Carrier,DepDelay\n"
GOOD = HEAD + "x,2012,6,2012-06-01,12,AA,1.50\ny,2012.0,6,2012-06-02,,\"B,B\",\n"


def pack(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return f"file://{path}"


def decoded(*uris):
    got = list(archives.decoder(SCHEMA)(iter([pa.RecordBatch.from_pydict({"path": list(uris)})])))
    return pa.Table.from_batches(got).to_pylist() if got else []


def damaged(tmp_path, name="bad.zip"):
    """An archive whose directory is whole but whose bytes don't match their checksum."""
    body = HEAD + "".join(f"z{i},2012,6,2012-06-01,{i},AA,{i}.0\n" for i in range(5000))
    path = str(tmp_path / name)
    pack(path, {"a.csv": body})
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 3] ^= 0xFF
    open(path, "wb").write(raw)
    return f"file://{path}"


@pytest.mark.parametrize("hold", [archives.HOLD, 0])
def test_rows_and_faults(tmp_path, monkeypatch, hold):
    monkeypatch.setattr(archives, "HOLD", hold)
    good = pack(str(tmp_path / "good.zip"), {"a.csv": GOOD, "readme.html": "<html>", "B.CSV": HEAD + "q,2013,1,2013-01-01,7,CC,0\n"})
    text = tmp_path / "text.zip"
    text.write_bytes(b"not an archive at all, but longer than a directory")
    nothing = tmp_path / "empty.zip"
    nothing.write_bytes(b"")
    rows = decoded(damaged(tmp_path), good, f"file://{text}", f"file://{nothing}")
    faults = [r for r in rows if r["fault"]]
    assert [os.path.basename(r["archive"]) for r in faults] == ["bad.zip", "text.zip", "empty.zip"]
    assert all(r[n] is None for r in faults for n in NAMES)
    flights = [r for r in rows if not r["fault"]]
    assert [(r["Year"], r["FlightNum"], r["Carrier"], r["DepDelay"]) for r in flights] == \
        [(2012, 12, "AA", 1.5), (2012, None, "B,B", None), (2013, 7, "CC", 0.0)]
    assert {r["archive"] for r in flights} == {good}


def test_archive_is_decompressed_once(tmp_path, monkeypatch):
    opened = []
    plain = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, *a, **k: opened.append(1) or plain(self, *a, **k))
    uri = pack(str(tmp_path / "a.zip"), {"a.csv": GOOD})
    opened.clear()
    assert len(decoded(uri)) == 2 and len(opened) == 1


@pytest.mark.parametrize("line", ["x,2012,6,2012-06-01,12,AA,abc\n", "x,2012,6.5,2012-06-01,12,AA,1\n", "x,2012,6,June,12,AA,1\n",
                                  "x,2012,6\n"])
def test_unreadable_text_fails(tmp_path, line):
    uri = pack(str(tmp_path / "a.zip"), {"a.csv": HEAD + line})
    with pytest.raises(pa.ArrowInvalid):
        decoded(uri)


def test_missing_column_fails_and_no_rows_are_none(tmp_path):
    with pytest.raises(Exception):
        decoded(pack(str(tmp_path / "a.zip"), {"a.csv": "Year,Month\n2012,6\n"}))
    assert decoded(pack(str(tmp_path / "b.zip"), {"a.csv": HEAD}), pack(str(tmp_path / "c.zip"), {"a.csv": ""}),
                   pack(str(tmp_path / "d.zip"), {"a.txt": "x"})) == []


def test_round_trip_keeps_every_value(spark, ctx):
    path = scratch_path(spark, "zip-trip")
    src = ctx.camel.select(*ONTIME_NAMES).where("Year = 2012")
    files.land_zip_months(src, path, ONTIME_NAMES).count()
    got = files.read_zip_months(spark, path, ONTIME_NAMES)
    assert got.count() == src.count() and got.exceptAll(src).count() == 0


def test_archives_follow_the_rows_of_a_month(spark):
    rows = spark.range(900).select(F.lit(2012).alias("Year"), F.when(F.col("id") < 800, 6).otherwise(7).alias("Month"),
                                   F.lit(None).cast("date").alias("FlightDate"), F.col("id").alias("FlightNum"),
                                   F.lit("A,\"A").alias("Carrier"), F.lit(1.0).alias("DepDelay"))
    path = scratch_path(spark, "zip-size")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        landed = archives.land_archives(rows, path, NAMES, rows_per_archive=100).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert sum(r.rows for r in landed) == 900
    at = path.removeprefix("file://")
    assert len(glob.glob(f"{at}/Year=2012/Month=7/*.zip")) == 1
    assert 1 <= len(glob.glob(f"{at}/Year=2012/Month=6/*.zip")) <= 8
    got = files.read_zip_months(spark, path, NAMES)
    assert got.exceptAll(rows).count() == 0 and got.count() == 900
    assert files.read_zip_months(spark, path, NAMES, 2012, 7).count() == 100
    plan = files.read_zip_months(spark, path, NAMES, 2012, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "Month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_stream_reads_each_archive_once(spark, tmp_path):
    root, table, ckpt = (scratch_path(spark, f"zip-stream-{x}") for x in ("in", "out", "ckpt"))
    d = f"{root.removeprefix('file://')}/Year=2012/Month=6"
    os.makedirs(d)

    def run():
        archives.stream_archives(spark, root, SCHEMA).writeStream.format("parquet").option("path", table) \
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(table)
    pack(f"{d}/a.zip", {"a.csv": GOOD})
    assert run().count() == 2
    assert run().count() == 2
    pack(f"{d}/b.zip", {"a.csv": GOOD})
    os.rename(damaged(tmp_path).removeprefix("file://"), f"{d}/bad.zip")
    got = run()
    assert got.where("fault IS NULL").count() == 4
    assert [os.path.basename(r.archive) for r in got.where("fault IS NOT NULL").collect()] == ["bad.zip"]


def test_archives_that_meet_in_a_task_are_not_joined(spark):
    rows = spark.range(800).select(F.lit(2012).alias("Year"), F.lit(6).alias("Month"), F.lit(None).cast("date").alias("FlightDate"),
                                   F.col("id").alias("FlightNum"), F.lit("AA").alias("Carrier"), F.lit(1.0).alias("DepDelay"))
    path = scratch_path(spark, "zip-met")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        landed = archives.land_archives(rows, path, NAMES, rows_per_archive=100).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(landed) == 8 and sum(r.rows for r in landed) == 800 and max(r.rows for r in landed) < 200
    got = files.read_zip_months(spark, path, NAMES)
    assert got.exceptAll(rows).count() == 0 and got.count() == 800


def test_flights_are_shuffled_once_to_land(spark, ctx):
    path = scratch_path(spark, "zip-once")
    plan = archives.land_archives(ctx.camel, path, ONTIME_NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
