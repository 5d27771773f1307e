"""Invariants of the non-deterministic estimators, the file sources and the
"""

import zipfile

from pyspark.sql import functions as F

from tarmac.operators import aggregates as agg
from tarmac.operators import cluster
from tarmac.operators import reshape
from tarmac.plans import features as feat
from tarmac.plans.catalog_io import ONTIME_NAMES
from tarmac.session import scratch_path
from tarmac.sources import files
from tarmac.streaming.ingest import ingest_available, read_table


def test_kmeans_classes_cover_rows_once(ctx):
    f = feat.airport_features(ctx.fl, ctx.airports)
    out, cost, cents = cluster.kmeans(f, feat.GEO, 4, 1234)
    n = f.count()
    assert out.count() == n and out.select("YEAR", "IATA").distinct().count() == n
    assert out.where((F.col("CLASS") < 0) | (F.col("CLASS") >= 4)).count() == 0
    assert len(cents) == 4
    assert cost <= cluster.total_ss(f, feat.GEO) + 1e-6


def test_lloyd_step_does_not_increase_sse(ctx):
    f = feat.airport_features(ctx.fl, ctx.airports).cache()
    cols = feat.AIRPORT_CLUSTER_FEATURES
    c0 = cluster.first_rows(f, ["YEAR", "IATA"], cols, 4)
    a0 = cluster.assign(f, cols, c0)
    sse0 = a0.agg(F.sum("D2")).first()[0]
    step = cluster.lloyd_step(a0, cols).orderBy("CLASS").collect()
    c1 = [[r[c] for c in cols] for r in step]
    sse1 = cluster.assign(f, cols, c1).agg(F.sum("D2")).first()[0]
    assert sse1 <= sse0 + 1e-3


def test_pca_components(ctx):
    f = feat.airport_features(ctx.fl, ctx.airports)
    out, ev = cluster.pca(f, feat.AIRPORT_CLUSTER_FEATURES, 2, ["YEAR", "IATA"])
    assert out.count() == f.count()
    assert 0 < sum(ev) <= 1.0 + 1e-9 and ev[0] >= ev[1]
    means = out.agg(F.avg("PC1"), F.avg("PC2")).first()
    assert abs(means[0]) < 1e-6 and abs(means[1]) < 1e-6


def test_crosstab_cells_sum_to_flights(ctx):
    p = reshape.pivot_by_group(ctx.fl, "DAY_OF_WEEK")
    groups = [c for c in p.columns if c != "DAY_OF_WEEK"]
    cells = p.select(sum(F.coalesce(F.col(c), F.lit(0.0)) for c in groups).alias("s")).agg(F.sum("s")).first()[0]
    total = ctx.fl.where(F.col("ARR_DELAY_GROUP").isNotNull()).agg(F.sum("FLIGHTS")).first()[0]
    assert cells == total


def test_origin_and_route_totals_agree(ctx):
    a = agg.per_origin(ctx.fl).agg(F.sum("FLIGHTS")).first()[0]
    b = agg.per_route(ctx.fl).agg(F.sum("FLIGHTS")).first()[0]
    assert a == b == ctx.fl.count()


def test_imputation_leaves_no_nulls(ctx):
    f = feat.airport_features(ctx.fl, ctx.airports)
    for c in feat.AIRPORT_NUMERIC:
        assert f.where(F.col(c).isNull()).count() == 0, c


def test_zip_source_skips_corrupt_and_missing(spark, ctx):
    path = scratch_path(spark, "zip-test")
    src = ctx.camel.where(F.col("Year") == 2012)
    files.land_zip_months(src, path, ONTIME_NAMES).count()
    # a corrupt archive in one month folder
    import glob
    import os
    d = glob.glob(f"{path.removeprefix('file://')}/Year=2012/Month=6")[0]
    with open(os.path.join(d, "part-corrupt.zip"), "wb") as fh:
        fh.write(b"not a zip archive")
    got = files.read_zip_months(spark, path, ONTIME_NAMES)
    assert got.count() == src.count()
    assert files.read_zip_months(spark, path, ONTIME_NAMES, 2013, 1).count() == 0
    assert files.read_zip_months(spark, path, ONTIME_NAMES, 2012, 6).columns == ONTIME_NAMES
    assert [r["path"].rsplit("/", 1)[1] for r in files.bad_archives(spark, path).collect()] == ["part-corrupt.zip"]
    good = [f for f in glob.glob(f"{d}/*.zip") if "corrupt" not in f]
    assert good and all(zipfile.is_zipfile(f) for f in good)
    # archives per month do not grow with the number of batches
    assert len(good) <= 4
    # landing the same data again (a re-run task) replaces, not duplicates
    files.land_zip_months(src, path, ONTIME_NAMES).count()
    assert files.read_zip_months(spark, path, ONTIME_NAMES).count() == src.count()


def test_streaming_ingest_reads_each_file_once(spark, ctx):
    landing = scratch_path(spark, "landing-test")
    table = scratch_path(spark, "table-test")
    ckpt = scratch_path(spark, "ckpt-test")
    src = ctx.camel.select(*ONTIME_NAMES)
    files.land_csv_months(src.where(F.col("Year") == 2010), landing)
    n1 = ingest_available(spark, landing, ONTIME_NAMES, table, ckpt)
    assert n1 == src.where(F.col("Year") == 2010).count()
    again = ingest_available(spark, landing, ONTIME_NAMES, table, ckpt)
    assert again == 0
    files.land_csv_months(src.where(F.col("Year") == 2011), landing, mode="append")
    n2 = ingest_available(spark, landing, ONTIME_NAMES, table, ckpt)
    assert n2 == src.where(F.col("Year") == 2011).count()
    assert read_table(spark, table).count() == n1 + n2


def test_per_year_airport_classes_are_dense(spark):
    from conftest import SMALL
    from __spark_entry__ import queries
    out = queries()["ml_cluster_airports_by_year"](spark, SMALL)
    rows = out.collect()
    assert len(rows) == len({(r["YEAR"], r["IATA"]) for r in rows})
    by_year: dict[int, set[int]] = {}
    for r in rows:
        by_year.setdefault(r["YEAR"], set()).add(r["CLASS"])
    for classes in by_year.values():
        assert classes == set(range(len(classes)))


def test_create_fails_if_table_exists(spark):
    import pytest as _pytest
    from pyspark.errors import AnalysisException
    path = scratch_path(spark, "create-twice")
    df = spark.range(3)
    df.write.mode("errorifexists").parquet(path)
    with _pytest.raises(AnalysisException):
        df.write.mode("errorifexists").parquet(path)


def test_materialize_builds_once(spark):
    from tarmac.sources.materialize import materialize
    path = scratch_path(spark, "build-once")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert materialize(spark, path, build).count() == 5
    assert materialize(spark, path, build).count() == 5
    assert len(calls) == 1
    assert materialize(spark, path, build, refresh=True).count() == 5 and len(calls) == 2


def test_interleaved_builds_keep_the_first_reader(spark):
    """A second build of the same table that ends later neither deletes nor
    changes what the first one's reader reads."""
    from tarmac.sources.materialize import builds, materialize
    path = scratch_path(spark, "race")
    readers = []

    def slow():
        readers.append(materialize(spark, path, lambda: spark.range(7)))  # the winner, in the meantime
        return spark.range(7)

    mine = materialize(spark, path, slow)
    assert readers[0].count() == 7 and mine.count() == 7
    assert 1 <= len(builds(spark, path)) <= 2
    newer = materialize(spark, path, lambda: spark.range(3), refresh=True)
    assert newer.count() == 3 and readers[0].count() == 7
    assert materialize(spark, path, lambda: spark.range(1)).count() == 3


def test_changed_parameter_changes_the_table_key(spark, tmp_path):
    import shutil
    from pathlib import Path

    import tarmac
    from tarmac.plans.context import _code_digest
    from tarmac.sources.materialize import source_key, table_path
    root = tmp_path / "tarmac"
    shutil.copytree(Path(tarmac.__file__).parent, root, ignore=shutil.ignore_patterns("__pycache__", "llm"))
    before = _code_digest(str(root))
    for module in ("plans/context.py", "operators/classify.py", "plans/features.py", "sources/tables.py"):
        text = (root / module).read_text()
        (root / module).write_text(text + "\n# changed\n")
        after = _code_digest(str(root))
        assert after != before, module
        before = after
    assert table_path(spark, "t", "a") != table_path(spark, "t", "b")
    import pytest as _pytest
    with _pytest.raises(Exception):
        source_key(str(tmp_path), ["lineitem"], spark)


def test_no_private_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest as _pytest

    from tarmac.session import ensure_checkpoint_dir
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with _pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=sc))


def test_null_features_are_refused_not_dropped(spark):
    import pytest as _pytest

    from tarmac.operators import clean
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None), (3, 1.0, 2.0), (4, 5.0, 1.0)], "id int, a double, b double")
    with _pytest.raises(Exception):
        cluster.kmeans(df, ["a", "b"], 2)[0].count()
    out, _, _ = cluster.kmeans(clean.impute_modes(df, ["a", "b"]), ["a", "b"], 2)
    assert out.count() == 4


def test_route_grid(ctx):
    from conftest import SMALL

    from tarmac.registry import all_queries
    got = {(r.N, r.K): r.SSE for r in all_queries()["ml_grid_nk_routes"](ctx.spark, SMALL).collect()}
    assert set(got) == {(n, k) for n in range(1, 6) for k in range(1, 25)}
    scaled = feat.scaled_routes(ctx.route_features)
    for n in (1, 5):
        pcs, _ = cluster.pca(scaled, feat.ROUTE_CLUSTER_FEATURES, n, ["YEAR", "ORIGIN", "DEST"])
        total = cluster.total_ss(pcs, [f"PC{j + 1}" for j in range(n)])
        assert abs(got[n, 1] - total) <= 1e-6 * total
        assert 0 <= got[n, 24] < got[n, 1]


def test_more_clusters_than_points(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 1.0)], "id int, a double")
    out, cost, centres = cluster.kmeans(df, ["a"], 10)
    assert out.count() == 3 and len(centres) <= 3 and cost < 1e-9


def test_storage_error_fails_the_task():
    import pyarrow as pa
    import pytest as _pytest

    from tarmac.sources import archives
    decode = archives.decoder(files.ontime_schema(ONTIME_NAMES))
    with _pytest.raises(OSError):
        list(decode(iter([pa.RecordBatch.from_pydict({"path": ["file:///no/such/archive.zip"]})])))


def test_rerun_month_leaves_each_row_once(spark, ctx):
    from tarmac.plans.catalog_io import append_months
    path = scratch_path(spark, "rerun")
    src = ctx.subset
    append_months(src.where("YEAR = 2012"), path)
    append_months(src.where("YEAR = 2013"), path)
    append_months(src.where("YEAR = 2012 AND MONTH = 3"), path)
    got = spark.read.parquet(path).select(*src.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, src.where("YEAR IN (2012, 2013)").collect()))


def test_yearly_clusters_with_several_classes(ctx):
    from tarmac.plans.catalog_ml import q_ml_cluster_airports_by_year
    rows = q_ml_cluster_airports_by_year(ctx, k=3, min_size=1).collect()
    by_year: dict[int, set[int]] = {}
    for r in rows:
        by_year.setdefault(r["YEAR"], set()).add(r["CLASS"])
    assert all(c == set(range(len(c))) for c in by_year.values())
    assert max(len(c) for c in by_year.values()) > 1
    assert len(rows) == ctx.airport_base.count()


def test_carrier_exclusion_finds_a_carrier(spark):
    from tarmac.plans.dims import carrier_exclusion
    airlines = spark.createDataFrame([("C01", "a"), ("C02", "b"), ("C03", "c")], "CARRIER string, CARRIER_NM string")
    subset = spark.createDataFrame([("C01",), ("C03",), ("C01",)], "CARRIER string")
    assert [r["CARRIER"] for r in carrier_exclusion(airlines, subset).collect()] == ["C02"]


def test_answer_reads_only_requested_slices(ctx):
    from tarmac.operators import summary as sm
    one = sm.parse_requests(ctx.requests.where("variables LIKE '%/2013'"))
    sub = sm.requested_slices(ctx.subset, one)
    plan = sub._jdf.queryExecution().toString()
    assert "LeftSemi" in plan
    assert {r["YEAR"] for r in sub.select("YEAR").distinct().collect()} <= {2012}
