"""Hand-computed edge cases (FIXTURES.md section 5) of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarmac.functions import dates as fd
from tarmac.functions import derived as fn
from tarmac.operators import classify as cls
from tarmac.operators import clean, cluster, joins, stats, summary


def test_mode_tie_takes_lowest(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (None,)], "x double")
    assert clean.fit_modes(df, ["x"])["x"] == 1.0
    assert clean.impute_modes(df, ["x"]).where(F.col("x").isNull()).count() == 0


def test_mode_of_all_null_group_falls_back_to_default(spark):
    df = spark.createDataFrame([(2010, None), (2011, 5.0), (2011, None)], "YEAR int, x double")
    out = {r["YEAR"]: r["x"] for r in clean.impute_modes_by(df, ["x"], ["YEAR"]).collect() if True}
    rows = sorted((r["YEAR"], r["x"]) for r in clean.impute_modes_by(df, ["x"], ["YEAR"]).collect())
    assert rows == [(2010, 0.0), (2011, 5.0), (2011, 5.0)]
    assert out[2010] == 0.0


def _sub(spark, rows):
    return spark.createDataFrame(
        rows, "YEAR int, WEEK_OF_YEAR int, CARRIER string, ORIGIN string, DEST string, DEP_DEL15 double, "
              "CANCELLED double, DEP_DELAY_NEW double, ARR_DEL15 double, ARR_DELAY_NEW double, DIVERTED double")


def test_one_row_slice_has_null_std(spark):
    df = _sub(spark, [(2012, 1, "C01", "A01", "A02", 1.0, 0.0, 20.0, 1.0, 30.0, 0.0)])
    r = summary.origin_summary(df).first()
    assert r["std_delay_time"] is None and r["mean_delay_time"] == 20
    rr = summary.route_summary(df).first()
    assert rr["std_adelay_time"] == "NA" and rr["nflights"] == "1"


def test_rate_denominator_counts_null_flags(spark):
    rows = [(2012, 1, "C01", "A01", "A02", f, 0.0, 1.0, 0.0, 1.0, 0.0) for f in (1.0, 0.0, None)]
    r = summary.origin_summary(_sub(spark, rows)).first()
    assert r["delay_rate"] == 33 and r["nflights"] == 3


def test_iso_week(spark):
    df = spark.createDataFrame([(2010, 1, 1), (2012, 12, 31)], "y int, m int, d int")
    assert [r[0] for r in df.select(fd.iso_week("y", "m", "d")).collect()] == [53, 1]


def test_recovered_time(spark):
    df = spark.createDataFrame([(-5.0, -3.0), (10.0, 4.0), (-5.0, 3.0)], "d double, a double")
    assert [r[0] for r in df.select(fn.rec_time(F.col("d"), F.col("a"))).collect()] == [8.0, 6.0, -8.0]


def test_histogram_right_edge_in_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    h = {r["BIN"]: r["CNT"] for r in stats.histogram(df, "x", 10).collect()}
    assert h[9] == 2 and sum(h.values()) == 11


def test_nearest_holiday_tie_goes_to_earlier(spark):
    hol = spark.createDataFrame([(dt.date(2012, 1, 1), "A"), (dt.date(2012, 1, 5), "B")], "Date date, Holiday string")
    d = spark.createDataFrame([(dt.date(2012, 1, 3),)], "FL_DATE date")
    r = joins.nearest_holiday(d, hol).first()
    assert r["HOLIDAY_DATE"] == dt.date(2012, 1, 1) and r["DAYS_TO_HOLIDAY"] == -2


def test_small_class_merge(spark):
    rows = [(2010, i, 0) for i in range(50)] + [(2010, 100 + i, 1) for i in range(9)]
    rows += [(2010, 200 + i, 2) for i in range(3)] + [(2010, 300 + i, 3) for i in range(20)]
    df = spark.createDataFrame(rows, "YEAR int, ID int, CLASS int")
    out = cluster.merge_small(df, ["YEAR"], "CLASS", min_size=10)
    sizes = {r["CLASS"]: r["count"] for r in out.groupBy("CLASS").count().collect()}
    assert sizes == {0: 50, 1: 20, 2: 12}


def test_standard_scaler_uses_population_std(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 9)], "x double")
    m, s = cluster.fit_standard(df, ["x"])["x"]
    assert m == pytest.approx(4.5) and s == pytest.approx(2.2913, abs=1e-4)


def test_robust_scaler_exact_quartiles(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 9)], "x double")
    med, iqr = cluster.fit_robust(df, ["x"])["x"]
    assert med == pytest.approx(4.5) and iqr == pytest.approx(3.5)


def test_round_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(F.round("x", 0).cast("int")).collect()] == [3, -3]


def test_naive_bayes_priors_from_recorded_counts(spark):
    """The recorded model has 5,575,625 on-time and 1,399,535 late rows."""
    n1, n = 1399535, 5575625 + 1399535
    df = spark.range(n).select((F.col("id") < n1).cast("double").alias("ARR_DEL15"),
                               (F.col("id") % 9).alias("CARRIER"), (F.col("id") % 20).alias("ORIGIN"),
                               (F.col("id") % 19).alias("DEST"), (F.col("id") % 52 + 1).alias("WEEK_OF_YEAR"))
    m = cls.fit(df)
    assert m.params["PRIOR0"] == pytest.approx(0.79935, abs=1e-5)
    assert m.threshold == pytest.approx(0.200646, abs=1e-6)
    p = cls.proba(df.limit(1000), m).agg(F.min("PROBA"), F.max("PROBA")).first()
    assert 0 < p[0] <= p[1] < 1


def test_holiday_rules(spark):
    years = spark.createDataFrame([(2010,), (2011,)], "YEAR int")
    h = {(r["Year"], r["Holiday"]): r["Date"] for r in fd.holidays(years).collect()}
    assert h[(2010, "Independence Day")] == dt.date(2010, 7, 5)  # Sunday -> Monday
    assert h[(2010, "Thanksgiving Day")] == dt.date(2010, 11, 25)
    assert h[(2011, "New Year's Day")] == dt.date(2010, 12, 31)  # Saturday -> Friday before
    assert h[(2010, "Memorial Day")] == dt.date(2010, 5, 31)
    assert h[(2011, "Birthday of Martin Luther King, Jr.")] == dt.date(2011, 1, 17)


def test_clean_date_parses_weekday_month_day(spark):
    df = spark.createDataFrame([(2010, "Thursday, November 25")], "y int, t string")
    assert df.select(fd.clean_date(F.col("y"), F.col("t"))).first()[0] == dt.date(2010, 11, 25)


def test_corr_of_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)], "a double, b double, c double")
    r = {(x["F1"], x["F2"]): x["CORR"] for x in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert r[("a", "c")] is None and r[("c", "c")] is None and r[("a", "a")] == 1.0
    assert r[("a", "b")] == r[("b", "a")] and 0.9 < r[("a", "b")] <= 1.0


def test_std_half_tie_rounds_up(spark):
    """Delays 0, 0, 0, 25 have sample std exactly 12.5 -> 13 (half away)."""
    rows = [(2012, 1, "C01", "A01", "A02", 0.0, 0.0, float(v), 0.0, 0.0, 0.0) for v in (0, 0, 0, 25)]
    r = summary.origin_summary(_sub(spark, rows)).first()
    assert r["std_delay_time"] == 13 and r["mean_delay_time"] == 6


def test_mode_keeps_large_and_odd_types(spark):
    import datetime as dt
    from decimal import Decimal
    big = 9007199254740993
    df = spark.createDataFrame(
        [(big, True, dt.datetime(2020, 1, 1, 2, 3, 4), Decimal("10.50"), dt.date(2020, 5, 1)),
         (big, True, dt.datetime(2020, 1, 1, 2, 3, 4), Decimal("9.25"), dt.date(2020, 5, 1)),
         (big - 1, False, None, Decimal("9.25"), None), (None, None, None, None, None)],
        "a bigint, b boolean, c timestamp, d decimal(10,2), e date")
    out = clean.impute_modes(df, df.columns).collect()[-1]
    assert (out["a"], out["b"], out["d"], out["e"]) == (big, True, Decimal("9.25"), dt.date(2020, 5, 1))
    assert out["c"] == df.first()["c"] and out["c"] is not None


def test_decimal_mode_tie_by_value(spark):
    from decimal import Decimal
    df = spark.createDataFrame([(Decimal("10.0"),), (Decimal("9.0"),)], "d decimal(5,1)")
    assert Decimal(clean.fit_modes(df, ["d"])["d"]) == Decimal("9.0")


def test_new_year_observed_in_the_old_year(spark):
    from tarmac.functions import dates as fd
    from tarmac.operators import joins
    years = spark.createDataFrame([(2010,), (2011,)], "YEAR int")
    weekly = spark.createDataFrame([(2010, 52, 1.0), (2011, 52, 1.0)], "YEAR int, WEEK_OF_YEAR int, FLIGHTS double")
    got = {r["YEAR"]: r["HOLIDAYS"] for r in joins.holiday_week(weekly, fd.holidays(fd.years_around(years))).collect()}
    assert "New Year" in got[2010] and "New Year" not in got[2011] and "Christmas" in got[2011]


def test_nearest_holiday_beyond_the_data(spark):
    import datetime as dt

    from tarmac.functions import dates as fd
    from tarmac.operators import joins
    fl = spark.createDataFrame([(2010, dt.date(2010, 12, 30)), (2010, dt.date(2010, 1, 2))], "YEAR int, FL_DATE date")
    near = joins.nearest_holiday(fl, fd.holidays(fd.years_around(fl.select("YEAR"))))
    got = {r["FL_DATE"]: (r["HOLIDAY_DATE"], r["DAYS_TO_HOLIDAY"]) for r in near.collect()}
    assert got[dt.date(2010, 12, 30)] == (dt.date(2010, 12, 31), 1)


def test_fit_with_one_class_or_no_rows(spark):
    from tarmac.operators import classify as cls
    df = spark.createDataFrame([(1, 2, 3, 4, 0.0), (1, 2, 3, 5, 0.0)],
                               "CARRIER int, ORIGIN int, DEST int, WEEK_OF_YEAR int, ARR_DEL15 double")
    m = cls.fit(df)
    assert m.threshold == 0 and {r["PROBA"] for r in cls.proba(df, m).collect()} == {0.0}
    empty = cls.fit(df.limit(0))
    assert {r["PROBA"] for r in cls.proba(df, empty).collect()} == {None}


def test_model_round_trip(spark):
    from tarmac.operators import classify as cls
    from tarmac.session import scratch_path
    df = spark.createDataFrame([(1, 2, 3, 4, 0.0), (1, 5, 3, 5, 0.0), (2, 2, 3, 9, 1.0), (2, 3, 1, 7, 1.0)],
                               "CARRIER int, ORIGIN int, DEST int, WEEK_OF_YEAR int, ARR_DEL15 double")
    codes = {c: spark.createDataFrame([("x", 0), ("y", 1)], "VALUE string, CODE int") for c in cls.ENCODED}
    path = scratch_path(spark, "model-test")
    m = cls.fit(df)
    cls.save(m, codes, path)
    back, again = cls.load(spark, path)
    assert back == m and all(again[c].count() == 2 for c in cls.ENCODED)


def test_std_of_a_large_slice_is_exact(spark):
    from pyspark.sql import functions as F

    from tarmac.operators.summary import std_samp
    df = spark.range(4).select((F.col("id") % 2 * 2 + 30_000_000).cast("double").alias("x"))
    assert abs(df.agg(std_samp("x").alias("s")).first()["s"] - (4 / 3) ** 0.5) < 1e-12


def test_low_variance_columns_are_dropped(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.1, 9.0), (3, 1.0, 1.0)], "id int, flat double, wide double")
    assert clean.drop_low_variance(df, ["flat", "wide"]).columns == ["id", "wide"]


def test_quantiles_match_linear_interpolation(spark):
    import numpy as np

    from tarmac.operators import cluster
    x = np.random.default_rng(4).integers(0, 50, 301).astype(float)
    df = spark.createDataFrame([(float(v), float(-v * v)) for v in x] + [(None, 1.0)], "a double, b double")
    got = {(r["FEATURE"], r["SHARE"]): r["VALUE"] for r in cluster.quantiles(df, ["a", "b"]).collect()}
    for s in (0.25, 0.5, 0.75):
        assert abs(got["a", s] - np.quantile(x, s)) < 1e-9
        assert abs(got["b", s] - np.quantile(np.append(-x * x, 1.0), s)) < 1e-9
