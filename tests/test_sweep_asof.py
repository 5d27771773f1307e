"""As-of join, threshold sweep, all totals, carrier bitmaps and the request stream."""

import datetime as dt
import glob
import math
import os
import random
from bisect import bisect_left
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tarmac.operators import aggregates as agg
from tarmac.operators import joins, reshape, sweep
from tarmac.operators import summary as sm
from tarmac.registry import answers
from tarmac.session import scratch_path
from tarmac.streaming import requests as rq

DAY0 = dt.date(2000, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def brute_nearest(d, calendar):
    """Nearest of a sorted calendar, the earlier on ties."""
    if not calendar:
        return None
    i = bisect_left(calendar, d)
    near = calendar[max(i - 1, 0):i + 1]
    return min(near, key=lambda x: (abs((x - d).days), x))


def test_asof_against_a_long_calendar(spark):
    rng = random.Random(1)
    calendar = sorted({day(rng.randint(-200_000, 200_000)) for _ in range(140_000)} | {day(7), day(9)} - {day(8)})
    calendar = [d for d in calendar if d != day(8)]
    assert len(calendar) > 100_000
    asked = [day(rng.randint(-300_000, 300_000)) for _ in range(3000)] + [day(8)] * 5
    left = spark.createDataFrame([(d,) for d in asked] + [(None,)], "d date")
    right = spark.createDataFrame([(d,) for d in calendar] * 2 + [(None,)], "d date").repartition(7)
    got = {r.d: (r.NEAREST, r.DAYS_TO) for r in joins.nearest_asof(left, right, "d").collect()}
    want = {d: brute_nearest(d, calendar) for d in asked}
    assert got == {d: (n, (n - d).days) for d, n in want.items()}
    assert got[day(8)] == (day(7), -1)


def test_asof_by_key_with_gaps(spark):
    rng = random.Random(2)
    left = [(k, day(rng.randint(-900, 900))) for k in ("a", "b", None, "only left") for _ in range(80)]
    right = [(k, day(rng.randint(-400, 400))) for k in ("a", "b", None, "only right") for _ in range(6)]
    calendar = defaultdict(set)
    for k, d in right:
        calendar[k].add(d)
    lf, rt = spark.createDataFrame(left, "k string, d date"), spark.createDataFrame(right, "k string, d date")
    for width in (1, 32, 10_000):
        got = Counter(map(tuple, joins.nearest_asof(lf, rt, "d", ["k"], width).collect()))
        want = Counter()
        for k, d in set(left):
            n = brute_nearest(d, sorted(calendar[k]))
            want[k, d, n, None if n is None else (n - d).days] += 1
        assert got == want
    assert {r.NEAREST for r in joins.nearest_asof(lf, rt.limit(0), "d", ["k"]).collect()} == {None}
    assert joins.nearest_asof(lf.limit(0), rt, "d", ["k"]).collect() == []


# ------------------------------------------------------------- sweep
def brute_metrics(rows, t):
    pos, neg = [p for p, y in rows if y == 1], [p for p, y in rows if y != 1]
    area = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
    clip = [(min(max(p, 1e-15), 1 - 1e-15), y) for p, y in rows]
    loss = -sum(math.log(p) if y == 1 else math.log(1 - p) for p, y in clip) / len(rows) if rows else None
    return (sum(p >= t for p in pos), sum(p >= t for p in neg), sum(p < t for p in neg), sum(p < t for p in pos), area, loss)


def test_threshold_sweep_and_metrics(spark):
    rng = random.Random(3)
    cases = [[(round(rng.random() ** 2, 3), rng.randint(0, 1)) for _ in range(400)], [(0.2, 1), (0.2, 0), (0.2, 1)],
             [(0.0, 0), (1.0, 1), (1.0, 0)], [(0.3, 1)], []]
    for rows in cases:
        df = spark.createDataFrame([(p, float(y)) for p, y in rows] + [(None, 1.0), (0.5, None)], "p double, y double")
        got = {r.THRESHOLD: (r.TP, r.FP, r.TN, r.FN) for r in sweep.threshold_sweep(df, "p", "y").collect()}
        assert got == {t: brute_metrics(rows, t)[:4] for t, _ in rows}
        m = sweep.metrics(df, "p", "y", 0.25).first()
        want = brute_metrics(rows, 0.25)
        assert tuple(m)[:4] == want[:4]
        for a, b in zip(tuple(m)[4:], want[4:], strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-5)
    r = sweep.threshold_sweep(spark.createDataFrame([(0.5, 0.0)], "p double, y double"), "p", "y").first()
    assert r.RECALL is None and r.PRECISION == 0 and r.FALL_OUT == 1


# ------------------------------------------------------------- totals and bitmaps
def test_all_totals_tell_null_groups_from_totals(spark):
    rows = [(1, 0, 2.0), (1, None, 3.0), (None, 0, 5.0), (None, None, 7.0), (2, 1, None)]
    df = spark.createDataFrame(rows, "WEEK int, ARR_DELAY_GROUP int, FLIGHTS double")
    got = Counter(tuple(r) for r in reshape.all_totals(df, "WEEK").collect())
    assert got == Counter([(1, None, 1, 5.0), (None, None, 1, 12.0), (2, None, 1, None), (None, 0, 2, 7.0), (None, None, 2, 10.0),
                           (None, 1, 2, None), (None, None, 3, 17.0)])
    plan = reshape.all_totals(df, "WEEK")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.index("Expand") < plan.rindex("Aggregate")  # expands cells, not rows


def test_carrier_bitmaps_beyond_one_word(spark):
    rng = random.Random(5)
    rows = [(2010 + rng.randint(0, 1), rng.randint(1, 3), rng.choice("AB"), "C", f"c{rng.randint(0, 199):03d}") for _ in range(900)]
    fl = spark.createDataFrame(rows, "YEAR int, MONTH int, ORIGIN string, DEST string, CARRIER string")
    codes = spark.createDataFrame([(f"c{i:03d}", i) for i in range(200)], "CARRIER string, CODE int")
    bits = agg.carrier_bits(fl, codes)
    for period in (["YEAR", "MONTH"], ["YEAR"], []):
        got = agg.carriers_over(bits, period)
        want = fl.groupBy(*period, "ORIGIN", "DEST").agg(F.count_distinct("CARRIER").alias("CARRIERS"))
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


# ------------------------------------------------------------- requests
def test_request_stream_survives_a_restart(spark, ctx):
    landing, out, ckpt = (scratch_path(spark, x) for x in ("rq-in", "rq-out", "rq-ckpt"))
    some = ctx.requests.orderBy("variables").limit(40).collect()
    one = spark.createDataFrame(some[:25], ctx.requests.schema)
    two = spark.createDataFrame(some[25:], ctx.requests.schema)
    answer = lambda batch: answers(ctx, batch)
    rq.land_requests(one, landing)
    rq.answer_arrived(spark, landing, out, ckpt, answer)
    first = Counter(map(tuple, rq.read_answers(spark, out).collect()))
    assert first == Counter(map(tuple, answers(ctx, one).collect()))
    for f in glob.glob(f"{ckpt.removeprefix('file://')}/commits/[.0-9]*", include_hidden=True):
        os.remove(f)  # the run ended after writing its answers and before noting that
    rq.land_requests(two, landing)
    rq.answer_arrived(spark, landing, out, ckpt, answer)
    both = one.unionByName(two)
    assert Counter(map(tuple, rq.read_answers(spark, out).collect())) == Counter(map(tuple, answers(ctx, both).collect()))


def test_few_requests_read_few_years(spark, ctx):
    asked = ctx.requests.orderBy("variables").limit(3)
    sub = sm.requested_slices(ctx.subset, sm.parse_requests(asked))
    years = {r.YEAR for r in sm.parse_requests(asked).select((F.col("YEAR") - 1).alias("YEAR")).collect()}
    got = sub.select("YEAR").distinct().collect()
    assert {r.YEAR for r in got} <= years
    assert sub.count() < 0.2 * ctx.subset.count()
    plan = sub._jdf.queryExecution().executedPlan().toString()
    assert any("YEAR" in p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:])
