"""Data-driven class merge, stored clustering, exact quantiles, union by name, constant features."""

import random
from collections import defaultdict

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tarmac.operators import classify as cls
from tarmac.operators import clean, cluster, stored_fit
from tarmac.plans import catalog_more
from tarmac.plans import features as feat
from tarmac.session import scratch_path


def brute_merge(rows, min_size):
    """rows: (group, class, x, y); the classes after the merge, in order."""
    members = defaultdict(list)
    for g, k, x, y in rows:
        if g is not None and k is not None:
            members[g, k].append((x, y))
    mean = {gk: [sum(v) / len(p) for v in zip(*p)] for gk, p in members.items()}
    out = []
    for g, k, _, _ in rows:
        if (g, k) in members and len(members[g, k]) < min_size:
            large = [(round(sum((a - b) ** 2 for a, b in zip(mean[g, k], mean[h, j])), 6), j)
                     for h, j in members if h == g and len(members[h, j]) >= min_size]
            k = min(large)[1] if large else k
        out.append((g, k))
    return sorted(out, key=repr)


def test_merge_nearest(spark):
    rng = random.Random(3)
    rows = [(g, k, rng.uniform(0, 9), rng.uniform(0, 9)) for g in (1, 2, 3) for k in range(12)
            for _ in range(rng.choice((1, 2, 5, 9)))]
    rows += [(4, 0, 0.0, 0.0), (4, 1, 1.0, 1.0)]  # no large class
    rows += [(5, 7, -1.0, 0.0)] * 6 + [(5, 2, 1.0, 0.0)] * 6 + [(5, 9, 0.0, 5.0)]  # a tie: the lower id
    rows += [(None, 1, 0.0, 0.0), (1, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, k int, x double, y double")
    got = cluster.merge_nearest(df, ["x", "y"], ["g"], "k", 5)
    assert got.columns == df.columns
    want = brute_merge(rows, 5)
    assert sorted(((r.g, r.k) for r in got.collect()), key=repr) == want
    assert (5, 9) not in want and (5, 2) in want and (4, 0) in want
    whole = cluster.merge_nearest(df.where("g = 5").drop("g"), ["x", "y"], [], "k", 5)
    assert {r.k for r in whole.collect()} == {2, 7}
    assert cluster.merge_nearest(df.limit(0), ["x", "y"], ["g"], "k", 5).count() == 0


def test_merge_nearest_of_the_query_moves_rows(ctx):
    before = catalog_more._fixed_airport_assign(ctx, feat.AIRPORT_K)
    n = {r["CLASS"]: r["count"] for r in before.groupBy("CLASS").count().collect()}
    after = {r["CLASS"]: r["count"] for r in catalog_more.q_ml_merge_nearest(ctx).groupBy("CLASS").count().collect()}
    if any(v >= feat.MIN_MEMBERS for v in n.values()):
        assert set(after) == {k for k, v in n.items() if v >= feat.MIN_MEMBERS}
    assert sum(after.values()) == sum(n.values())


def test_stored_pipeline_classes_a_new_year(spark):
    rng = random.Random(4)
    rows = [(y, i, None if i % 17 == 3 else float(i % 3) * 10 + rng.random(), (i % 3) * 5 + rng.random(), 4.0)
            for y in (1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "y int, i int, a double, b double, same double")
    old, new = df.where("y < 3"), df.where("y = 3").withColumn("b", F.col("b") + 0.5)
    fitted = stored_fit.cluster_pipeline(["a", "b", "same"], 2, 3, 1234).fit(old)
    path = scratch_path(spark, "pipeline-test")
    fitted.save(path)
    again = PipelineModel.load(path)
    classes = lambda m, d: sorted((r.y, r.i, r.CLASS) for r in m.transform(d).collect())
    assert classes(again, old) == classes(fitted, old)
    assert classes(again, new) == classes(fitted, new)
    out = again.transform(new)
    assert out.where(~stored_fit.holds_nearest(out, [list(map(float, c)) for c in again.stages[-1].clusterCenters()])).count() == 0
    assert {len(set(r.CLASS for r in out.where(F.col("i") % 17 != 3).where(F.col("i") % 3 == m).collect())) for m in range(3)} == {1}
    # numbers of the fitted years, not of the new one
    scale = again.stages[1]
    mean = old.agg(F.avg("b")).first()[0]
    assert scale.getOrDefault(scale.means)[1] == pytest.approx(mean)
    assert scale.getOrDefault(scale.deviations)[2] == 1.0


def test_quantiles_with_an_outlier(spark):
    rng = random.Random(5)
    vals = [rng.gauss(0, 1) for _ in range(3000)] + [1e18, -1e15] + [0.25] * 500
    df = spark.createDataFrame([(v, float(i % 7), None) for i, v in enumerate(vals)], "a double, b double, c double")
    shares = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {(r.FEATURE, r.SHARE): r.VALUE for r in cluster.quantiles(df, ["a", "b", "c"], shares).collect()}
    for name, v in (("a", sorted(vals)), ("b", sorted(float(i % 7) for i in range(len(vals))))):
        for s in shares:
            at = s * (len(v) - 1)
            lo = int(at)
            hi = min(lo + (at > lo), len(v) - 1)
            assert got[name, s] == pytest.approx(v[lo] + (v[hi] - v[lo]) * (at - lo)), (name, s)
    assert not any(f == "c" for f, _ in got)


def test_union_of_frames_with_different_columns(spark):
    a = spark.createDataFrame([(2010, "X", 1)], "YEAR int, IATA string, SEC_DEL int")
    b = spark.createDataFrame([("Y", 2011)], "IATA string, YEAR int")
    out = clean.union_frames([a, b])
    assert out.columns == ["YEAR", "IATA", "SEC_DEL"]
    assert sorted(map(tuple, out.collect())) == [(2010, "X", 1), (2011, "Y", None)]
    with pytest.raises(ValueError):
        clean.union_frames([])


def test_constant_features_give_the_share(spark):
    rows = [(3.0, 1.0, y) for y in (0, 0, 0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, late int")
    model = cls.fit(df, ["a", "b"], "late")
    scored = cls.proba(df.unionByName(spark.createDataFrame([(None, 1.0, 0)], df.schema)), model)
    assert [r.PROBA for r in scored.orderBy(F.col("a").asc_nulls_last()).collect()] == [0.25] * 4 + [None]
