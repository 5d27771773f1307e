"""The corpus pipeline against brute force, stage by stage on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from llm_rows import SCHEMA, rows
from pyspark.sql import functions as F
from test_operators import brute_classes, brute_hits, brute_targets

from tarmac.llm import mixing, toxicity
from tarmac.llm.common import shared_path, stored, table

DATA = "/root/testdata/sf0.001"


def plain(df):
    return [(r.doc_id, r.text or "", r.source) for r in df.collect()]


def test_stages_against_brute_force(spark):
    docs = table(spark, DATA, "documents")
    labels, bench = table(spark, DATA, "labels"), table(spark, DATA, "benchmark")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stored(stage(spark, kept[-1], DATA), "stage-test"))
        assert kept[-1].columns == docs.columns, name
    ids = [Counter(i for i, _, _ in plain(k)) for k in kept]

    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert set(ids[1]) == {i for i, s in score.items() if s < toxicity.THRESHOLD}
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    gone = set(ids[0]) - set(ids[1])
    assert all(marked.get(i, 1) == 1 for i in gone) and len(gone) >= 1

    assert set(ids[2]) == {i for i, c, _ in brute_classes(plain(kept[1])) if i == c}

    items = [(r.item_id, r.text) for r in bench.collect()]
    assert set(ids[3]) == {i for i, _, _, _, _, hit in brute_hits(plain(kept[2]), items) if not hit}

    plan = {r.doc_id: r.epochs + (2 * r.part > r.size) for r in mixing.mix(kept[3]).collect()}
    assert ids[4] == Counter({i: n for i, n in plan.items() if n})
    sizes, words = Counter(), Counter()
    for i, t, s in plain(kept[3]):
        sizes[s] += len(t.split())
    for i, t, s in plain(kept[4]):
        words[s] += len(t.split())
    for s, target in brute_targets(sizes).items():
        most = max(len(t.split()) for _, t, x in plain(kept[3]) if x == s)
        assert abs(words[s] - target) <= most

    out = corpus_pipeline.STAGES[-1][1](spark, kept[4], DATA)
    assert out.columns == [*docs.columns, "shard"]
    assert Counter(r.doc_id for r in out.collect()) == ids[4]


def test_run_is_the_stages(spark):
    docs, first = table(spark, DATA, "documents"), None
    for _ in range(2):
        got = Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, DATA).collect())
        assert got and (first is None or got == first)
        first = got
    assert {i for i, _ in first} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_awkward_and_empty_documents(spark):
    path = shared_path(spark, "awkward")
    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "no such words in any of them at all, I hope")], "item_id long, text string") \
        .write.parquet(f"{path}/benchmark.parquet")
    for data in (rows(), []):
        docs = spark.createDataFrame(data, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, path), "awkward-stage")
        assert docs.where(F.col("shard").isNull()).count() == 0
        assert bool(docs.count()) == bool(data)
