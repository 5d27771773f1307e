"""The Jaccard join, the ranked search and the filter audit against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import SCHEMA, rows, words
from pyspark.sql import functions as F

from tarmac.llm import filter_audit, jaccard_join, lexical_search
from tarmac.llm import textnum as tn

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------- 11
def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()


def brute_components(docs):
    """Counter of (doc_id, n_shingles, component_id)."""
    sets = [shingle_set(t) for _, t in docs]
    low = list(range(len(docs)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                low[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(i)].append(d)
    return Counter((d, len(sets[i]), min(ids[find(i)], default=None)) for i, (d, _) in enumerate(docs))


def components_of(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def cloud(seed, originals=4, copies=40):
    """Copies that differ from an original, and from each other, by about the threshold."""
    rng = random.Random(seed)
    out = []
    for _ in range(originals):
        base = words(rng, rng.choice([9, 60, 200])).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 50))):
                w[rng.randrange(len(w))] = words(rng, 1)
            if rng.random() < 0.3:
                w += words(rng, rng.randint(1, max(1, len(w) // 12))).split()
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def test_jaccard_join_awkward_rows(odd, nothing):
    assert components_of(jaccard_join.op11_jaccard_join(odd)) == brute_components([(r[0], r[1]) for r in rows()])
    assert jaccard_join.op11_jaccard_join(nothing).collect() == []


@pytest.mark.parametrize("seed,tile", [(1, 256), (2, 4)])
def test_jaccard_join_clouds(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    docs = cloud(seed)
    got = components_of(jaccard_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    expect = brute_components(docs)
    assert got == expect
    assert 4 < len({c for _, _, c in expect}) < len(docs)


def test_bound_never_excludes_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate([a[:rng.integers(0, n + 1)], rng.integers(0, 2**64, int(rng.integers(0, n // 5 + 2)), dtype=np.uint64)])
        if not len(b):
            continue
        text = np.repeat([0, 1], [len(a), len(b)])
        packed, width = jaccard_join.bitmaps(text, np.concatenate([a, b]), np.array([len(a), len(b)]))
        raw = packed.tobytes()
        batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "na": [len(a)], "nb": [len(b)], "bits_a": [raw[:width[0] // 8]],
                                            "bits_b": [raw[width[0] // 8:]]})
        common = len(set(a.tolist()) & set(b.tolist()))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert next(jaccard_join._pass_bound(85)([batch])).num_rows == 1


def test_keyed_hash_tells_forged_words_apart():
    w = tn.Words(*tn.column_bytes(pa.array(["il5pj3jotppatabd imahb8zt842g828x", "Word word", "x" * 700 + " " + "x" * 700])), tn.NOT_SPACE)
    h = w.keyed(True, 12345)
    assert h[0] != h[1] and h[2] == h[3] and h[4] == h[5] and len(set(h.tolist())) == 4
    assert (w.keyed(True, 54321) != h).all()
    assert w.strings().to_pylist()[:2] == [b"il5pj3jotppatabd", b"imahb8zt842g828x"]


# ------------------------------------------------------------- 12
def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for at, (i, c) in enumerate(counted):
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, at))
        for rank, (s, none, i, _) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, None if none else i, -s] += 1
    return out


def search_result(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


ITEMS = [(1, rows()[3][1]), (2, rows()[7][1]), (2, "One two  a"), (None, "one"), (4, None), (5, ""), (6, "nowhere-to-be-found"),
         (7, "z " * 50), (8, "\u0000nul ÉÉ é one"), (9, " ".join(r[1] or "" for r in rows()[:20]))]


@pytest.mark.parametrize("k,shard,block", [(50, 8192, 1024), (3, 7, 2), (1, 1, 1)])
def test_lexical_search(spark, odd, k, shard, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit("x")).withColumn("row", F.lit(1))
    got = search_result(lexical_search.lexical_search(odd, items, k, shard, block))
    assert got == brute_search([(r[0], r[1]) for r in rows()], ITEMS, k)


def test_lexical_search_of_no_rows(spark, odd, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.op12_lexical_search(nothing, items).collect() == []
    assert lexical_search.op12_lexical_search(odd, items.limit(0)).collect() == []


def test_best_positions_stop_early_and_keep_ties():
    rng = np.random.default_rng(1)
    docs, lists = 4000, 12
    impact = np.round(rng.pareto(1.5, (lists, docs)) * 100).astype(np.int64)
    impact[:, rng.random(docs) < 0.5] //= 50
    t, d = np.nonzero(impact)
    table = pa.table({"row": d, "tid": t + 100, "impact": impact[t, d], "doc_id": 7000 - d})
    shard = lexical_search.Shard(table)
    for mine in ([100, 103, 104], list(range(100, 112)), [99, 111]):
        total = impact[[i - 100 for i in mine if i > 99]].sum(0)
        order = sorted((-s, 7000 - i) for i, s in enumerate(total) if s > 0)[:50]
        at, scores = shard.search(np.array(mine), 50)
        assert [(-s, int(i)) for s, i in zip(scores.tolist(), shard.ids[at], strict=True)] == order
    assert shard.reads < 0.6 * (3 + 12 + 1) * docs


# ------------------------------------------------------------- 13
def brute_audit(docs, labels):
    first, good, toxic = {}, Counter(), Counter()
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            good[i] |= int(q == 1)
            toxic[i] |= int(x == 1)
    parts = defaultdict(list)
    for i, part, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        parts[part or ""].append((fails, good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out = Counter()
    for part, ds in parts.items():
        lines, share = [], Counter()
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                at = [d for d in ds if not any(d[0][g] for g in order[:s])]
                gone = [d for d in at if d[0][f]]
                failing = sum(d[0][f] for d in ds)
                share[f] += len(gone)
                lines.append((f, ("".join(order), s + 1, len(at) - len(gone), len(gone), failing - len(gone),
                                  sum(sum(d[0].values()) == 1 and d[0][f] for d in ds), sum(d[1] for d in gone),
                                  sum(d[2] for d in gone))))
        for f, line in lines:
            out[(part, *line, share[f])] += 1
    return out


def test_filter_audit(spark, odd, nothing):
    rng = random.Random(4)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(80)] * 2 + [(None, 1, 1), (3, 1, 0), (3, 0, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1)).withColumn("E", F.lit(1))
    long = [(1000 + i, "x", "w" + " w".join(map(str, range(n))) + s) for i, (n, s) in
            enumerate([(199, ""), (200, ""), (201, " #"), (250, " AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"), (201, " #")])]
    half = [(2000, "x", " ".join(["a"] * 100 + [f"b{i}" for i in range(100)])), (2001, "", " ".join(["a"] * 101 + [f"b{i}" for i in range(99)])),
            (5000, "", "|"), (None, None, "|"), (5000, "", "|"), (5001, None, "|")]
    docs = [(r[0], r[3], r[1]) for r in rows()] + long + half
    plain = spark.createDataFrame([(i, t, p) for i, p, t in docs], "doc_id long, text string, source string")
    got = filter_audit.op13_filter_audit(plain.withColumn("part", F.lit("?")).withColumn("n", F.lit(1)), marks)
    assert Counter(tuple(r) for r in got.collect()) == brute_audit(docs, labels)
    assert Counter(tuple(r) for r in filter_audit.op13_filter_audit(odd, marks.limit(0)).collect()) == \
        brute_audit([(r[0], r[3], r[1]) for r in rows()], [])
    assert filter_audit.op13_filter_audit(nothing, marks).collect() == []
