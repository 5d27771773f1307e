"""Cases that once gave wrong results or crashed."""

import re
import time
from collections import Counter

import pytest

from tarmac.llm import decontaminate, near_dedup, substring_dedup, token_counts, toxicity

#: two words that share a 64-bit hash of the unkeyed function
TWINS = ("il5pj3jotppatabd", "imahb8zt842g828x")


def test_other_words_are_no_hit(spark):
    words = [f"w{i}" for i in range(10)]
    words[4] = TWINS[0]
    item = " ".join(words)
    docs = spark.createDataFrame([(1, item.replace(*TWINS)), (2, f"And {item.upper()}, so"), (3, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in decontaminate.op6_decontaminate(docs, bench).collect()}
    assert got == {1: (0, False), 2: (10, True), 3: (10, True)}
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {1}


@pytest.mark.parametrize("grow", [False, True])
def test_other_sentences_stay(spark, grow):
    text = f"These are eight plain words with {TWINS[0]} inside. And a second sentence of {TWINS[0]} follows here."
    docs = spark.createDataFrame([(1, text), (2, text.replace(*TWINS)), (3, text)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs, grow=grow).collect()}
    assert got == {1: 0, 2: 0, 3: 2}


def test_rows_are_kept_not_ids(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, x), (5, x), (5, y), (None, x), (None, z), (9, ""), (9, y), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, near_dedup.near_dedup(docs).collect()))
    assert got == Counter([(1, x), (5, y), (None, z), (9, ""), (9, None)])


# ------------------------------------------------------------- tokens
def encoder():
    with open(token_counts.VOCABULARY, "rb") as fh:
        return token_counts._encoder(fh.read(), token_counts.PATTERN)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r\n", " \t\n", "　", "  "])
@pytest.mark.parametrize("before,after", [("word", "next"), ("", "next"), ("word", ""), ("", ""), ("a.", "'s 5"), (" x", "\x1c")])
def test_long_blanks_are_counted_as_the_pattern_does(monkeypatch, blank, before, after):
    e = encoder()
    monkeypatch.setattr(token_counts, "BLANKS", re.compile(token_counts.BLANKS.pattern.replace("4096", "3")))
    for n in (1, 2, 3, 4, 7, 50):
        text = before + blank * n + after
        for t in (text, text * 3, text + "it's 12  " + text):
            assert token_counts.n_tokens(e, t) == len(e.encode_ordinary(t))


def test_very_long_blanks(spark):
    e = encoder()
    texts = [s * 10_000_000 for s in (" ", "\n", "\t")] + ["a" + " \n\t" * 3_000_000 + "b"]
    start = time.time()
    for t in texts:
        assert token_counts.n_tokens(e, t) > 100_000 or len(set(t)) == 1
    assert time.time() - start < 120
    docs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, None)], "doc_id long, text string")
    got = {r.length: r.n_docs for r in token_counts.histogram(docs).collect()}
    assert got == {0: 1, token_counts.n_tokens(e, "a" + " " * 1_000_000 + "b"): 1}


# ------------------------------------------------------------- toxicity
def brute_matches(entries, exceptions, text):
    spans = [(m.start(1), m.start(1) + len(p)) for p in exceptions for m in re.finditer(f"(?=({re.escape(p)}))", text)]
    out = Counter()
    for p, w in entries.items():
        if p in exceptions:
            continue
        for m in re.finditer(f"(?=({re.escape(p)}))", text):
            a, b = m.start(1), m.start(1) + len(p)
            out[a, b, w] += not any(x <= a and b <= y for x, y in spans)
    return +out


def test_matches_against_naive_search():
    import ahocorasick
    import random

    entries = {" trash ": 1.0, "ab": 2.0, " a b ": 0.5, "bb": 3.0, " can ": 0.25}
    exceptions = [" trash can ", "abb", " b a b "]
    a = ahocorasick.Automaton()
    for p in exceptions:
        a.add_word(p, (len(p), None))
    for p, w in entries.items():
        a.add_word(p, (len(p), w))
    a.make_automaton()
    rng = random.Random(6)
    for _ in range(300):
        text = " " + " ".join(rng.choice(["trash", "can", "a", "b", "abb", "bba", "ab"]) for _ in range(rng.randint(0, 25))) + " "
        assert Counter(toxicity.matches(a, text)) == brute_matches(entries, exceptions, text)
    long = " " + "trash can " * 200_000
    start = time.time()
    assert len(toxicity.matches(a, long)) == len([1 for _ in re.finditer("(?= can )", long)]) - 200_000
    assert time.time() - start < 20
