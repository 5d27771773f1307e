"""Filter interaction audit (13): what each of five filters removes, in every order.

A document fails filter A with under 200 words, B when fewer than half of its words are
distinct, C when capitals A-Z are more than 2 % of its code points, D when it holds one of
#$%&*| and E when a smaller doc_id has the same text. The documents of a part (a source) are
counted in a contingency tensor of 2 x 2 x 2 x 2 x 2 cells, pass or fail along each filter's
axis, for all documents, good ones and toxic ones. A step of an order is a contraction of that
tensor: earlier filters select ``pass``, the step's own ``fail`` (removed) or ``pass`` (kept),
later ones ``all``. One einsum does all 600 steps of all 120 orders.

Spark reads each text once, combines equal (doc_id, text, source) rows before any shuffle, and
meets texts by their SHA-256. The rows that come first are found by (digest, smallest doc_id),
so a text that a third of all rows share is no hot key; no text is shuffled. A part's tensor has
at most 32 rows when it reaches its task.

Defined results: a null text is the empty text; a null source is the part ''. A row without a
doc_id has no label and no smaller doc_id. Rows that repeat a doc_id and text do not fail E by
each other. A document is good (toxic) if any of its label rows says 1. An empty table gives no
rows. Other columns play no part.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import stored, text_of

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 2
SIGNS = "[#$%&*|]"
SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")

ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: axis of the filter of every step, order after order
AXIS = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
#: selections along an axis of (pass, fail)
PASS, FAIL, ALL = np.array([[1, 0], [0, 1], [1, 1]], dtype=np.int64)


def failures(text: Column) -> dict[str, Column]:
    """The conditions of A to D on a text column."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {"A": F.size(words) < MIN_WORDS,
            "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT,
            "C": capitals * F.lit(100).cast("long") > F.length(text) * F.lit(CAPITALS_PERCENT).cast("long"),
            "D": text.rlike(SIGNS)}


def contingency(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (failed), and the numbers of documents: all, good, toxic."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                    text_of().alias("t"))
    d = d.select("doc_id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
                 *[c.alias(k) for k, c in failures(F.col("t")).items()])
    rows = stored(d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n")), "audit-rows")

    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")) \
        .withColumn("is_first", F.lit(True))
    rows = rows.join(first, ["digest", "doc_id"], "left") \
        .withColumn("E", F.col("doc_id").isNotNull() & F.col("is_first").isNull())

    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")) \
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
             F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn("_none", F.lit(False))
    # rows without doc_id are spread by their text instead of meeting under one null key
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.xxhash64("digest"))).withColumn("_none", F.col("doc_id").isNull())
    rows = rows.join(marks, ["_id", "_none"], "left")
    zero = F.lit(0).cast("long")
    return rows.groupBy("part", *FILTERS).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(zero)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(zero)).alias("toxic"))


def _contract(tensor: np.ndarray, before: np.ndarray, own: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Measures x orders x steps of the tensor, with a selection for the filters before the
    step, for its own and for those after it."""
    step = np.arange(5)[None, :, None]
    place = np.argsort(AXIS, axis=1)[:, None, :]  # order, 1, axis: the axis' place in the order
    pick = np.where((place < step)[..., None], before, np.where((place == step)[..., None], own, after))
    return np.einsum("mabcde,psa,psb,psc,psd,pse->mps", tensor, *[pick[:, :, x] for x in range(5)], optimize=True)


def audit_part(cells: pa.Table) -> pa.Table:
    """All orders and steps of one part from its (at most 32) cells."""
    tensor = np.zeros((3, 2, 2, 2, 2, 2), np.int64)
    at = tuple(cells.column(f).to_numpy().astype(int) for f in FILTERS)
    for i, name in enumerate(("n", "good", "toxic")):
        np.add.at(tensor[i], at, cells.column(name).to_numpy())
    removed = _contract(tensor, PASS, FAIL, ALL)
    kept = _contract(tensor[:1], PASS, PASS, ALL)[0]
    failing = _contract(tensor[:1], ALL, FAIL, ALL)[0]
    alone = _contract(tensor[:1], PASS, FAIL, PASS)[0]
    share = np.bincount(AXIS.ravel(), weights=removed[0].ravel(), minlength=5)  # sums below 2**53
    flat = [kept, removed[0], failing - removed[0], alone, removed[1], removed[2], share.astype(np.int64)[AXIS]]
    n = AXIS.size
    return pa.table([pa.array([cells.column("part")[0].as_py()] * n, pa.string()), pa.array(np.repeat(ORDERS, 5).tolist(), pa.string()),
                     pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))), *[pa.array(x.ravel()) for x in flat]],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return contingency(docs, labels).groupBy("part").applyInArrow(audit_part, SCHEMA)


def op13_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return filter_audit(docs, labels)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic
      FROM labels GROUP BY doc_id),
w AS (SELECT d.*, first, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') AS w FROM d JOIN m ON d.t = m.t),
f AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask,
        coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, s::INT AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS prior
      FROM o, range(1, 6) r(s)),
r AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN mask & (prior | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & prior = 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & prior > 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & prior = 0 AND mask & own > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & prior = 0 AND mask & own > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
