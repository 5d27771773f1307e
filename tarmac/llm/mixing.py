"""Mixing sources to target weights (2), native: Efraimidis-Spirakis sampling.

Every source gets a budget of words. Whole epochs of the source come first. The rest of the
budget is filled with documents in the order of the exponential key -ln(u) / weight, where u
is a hash of the document and weight its quality; their sizes are prefix-summed up to the
budget, and the document on the boundary gives the words that are still missing.

Prefix sums run in two levels. A source of n documents is cut into about sqrt(n) key ranges;
documents are summed inside a range and range totals over the source, so a source that holds
a third of all rows is never sorted in one task.

Defined results: a null text has size 0; a null source is a source of its own, ordered last;
documents with equal keys are ordered by doc_id, then text hash, and rows equal in both are
interchangeable. Sources without words get target 0. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarmac.llm.common import stored, text_of

#: A word; the weights of sources in code-point order; the share of all words.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2.0


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """A quality weight from 0.5 to 1: highest where words are about five characters long."""
    length = F.length(text) / F.greatest(size, F.lit(1))
    return F.lit(0.5) + F.lit(0.5) / (F.lit(1.0) + F.abs(length - F.lit(6.0)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Budget of each source (columns s, n, words): weight shares of ``share`` times all
    words, capped at ``most`` times the source, the excess reshared by weight.

    Resharing ends where uncapped sources get one common multiple of their weight, so it is
    solved directly: sources in ascending order of cap per weight; the first whose cap is not
    below its share of what the sources before it leave over fixes the multiple.
    One row per source; the window sees as many rows as there are sources.
    """
    every = W.partitionBy(F.lit(1))
    place = (F.row_number().over(every.orderBy(F.col("s").asc_nulls_last())) - 1) % len(weights)
    d = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    d = d.withColumn("cap", F.lit(most) * F.col("words"))
    filled = every.orderBy(F.col("cap") / F.col("weight"), F.col("s").asc_nulls_last())
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("words").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    d = d.withColumn("level", left / weight)
    d = d.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every))
    return d.select("s", "n", "words", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
                    .alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, source, text_hash, size, source_size, target, epochs
    (whole passes), part (words of the fractional pass) and taken = epochs * size + part."""
    text = text_of()
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("s"), text.alias("t"))
    rows = rows.withColumn("size", word_count(F.col("t")))
    rows = rows.withColumn("th", F.md5(F.col("t").cast("binary")))
    bits = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "th").cast("binary"))
    unit = (F.conv(F.substring(bits, 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    w = quality(F.col("t"), F.col("size"))
    rows = stored(rows.select("id", "s", "size", "th", w.alias("w"),
                              (-F.log(unit) / w).alias("key")), "mix-sizes")

    sizes = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.avg("w").alias("w_mean"))
    plan = stored(targets(sizes, weights, share, most).join(
        sizes.select(F.col("s").alias("s2"), "w_mean"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2"), "mix-targets")
    epochs = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long")
    # one row per source, and no source fewer than one document; joined null-safe through a text key
    tagged = F.concat(F.when(F.col("s").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce("s", F.lit("")))
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("words")) \
        .withColumn("k", tagged).drop("s")
    d = rows.withColumn("k", tagged).join(plan, "k")
    # keys spread evenly by their distribution function; a range holds about sqrt(n) documents
    ranges = F.greatest(F.lit(1), F.floor(F.sqrt("n")))
    d = d.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key") * F.col("w_mean"))) * ranges), ranges - 1))
    totals = d.groupBy("k", "range").agg(F.sum("size").alias("total"))
    totals = totals.select("k", "range", F.coalesce(
        F.sum("total").over(W.partitionBy("k").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        .alias("ranges_before"))
    inside = W.partitionBy("k", "range").orderBy("key", F.col("id").asc_nulls_last(), "th") \
        .rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inside_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["k", "range"])
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.round(F.col("rest")) - F.col("ranges_before")
                                             - F.col("inside_before"))).cast("long")
    return d.withColumn("part", part).select(
        F.col("id").alias("doc_id"), F.col("s").alias("source"), F.col("th").alias("text_hash"), "size",
        F.col("words").alias("source_size"), "target", "epochs", "part",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each is repeated once per whole epoch and once more if the
    fractional pass takes more than half of it; all columns of ``docs`` are kept."""
    plan = mix(docs, **options).select(
        F.col("doc_id").alias("_mx_id"), F.col("text_hash").alias("_mx_th"), F.col("source").alias("_mx_s"),
        (F.col("epochs") + F.when(F.col("part") * 2 > F.col("size"), 1).otherwise(0)).alias("_mx_n"))
    # rows alike in all three are interchangeable: one of their counts, the same for each, is used
    plan = plan.groupBy("_mx_id", "_mx_th", "_mx_s").agg(F.max("_mx_n").alias("_mx_n"))
    same = (F.col("doc_id").eqNullSafe(F.col("_mx_id")) & (F.md5(text_of().cast("binary")) == F.col("_mx_th"))
            & F.col("source").cast("string").eqNullSafe(F.col("_mx_s")))
    copies = F.explode(F.sequence(F.lit(1), F.col("_mx_n").cast("int")))
    kept = docs.join(plan.where("_mx_n > 0"), same)
    return kept.select(*[kept[c] for c in docs.columns], copies.alias("_mx_copy")).drop("_mx_copy")


def op2_mix_sources(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "part")


ORACLE = rf"""
WITH z0 AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
z1 AS (SELECT *, len(regexp_extract_all(t, '{WORD}'))::BIGINT AS size, md5(t) AS th FROM z0),
z AS (SELECT doc_id, source, size, th,
             0.5::DOUBLE + 0.5::DOUBLE / (1.0::DOUBLE + abs(length(t)::DOUBLE / greatest(size, 1) - 6.0::DOUBLE)) AS w,
             (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || th), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)
             / 4503599627370496.0::DOUBLE AS u FROM z1),
s0 AS (SELECT source, sum(size)::DOUBLE AS words FROM z GROUP BY source),
s1 AS (SELECT source, words, 2.0::DOUBLE * words AS cap,
              CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE
              ELSE 1.0::DOUBLE END AS weight FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * sum(words) OVER () - coalesce(sum(cap) OVER f, 0.0::DOUBLE))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0.0::DOUBLE)) AS level
       FROM s1 WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS lam FROM s2),
s AS (SELECT source, words, least(cap, coalesce(lam * weight, cap)) AS target FROM s3),
x AS (SELECT z.*, s.words, s.target, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END::BIGINT AS epochs,
             coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY -ln(u) / w, doc_id NULLS LAST, th
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source),
y AS (SELECT *, least(size, greatest(0, round(target - epochs * words) - before))::BIGINT AS part FROM x)
SELECT doc_id, size, words::BIGINT AS source_size, target, (epochs * size + part)::BIGINT AS taken, source, epochs, part FROM y
"""
