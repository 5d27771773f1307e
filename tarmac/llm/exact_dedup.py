"""Exact dedup (7), native: local, salted and global combining that compares whole texts.

Stage 1 groups by (digest, salt, text): every task first combines its own rows, so a text
held by a third of all rows reaches the shuffle as one row per task, spread over the salts.
Stage 2 combines the salt winners by (digest, text). Both group by the text itself, so equal
digests of different texts never merge. Documents then look their winner up by digest; only
texts whose digest is shared by another text are looked up by digest and text.

Defined results: a null text is the empty text. A null doc_id loses to any other; a group of
null ids only has a null keep_id and keeps those rows. Rows that repeat a doc_id and text are
counted each and share one decision. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import stored, text_of

SALTS = 16


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def winners(docs: DataFrame, digest=sha256_digest, salts: int = SALTS) -> DataFrame:
    """One row per text: digest, keep_id, group_size, n_same (texts of that digest) and the
    text itself only where n_same is above one."""
    from pyspark.sql import Window as W

    rows = docs.select(F.col("doc_id").alias("id"), text_of().alias("t"))
    rows = rows.withColumn("digest", digest(F.col("t"))) \
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    salted = rows.groupBy("digest", "salt", "t").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    merged = salted.repartition("digest").groupBy("digest", "t") \
        .agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    same = F.count(F.lit(1)).over(W.partitionBy("digest"))
    return merged.withColumn("n_same", same) \
        .select("digest", "keep_id", "group_size", "n_same", F.when(F.col("n_same") > 1, F.col("t")).alias("t"))


def exact_dedup(docs: DataFrame, digest=sha256_digest, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_digest of every row."""
    best = stored(winners(docs, digest, salts), "exact-winners")
    text = text_of()
    keys = docs.select(F.col("doc_id"), digest(text).alias("digest"))
    out = keys.join(best.where("n_same = 1").select("digest", "keep_id", "group_size"), "digest")
    if not best.where("n_same > 1").isEmpty():
        shared = docs.select(F.col("doc_id"), digest(text).alias("digest"), text.alias("t"))
        out = out.unionByName(shared.join(best.where("n_same > 1").drop("n_same"), ["digest", "t"]).drop("t"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.col("digest").alias("text_digest"))


def op7_exact_dedup(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs).withColumnRenamed("text_digest", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
