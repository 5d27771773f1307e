"""Sharding (5), native: extendible hashing.

A shard is a prefix of the document's hash bits. The whole corpus starts as the empty prefix;
only a bucket above the byte limit is split on its next bit, until every shard fits. Buckets
grow smaller with every bit, so a document's shard is its shortest prefix that fits. Buckets
are measured a few bits at a time: one round sums the still oversized buckets by the next
STEP bits, rolls the sums up to each prefix length, and hands on only what is too large.

Defined results: a bucket of one document is a shard even if the document alone exceeds the
limit. The first 32 bits come from the doc_id (null: an id of its own); the bits beyond from
the text and the row's position, so that any number of rows with one id still splits (their
shards may then differ between runs over differently laid out files). A null text has 0 bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import stored, text_of

LIMIT = 64 * 1024 * 1024
FINE = 128 * 1024
STEP = 8
BITS = 63


def hash_bits(doc_id: str = "doc_id") -> object:
    """64 hash bits as a long; the upper 32 depend on the doc_id alone."""
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary"))
    high = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    low = F.xxhash64(text_of(), F.monotonically_increasing_id())
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def prefix(bits, depth):
    """The first ``depth`` bits as a number (0 bits: 0)."""
    if isinstance(depth, int):
        return F.shiftrightunsigned(bits, 64 - depth) if depth else F.lit(0).cast("long")
    return F.expr(f"CASE WHEN {depth} = 0 THEN 0L ELSE shiftrightunsigned({bits}, 64 - {depth}) END")


def place(docs: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """_sh_bits, _sh_bytes, depth and shard (bit string) beside all columns of ``docs``.

    The table of narrow keys is written once; each round reads it again, and the documents
    meet their shard by joining one small table per round on the round's bit prefix.
    """
    base = docs.withColumn("_sh_bits", hash_bits()).withColumn("_sh_bytes", F.octet_length(text_of()).cast("long"))
    keys = stored(base.select("_sh_bits", "_sh_bytes"), "shard-keys")
    active, found, depth = keys, [], 0
    while depth < BITS:
        last = min(depth + step, BITS)
        cells = stored(active.groupBy(prefix(F.col("_sh_bits"), last).alias("cell"))
                       .agg(F.sum("_sh_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")), "shard-cells")
        lengths = F.explode(F.sequence(F.lit(depth if depth == 0 else depth + 1), F.lit(last))).alias("len")
        rolled = cells.select("cell", "bytes", "docs", lengths) \
            .withColumn("bucket", F.expr(f"shiftright(cell, {last} - len)"))
        fits = rolled.groupBy("len", "bucket").agg(F.sum("bytes").alias("b"), F.sum("docs").alias("n")) \
            .where((F.col("b") <= limit) | (F.col("n") <= 1) | (F.col("len") >= BITS)).select("len", "bucket")
        leaf = rolled.join(fits, ["len", "bucket"]).groupBy("cell").agg(F.min("len").alias("leaf"))
        cells = stored(cells.select("cell").join(leaf, "cell", "left"), "shard-leaves")
        found.append((last, cells.where("leaf IS NOT NULL")))
        over = cells.where("leaf IS NULL")
        if over.isEmpty():
            break
        active = active.join(over.select(F.col("cell").alias("_sh_over")),
                             prefix(F.col("_sh_bits"), last) == F.col("_sh_over"), "left_semi")
        depth = last
    out, levels = base, []
    for last, leaves in found:
        cell, leaf = f"_sh_cell{last}", f"_sh_leaf{last}"
        out = out.join(leaves.select(F.col("cell").alias(cell), F.col("leaf").alias(leaf)),
                       prefix(F.col("_sh_bits"), last) == F.col(cell), "left").drop(cell)
        levels.append(leaf)
    out = out.withColumn("_sh_depth", F.coalesce(*[F.col(x) for x in levels]).cast("int")).drop(*levels)
    name = F.expr("substring(lpad(conv(hex(_sh_bits), 16, 2), 64, '0'), 1, _sh_depth)")
    return out.withColumn("_sh_name", name)


def shard_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All columns of ``docs`` and the shard of each row (in a column ``shard``, replacing one of that name)."""
    placed = place(docs, limit)
    return placed.select(*[placed[c] for c in docs.columns if c != "shard"], F.col("_sh_name").alias("shard"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """One folder per shard, its rows in one file: rows are dealt out by shard, each within the limit."""
    shard_documents(docs, limit).repartition("shard").write.partitionBy("shard").parquet(path)


def op5_shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    placed = place(docs.select("doc_id", "text"), limit)
    return placed.select("doc_id", F.col("_sh_bytes").alias("n_bytes"), F.col("_sh_depth").alias("depth"),
                         F.col("_sh_name").alias("shard"))


def op5_shard_fine(docs: DataFrame) -> DataFrame:
    """The same with shards of at most FINE bytes, which splits small tables too."""
    return op5_shard(docs, FINE)


#: Holds for tables whose buckets fit within 32 bits.
ORACLE = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM documents),
p AS (SELECT doc_id, n_bytes, h, u.len, h >> (32 - u.len) AS bucket
      FROM d, (SELECT unnest(range(0, 33))::INTEGER AS len) u),
f AS (SELECT *, sum(n_bytes) OVER w AS b, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY len, bucket)),
leaf AS (SELECT doc_id, n_bytes, h, min(len) AS depth FROM f WHERE b <= {LIMIT} OR n = 1 GROUP BY ALL)
SELECT doc_id, n_bytes, depth, substr(lpad(bin(h), 32, '0'), 1, depth) AS shard FROM leaf
"""
ORACLE_FINE = ORACLE.replace(f"b <= {LIMIT}", f"b <= {FINE}")
