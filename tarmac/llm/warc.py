"""WARC (9): writing archives, and reading them back with boundary-chain verification.

Writing: pages with equal payloads are grouped by SHA-256; the smallest page_id writes a
response with the payload, the others a revisit that refers to it. Payloads that occur once
are responses without further ado: the table joined to the pages holds repeated ones only. Spark's text writer lays
down the records (its line separator is the record terminator), so commits and retries are
Spark's own.

Reading: Spark's text reader splits the archives at the magic string, in ranges that run in
parallel. Each piece that follows a magic is a candidate record; its header gives the offset
of the successor. Magic strings inside payloads make false candidates, so per archive the
candidates' successor links are followed from the start of the file by pointer jumping, and
only records that are reached count. Of every candidate only offsets and header fields are
gathered (a few hundred bytes each; an archive is limited in size by the writer). A record
whose payload holds a magic spans several pieces; these are read again, found by their SHA-256
(splits, and so places, may differ between two scans), and put together. A record of the chain
that can't be put together is an error.

Defined results: a null html is an empty payload; a null page_id counts as larger than any
(a group of null ids writes responses only) and comes back as null; rows that repeat a
page_id and payload are alike; a null url leaves out its header, and control characters in
urls are percent-encoded. Columns other than page_id, url and html play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import shared_path, stored

#: The format's version line, terminators and digest alphabet (RFC 4648).
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 50_000


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: four runs of ten hex digits, 40 bits, eight digits each."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), BASE32_HEX, BASE32)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The text of each record (without its terminator) in a column ``value``."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").alias("id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("key", F.sha2("body", 256)).withColumn("n", F.octet_length("body"))
    # only payloads that occur again; stored, so that their size decides how payloads are joined
    first = rows.where(F.col("n") >= min_bytes).groupBy("key") \
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    rows = rows.join(stored(first, "warc-again"), "key", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n"), F.lit(END))
    block_bytes = F.octet_length("http") + F.when(again, 0).otherwise(F.col("n"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    rows = rows.withColumn("http", http).withColumn("digest", base32_sha1(F.col("body").cast("binary")))
    return rows.select(F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))), F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.lit(DATE)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, line("WARC-Refers-To", urn(F.col("first")))).otherwise(F.lit("")),
        F.when(again, line("WARC-Profile", F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block_bytes), F.lit("\r\n"), F.col("http"),
        F.when(again, F.lit("")).otherwise(F.col("body"))).alias("value"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    records(pages, min_bytes).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic strings, in file order by (block, row)."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value"))


def _key() -> Column:
    return F.unhex(F.sha2("value", 256))


def _parsed(pieces: DataFrame) -> DataFrame:
    """Header fields of a candidate, and its payload's size and digest if it ends where its header says."""
    head = F.substring_index("value", END, 1)
    field = lambda name: F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    d = pieces.withColumn("size", F.octet_length("value").cast("long")).withColumn("head", head)
    d = d.withColumn("head_bytes", F.octet_length("head").cast("long"))
    d = d.withColumn("block_bytes", F.when((F.col("head_bytes") < F.col("size")) & (field("WARC-Type") != ""),
                                           field("Content-Length").try_cast("long")))
    whole = F.col("block_bytes") + F.col("head_bytes") + 2 * len(END) == F.col("size")
    http = F.expr("substring(cast(value AS binary), CAST(head_bytes + 5 AS int), CAST(block_bytes AS int))")
    d = d.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("http", F.when(F.col("whole"), http))
    d = d.withColumn("http_head", F.substring_index(F.col("http").cast("string"), END, 1))
    payload = F.expr("substring(http, octet_length(http_head) + 5)")
    http_length = F.regexp_extract("http_head", r"(?i)\r\nContent-Length:[ \t]*(\d+)", 1).try_cast("long")
    d = d.withColumn("payload", payload)
    return d.select(
        "file", "block", "row", _key().alias("key"), "size", "head_bytes", "block_bytes", "whole", field("WARC-Type").alias("type"),
        F.regexp_extract("head", r"(?i)\r\nWARC-Record-ID:[ \t]*<urn:page:(-?\d*)>", 1).try_cast("long").alias("id"),
        F.regexp_extract("head", r"(?i)\r\nWARC-Refers-To:[ \t]*<urn:page:(-?\d*)>", 1).try_cast("long").alias("refers"),
        F.regexp_extract("head", r"(?i)\r\nWARC-Payload-Digest:[ \t]*sha1:(\w+)", 1).alias("said"),
        http_length.alias("http_length"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("digest"))


#: What the chain passes on of a record.
CARRIED = ["type", "id", "refers", "said", "http_length", "payload_bytes", "digest"]
CHAINED = ("file string, key binary, start long, piece int, pieces int, type string, id long, refers long, "
           "said string, http_length long, payload_bytes long, digest string")


def reachable(successor: np.ndarray, start: int = 0) -> np.ndarray:
    """Which nodes the chain from ``start`` meets: known nodes and jump lengths double each
    round. successor[i] is the next node, or len(successor) for the end or nowhere."""
    n = len(successor)
    jump = np.append(successor, n)
    seen = np.zeros(n + 1, bool)
    if n:
        seen[start] = True
    while True:
        met = seen.copy()
        met[jump[np.flatnonzero(seen)]] = True
        if (met == seen).all():
            return seen[:n]
        seen, jump = met, jump[jump]


def _chain(group: pd.DataFrame) -> pd.DataFrame:
    """Records of one archive that the chain from its start reaches, by piece."""
    g = group.sort_values(["block", "row"], ignore_index=True)
    size = g["size"].to_numpy(np.int64)
    # piece 0 lies before the first magic; piece i starts, with its magic, where the others end
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) + (np.arange(len(g)) - 1) * len(MAGIC)
    g, start = g.iloc[1:], start[1:]
    known = g["block_bytes"].notna().to_numpy()
    follow = start + len(MAGIC) + g["head_bytes"].to_numpy() + g["block_bytes"].fillna(0).to_numpy().astype(np.int64) + 8
    end = int(size.sum()) + len(size[1:]) * len(MAGIC)
    at = np.searchsorted(start, follow)
    exact = known & (at < len(start)) & (start[np.minimum(at, len(start) - 1)] == follow) if len(start) else known
    successor = np.where(exact, at, len(start))
    met = reachable(successor) if len(start) and start[0] == 0 else np.zeros(len(start), bool)
    # a record counts if it ends at its successor or at the end of the file
    met &= exact | (known & (follow == end))
    heads = np.flatnonzero(met)
    last = np.where(exact[heads], successor[heads], len(start))
    n = last - heads
    rows = np.repeat(heads, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    out = g.iloc[rows][["file", "key"]].reset_index(drop=True)
    out.loc[np.repeat(n, n) == 1, "key"] = None
    out["start"] = np.repeat(start[heads], n)
    out["piece"] = rows - np.repeat(heads, n)
    out["pieces"] = np.repeat(n, n)
    for c in CARRIED:
        out[c] = g[c].to_numpy()[np.repeat(heads, n)]
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    narrow = _parsed(_pieces(spark, path)).drop("whole")
    chain = stored(narrow.groupBy("file").applyInPandas(_chain, CHAINED), "warc-chain")
    found = chain.where("pieces = 1").select(*CARRIED)
    parts = chain.where("pieces > 1").select("file", "key", "start", "piece")
    if not parts.isEmpty():
        values = _pieces(spark, path).select(_key().alias("key"), "value") \
            .join(parts.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.any_value("value").alias("value"))
        joined = parts.join(values, "key", "left") \
            .groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("piece", "value"))).alias("p"))
        whole = joined.select("file", F.col("start").alias("block"), F.lit(0).cast("long").alias("row"),
                              F.array_join("p.value", MAGIC).alias("value"))
        lost = F.raise_error(F.concat(F.lit("pieces of a record are missing in "), F.col("file"))).cast("boolean")
        found = found.unionByName(_parsed(whole).where(F.when(F.col("whole"), True).otherwise(lost)).select(*CARRIED))
    response = F.col("type") == "response"
    return found.where(F.col("type").isin("response", "revisit")).select(
        F.col("id").alias("page_id"),
        F.when(response, F.col("payload_bytes")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("said")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers").alias("refers_to"),
        F.when(response, F.col("digest") == F.col("said")).otherwise(F.lit(True)).alias("digest_verified"))


def op9_warc(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).drop("digest_verified")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
           FROM pages),
d AS (SELECT *, sha1(body) AS h FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}',
           (1 + ((('0x' || substr(h, (1 + 10 * (i // 8))::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31))::INTEGER,
           1)), '') AS payload_digest,
       CASE WHEN first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM d
"""
