"""Ranked lexical search (12): the Best Position Algorithm over impact lists, shard by shard.

A term's impact in a document is its share of the score, an integer. Spark counts the terms of
whole documents, keeps those that any item uses, derives document frequencies, weights and
impacts, and deals documents into shards of about SHARD. A task holds one shard: an impact list
per term, highest first, and each document's entries for direct access. For each item it reads
the item's lists in parallel. A document met for the first time is looked up in all lists, which
marks its positions there as seen. A list's best position is the last one before which every
position has been seen, whoever met it; it is never behind the last position read. The sum of the
impacts at the best positions bounds every document not met yet, and reading stops once that
bound is strictly below the k-th score, so equal scores are never missed. The k best of each
shard are ranked once more over all shards.

The items are a stated query set, dealt in blocks of about BLOCK rows; every shard meets every
block. Terms are compared as text. Before terms leave a document's task they pass a bitmap of
CRC-32 values of the items' terms, of 2**20 bits at most; what passes wrongly falls out of the
join on the term itself.

Defined results: null and empty texts hold no terms; items without terms or matches have no
rows. Each row of either table counts by itself, also when ids repeat or are null (a null doc_id
ranks last among equal scores, its rows in their stored order). Empty tables give no rows. Other
columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarmac.llm import textnum as tn
from tarmac.llm.common import stored, text_of

TOP = 50
SHARD = 8192
BLOCK = 1024
BITS = 1 << 20


def _counted(wanted: np.ndarray | None):
    """Rows (id, t) to (id, n, terms, tfs): the number of terms and each different one's count."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "t", most=1 << 21):
                data, offsets = tn.column_bytes(part.column("t"))
                words = tn.Words(tn.FOLD[data], offsets, tn.ALNUM)
                n = np.diff(words.first)
                coded = words.strings().dictionary_encode()
                values = coded.dictionary
                keys, tf = np.unique(words.text.astype(np.int64) * max(len(values), 1) + coded.indices.to_numpy(),
                                     return_counts=True)
                text, term = np.divmod(keys, max(len(values), 1))
                if wanted is not None:
                    bit = np.fromiter((zlib.crc32(v) % BITS for v in values.to_pylist()), np.int64, len(values))
                    ok = wanted[bit][term]
                    text, term, tf = text[ok], term[ok], tf[ok]
                lists = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
                out = pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(lists, values.take(pa.array(term)).cast(pa.large_string()).cast(pa.string())),
                     pa.ListArray.from_arrays(lists, pa.array(tf.astype(np.int64)))], ["id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))
    return count


def _terms(df: DataFrame, id_: str, name: str, wanted: np.ndarray | None = None) -> DataFrame:
    """row (a number of its own), id, n, terms and tfs of every row with a term; a stored table."""
    kind = df.schema[id_].dataType.simpleString()
    rows = df.select(F.col(id_).alias("id"), text_of().alias("t"))
    counted = rows.mapInArrow(_counted(wanted), f"id {kind}, n long, terms array<string>, tfs array<long>")
    return stored(counted.select(F.monotonically_increasing_id().alias("row"), "*"), name)


class Shard:
    """Impact lists of a shard's documents and, by document, the places of its entries in them."""

    def __init__(self, postings: pa.Table):
        row, tid, impact = (postings.column(c).to_numpy() for c in ("row", "tid", "impact"))
        self.row, first, doc = np.unique(row, return_index=True, return_inverse=True)
        ids = postings.column("doc_id").combine_chunks()
        self.missing = pc.is_null(ids).to_numpy(zero_copy_only=False)[first]
        self.ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[first]
        self.tids, term = np.unique(tid, return_inverse=True)
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.term = doc[order], impact[order], term[order]
        self.first = np.searchsorted(self.term, np.arange(len(self.tids) + 1))
        self.place = np.argsort(self.doc, kind="stable")
        self.held = np.searchsorted(self.doc[self.place], np.arange(len(self.row) + 1))
        self.reads = 0

    def _entries(self, docs: np.ndarray) -> np.ndarray:
        """Places of all entries of some documents."""
        n = self.held[docs + 1] - self.held[docs]
        return self.place[np.repeat(self.held[docs] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def search(self, tids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best documents for the terms ``tids``."""
        at = np.searchsorted(self.tids, tids)
        at = np.unique(at[self.tids[np.minimum(at, len(self.tids) - 1)] == tids]) if len(self.tids) else at[:0]
        mine = np.zeros(len(self.tids), bool)
        mine[at] = True
        read, end = self.first[at].copy(), self.first[at + 1]
        best = read.copy()  # the first place not seen yet, behind the best position
        seen, met = np.zeros(len(self.doc), bool), np.zeros(len(self.row), bool)
        found, scores, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 8
        while (read < end).any():
            stop = np.minimum(read + step, end)
            docs = np.unique(np.concatenate([self.doc[i:j] for i, j in zip(read, stop, strict=True)]))
            self.reads += int((stop - read).sum())
            docs = docs[~met[docs]]
            met[docs] = True
            places = self._entries(docs)
            places = places[mine[self.term[places]]]
            seen[places] = True
            which = np.searchsorted(docs, self.doc[places])
            found.append(docs)  # sums stay below 2**53, so doubles add them exactly
            scores.append(np.bincount(which, weights=self.impact[places], minlength=len(docs)).astype(np.int64))
            bound = 0
            for i in range(len(at)):
                rest = seen[best[i]:end[i]]
                gap = int(rest.argmin()) if len(rest) else 0
                best[i] = end[i] if not len(rest) or rest[gap] else best[i] + gap
                bound += int(self.impact[best[i] - 1]) if best[i] < end[i] else 0
            read, step = stop, step * 2
            now = np.concatenate(scores)
            if len(now) >= k and np.partition(now, len(now) - k)[len(now) - k] > bound:
                break
        found, scores = np.concatenate(found), np.concatenate(scores)
        some = scores > 0
        found, scores = found[some], scores[some]
        top = np.lexsort((self.row[found], self.ids[found], self.missing[found], -scores))[:k]
        return found[top], scores[top]


def _search_shard(k: int):
    def search(postings: pa.Table, items: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("item", "row", "doc_id", "score")}
        if postings.num_rows and items.num_rows:
            shard = Shard(postings)
            for item, tids in zip(items.column("item").to_pylist(), items.column("tids").to_pylist(), strict=True):
                docs, scores = shard.search(np.array(tids, np.int64), k)
                out["item"] += [item] * len(docs)
                out["row"] += shard.row[docs].tolist()
                out["doc_id"] += [None if m else i for i, m in zip(shard.ids[docs].tolist(), shard.missing[docs], strict=True)]
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})
    return search


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each row of ``items``."""
    asked = _terms(items, "item_id", "search-items")
    words = asked.select(F.explode("terms").alias("term")).distinct()
    wanted = np.zeros(BITS, bool)
    # at most BITS numbers
    wanted[words.select((F.crc32(F.col("term").cast("binary")) % BITS).alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)] = True
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = _terms(docs, "doc_id", "search-documents", wanted)

    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    entry = held.select("row", F.col("id").alias("doc_id"), "n", F.explode(F.arrays_zip("terms", "tfs")).alias("e")) \
        .select("row", "doc_id", "n", F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))
    df = entry.select("term").join(words, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0))))
    weights = stored(df.select("term", F.monotonically_increasing_id().alias("tid"), weight.cast("long").alias("w")),
                     "search-weights")

    shards = max(1, -(-n_docs // shard))
    blocks = max(1, -(-asked.count() // block))
    impact = F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 20L * (50L + (50L * n * {n_docs}L) div {max(n_terms, 1)}L)))")
    postings = entry.join(weights, "term").select("row", "doc_id", "tid", impact.alias("impact")).where("impact > 0") \
        .withColumn("shard", F.pmod("row", F.lit(shards)))
    if blocks > 1:
        postings = postings.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    else:
        postings = postings.withColumn("block", F.lit(0))
    queries = asked.select(F.col("row").alias("item"), F.explode("terms").alias("term")).join(weights, "term") \
        .groupBy("item").agg(F.collect_list("tid").alias("tids"))  # at most an item's own terms
    queries = queries.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    best = postings.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")) \
        .applyInArrow(_search_shard(k), "item long, row long, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select(F.col("row").alias("item"), F.col("id").alias("item_id")), "item") \
        .select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return lexical_search(docs, benchmark)


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM p, g GROUP BY term, nn),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, p.doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll)))))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN p USING (term) JOIN n ON n.doc_id = p.doc_id, g GROUP BY item_id, p.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
