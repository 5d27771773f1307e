"""N-gram Jaccard join (11): size-banded tiles of hashed bitmaps, exact intersections.

A document's set holds its distinct runs of four words. Two documents link when 100 times the
size of the intersection is at least 85 times that of the union. The join is exact:

* Documents with equal sets are one node (a digest of the sorted set); its first row stands for it.
* Shingles are ordered by how often documents hold them, counted in 2**18 hashed counters. Two
  sets that link share a shingle among the first n - ceil(0.85 n) + 1 of each, whatever the
  order is; rare ones first keep such groups small. A group of one node has no partner.
* Two sets need only meet in the group of their first common shingle, before which nothing is
  shared: the places of the shingle in both bound their overlap there.
* Each group compares its members with its LEADERS most popular members: linear in the group.
  Sizes and places must fit, then hashed bitmaps: a bit that only one of the two has set stands
  for an element the other lacks, so bit counts bound the overlap from above. What passes is
  settled by intersecting the sorted arrays. Links give components.
* Groups whose other members then lie in different components are cut into tiles: members of one
  size band (sizes within a factor of 0.85) meet those of their own and the next smaller band in
  blocks of about TILE. A block of members outside the group's largest component meets all blocks,
  members of one component are not compared, and groups with the same members are compared once.
  A task holds the bitmaps of two blocks; pairs that the bound cannot exclude go to the exact
  intersection.

No link between different sets is lost: every pair that shares a group is settled, or lies in one
component already. Only pairs that pass the bound leave a tile.

Shingles are compared by 64-bit hashes under a random key of the job, so no text can be made to
collide; results don't depend on the key.

Defined results: null and wordless texts have an empty set, link with nothing and are components
of their own. A text of fewer than four words is one shingle. The component id is the smallest
doc_id (null only if all are null). Repeated rows have a result each. An empty table gives no
rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarmac.llm import textnum as tn
from tarmac.llm.common import join_by_key, stored, text_of
from tarmac.llm.components import components

SHINGLE = 4
PERCENT = 85
COUNTERS = 1 << 18
TILE = 256
NARROW, WIDE = 64, 4096
BITS = 1 << 22
LEADERS = 8


def _sets(column: pa.Array, size: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the distinct shingles, sorted by text and hash."""
    words = tn.Words(*tn.column_bytes(column), tn.NOT_SPACE)
    h, text = tn.shingles(words, words.keyed(True, key), size)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[new], h[new]


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> tn.U(64 - int(math.log2(COUNTERS)))).astype(np.int64)


def _frequencies(docs: DataFrame, size: int, key: int) -> tuple[np.ndarray, int]:
    """Documents per counter and in all: summed per task, then over tasks; COUNTERS + 1 numbers come back."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(COUNTERS + 1, np.int64)
        for batch in batches:
            times[COUNTERS] += batch.num_rows
            for part in tn.slices(batch, "t", most=1 << 20):
                times[:COUNTERS] += np.bincount(_counter(_sets(part.column("t"), size, key)[1]), minlength=COUNTERS)
        i = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(times[i])], ["i", "n"])

    found = docs.select(text_of().alias("t")).mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS + 1, np.int64)
    out[found["i"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out[:COUNTERS], int(out[COUNTERS])


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """Of a set of n the number of first elements of which linked sets share one."""
    return n - -(-n * percent // 100) + 1


def bitmaps(text: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bitmaps as bytes, and their widths in bits: at least twice the set, a power of two."""
    width = np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 2))).astype(np.int64), NARROW, WIDE)
    base = np.cumsum(width) - width
    bits = np.zeros(int(width.sum()), bool)
    bits[base[text] + (h & (width[text] - 1).astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little"), width


def describe(docs: DataFrame, percent: int, size: int, key: int, frequency: np.ndarray, docs_in: int) -> DataFrame:
    """doc_id, tkey (text digest), skey (set digest, null for an empty set), n, prefix and bits of every row.
    A prefix token is hot if more than 1 % of the documents may hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "t", most=1 << 20):
                rows = part.num_rows
                text, h = _sets(part.column("t"), size, key)
                first = np.searchsorted(text, np.arange(rows + 1))
                n = np.diff(first)
                packed, width = bitmaps(text, h, n)
                cut = np.concatenate([[0], np.cumsum(width // 8)])
                raw, data = h.tobytes(), packed.tobytes()
                keys = [hashlib.blake2b(raw[8 * i:8 * j], digest_size=16).digest() if j > i else None
                        for i, j in zip(first[:-1], first[1:], strict=True)]
                order = np.lexsort((h, shared.value[_counter(h)], text))
                take = np.where(n > 0, prefix_sizes(n, percent), 0)
                rank = np.arange(len(h)) - np.repeat(first[:-1], n)
                prefix = h[order][rank < np.repeat(take, n)]
                tokens = pa.StructArray.from_arrays(
                    [pa.array(prefix.view(np.int64)), pa.array(shared.value[_counter(prefix)] * 100 > docs_in),
                     pa.array(rank[rank < np.repeat(take, n)].astype(np.int32))], ["token", "hot", "pos"])
                ends = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tkey"), pa.array(keys, pa.binary()), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), tokens),
                     pa.array([data[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                    ["doc_id", "tkey", "skey", "n", "prefix", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")) \
        .select("doc_id", F.unhex(F.md5(F.col("t").cast("binary"))).alias("tkey"), "t")
    return rows.mapInArrow(work, "doc_id long, tkey binary, skey binary, n long, "
                           "prefix array<struct<token:long,hot:boolean,pos:int>>, bits binary")


def _folded(rows: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of one or several widths folded to ``width`` bits, as rows of bytes."""
    out = np.zeros((len(rows), width // 8), np.uint8)
    by_width: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_width.setdefault(len(r), []).append(i)
    for wide, which in by_width.items():
        a = np.frombuffer(b"".join(rows[i] for i in which), np.uint8).reshape(len(which), -1, width // 8)
        out[which] = np.bitwise_or.reduce(a, axis=1) if wide > width // 8 else a[:, 0]
    return out


def _may_link(na, nb, pa_, pb, common, percent: int) -> np.ndarray:
    """Whether sets of na and nb elements with pa_ and pb bits, ``common`` of them shared, can link."""
    overlap = np.minimum(na - (pa_ - common), nb - (pb - common))
    return 100 * overlap >= percent * (na + nb - overlap)


def _pass_bound(percent: int):
    """Of rows (a, b, na, nb, bits_a, bits_b) the pairs (a, b) that the bound cannot exclude."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("bits_a", "bits_b"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            width = np.minimum([len(x) for x in a], [len(x) for x in b]) if a else np.zeros(0, int)
            keep = np.zeros(len(a), bool)
            for w in np.unique(width):
                i = np.flatnonzero(width == w)
                x, y = _folded([a[k] for k in i], int(w) * 8), _folded([b[k] for k in i], int(w) * 8)
                bits = [np.bitwise_count(z).sum(1, dtype=np.int64) for z in (x, y, x & y)]
                keep[i] = _may_link(na[i], nb[i], *bits, percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])
    return check


def _pass_tile(percent: int):
    """Pairs of one tile, of different components, that the bounds cannot exclude."""
    def compare(tile: pa.Table) -> pa.Table:
        node, n, pos, root, side = (tile.column(c).to_numpy() for c in ("node", "n", "pos", "root", "side"))
        bits = tile.column("bits").to_pylist()
        width = 8 * min(map(len, bits))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        flat = np.unpackbits(_folded(bits, width), axis=1).astype(np.float32)
        have = flat.sum(1).astype(np.int64)
        common = (flat[x] @ flat[y].T).astype(np.int64)
        ok = _may_link(n[x][:, None], n[y][None, :], have[x][:, None], have[y][None, :], common, percent)
        ok &= root[x][:, None] != root[y][None, :]
        left = np.minimum((n - pos)[x][:, None], (n - pos)[y][None, :])
        ok &= (100 + percent) * left >= percent * (n[x][:, None] + n[y][None, :])
        i, j = np.nonzero(ok)
        a, b = node[x[i]], node[y[j]]
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})
    return compare


def _sorted_arrays(size: int, key: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "t"):
                text, h = _sets(part.column("t"), size, key)
                first, raw = np.searchsorted(text, np.arange(part.num_rows + 1)) * 8, h.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([raw[i:j] for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())],
                    ["node", "items"])
    return work


def _intersect(percent: int):
    """Of rows (a, b, xa, xb) with sorted arrays the pairs that link."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for xa, xb in zip(batch.column("xa"), batch.column("xb"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (xa, xb))
                common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])
    return check


def _both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with columns of ``table`` (by node) for either side, named ca and cb."""
    for s in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]), s)
    return pairs


def _tiles(member: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of members (token, node, n, pos, bits, root) of unresolved groups."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))).cast("int")
    member = member.withColumn("band", F.explode(F.array(band, band + 1)))
    size = member.groupBy("token", "band", "root").agg(
        F.count(F.lit(1)).alias("c"), F.min("pos").alias("pos"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"))
    size = size.groupBy("token", "band").agg(
        F.sum("c").alias("total"), F.max(F.struct("c", "root")).alias("major"), F.count(F.lit(1)).alias("roots"),
        F.min("pos").alias("first"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("roots > 1")
    # of groups with the same members the one whose token comes first in all of them
    size = size.groupBy("band", "total", "x", "y").agg(F.min(F.struct("first", "token", "major")).alias("g")) \
        .select("band", "total", "g.token", "g.major")
    d = member.join(size, ["token", "band"])
    small, large = F.ceil((F.col("total") - F.col("major.c")) / F.lit(TILE)), F.ceil(F.col("total") / F.lit(TILE))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    own = d.where(F.col("root") != F.col("major.root")) \
        .withColumn("i", F.pmod(F.xxhash64("node"), small.cast("long"))).withColumn("j", upto(large)).withColumn("side", F.lit(0))
    rest = d.withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), large.cast("long"))).withColumn("i", upto(small)) \
        .withColumn("side", F.lit(1))
    cols = ["token", "band", "i", "j", "side", "node", "n", "pos", "root", "bits"]
    return own.select(cols).unionAll(rest.select(cols)).groupBy("token", "band", "i", "j") \
        .applyInArrow(_pass_tile(percent), "a long, b long").distinct()


def _groups(known: DataFrame, named: DataFrame, docs_in: int, percent: int) -> DataFrame:
    """(token, node, n, pos, m) of the representatives' prefix tokens that m > 1 rows hold; ``pos`` is the
    token's place in the set of ``n``."""
    # copies of a very common text count once; fewer than 1000 sets can be that common
    heavy = F.broadcast(named.where(F.col("copies") * 1000 > docs_in).select("skey", F.col("node").alias("kept")))
    rows = known.where("skey IS NOT NULL").join(heavy, "skey", "left").where("kept IS NULL OR kept = row")
    token = rows.select(F.col("row").alias("node"), F.col("n").cast("int").alias("n"), F.explode("prefix").alias("p")) \
        .select("node", "n", "p.token", "p.hot", "p.pos")
    cols = ["token", "node", "n", "pos"]
    # a token in at most 1 % of the documents is counted beside its rows, a commoner one before they move
    per = W.partitionBy("token")
    light = token.where("NOT hot").select(*cols, F.count(F.lit(1)).over(per).alias("m"), F.min("n").over(per).alias("low")).where("m > 1")
    hot = token.where("hot").select(*cols)
    hot = hot.join(hot.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("low")).where("m > 1"), "token")
    # a place too far behind for any partner, the group's smallest set included; equal sets need no comparison
    return light.unionByName(hot).where(f"{100 + percent} * (n - pos) >= {percent} * (n + low)").drop("low").join(named.select("node"), "node", "left_semi")


def _of_some(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, t) of the documents named in ``wanted`` (node, id, tkey), one row each.

    Texts that a bitmap of the wanted digests (BITS of them, however many are wanted) rules out
    are not shuffled.
    """
    def bit(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BITS))
    rows = wanted.select(bit("tkey").alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)  # at most BITS numbers
    flags = np.zeros(BITS, bool)
    flags[rows] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column("b").to_numpy()
            yield batch.filter(pa.array((shared.value[b >> 3] >> (7 - (b & 7)) & 1).astype(bool))).drop_columns(["b"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), text_of().alias("t")) \
        .withColumn("tkey", F.unhex(F.md5(F.col("t").cast("binary")))).withColumn("b", bit("tkey"))
    rows = rows.mapInArrow(some, "id long, t string, tkey binary")
    return rows.join(wanted, ["id", "tkey"]).dropDuplicates(["node"]).select("node", "t")


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    key = secrets.randbits(64)
    frequency, docs_in = _frequencies(docs, size, key)
    known = describe(docs, percent, size, key, frequency, docs_in)
    known = stored(known.select(F.monotonically_increasing_id().alias("row"), "*"), "join-sets")
    named = known.where("skey IS NOT NULL").groupBy("skey").agg(
        F.min(F.struct("row", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "tkey")).alias("rep"),
        F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    named = stored(named.select("skey", F.col("rep.row").alias("node"), F.col("rep.id").alias("id"), F.col("rep.tkey").alias("tkey"),
                                "low", "copies"), "join-nodes")

    member = stored(_groups(known, named, docs_in, percent), "join-groups")
    popular = member.groupBy("node").agg(F.sum("m").alias("pop"))
    order = W.partitionBy("token").orderBy(F.desc("pop"), "node")
    led = stored(member.join(popular, "node").withColumn("k", F.row_number().over(order)).where(F.col("k") <= LEADERS)
                 .select("token", F.col("node").alias("leader"), F.col("n").alias("ln"), F.col("pos").alias("lpos")), "join-leaders")
    bitmap = known.select(F.col("row").alias("node"), "n", "bits")

    def settled(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "join-candidates")
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = stored(named.join(ends, "node").select("node", "id", "tkey"), "join-wanted")
        arrays = stored(_of_some(docs, wanted).mapInArrow(_sorted_arrays(size, key), "node long, items binary"), "join-arrays")
        full = _both(pairs, arrays, "items").select("a", "b", F.col("items_a").alias("xa"), F.col("items_b").alias("xb"))
        return stored(full.mapInArrow(_intersect(percent), "a long, b long"), "join-links")

    star = member.join(led, "token").where("node <> leader").where(f"100 * least(n, ln) >= {percent} * greatest(n, ln)") \
        .where(f"{100 + percent} * least(n - pos, ln - lpos) >= {percent} * (n + ln)") \
        .select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
    star = _both(star, bitmap, "n", "bits") \
        .select("a", "b", F.col("n_a").alias("na"), F.col("n_b").alias("nb"), "bits_a", "bits_b")
    links = settled(star.mapInArrow(_pass_bound(percent), "a long, b long"))
    root = components(links)

    # pairs of two members that are both no leaders
    rest = member.where(F.col("m") > LEADERS + 1).drop("m") \
        .join(led.select("token", F.col("leader").alias("node")), ["token", "node"], "left_anti")
    rooted = rest.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    rest = rooted.join(split.select("token"), "token", "left_semi").join(bitmap.select("node", "bits"), "node")
    more = settled(_tiles(rest, percent))
    if not more.isEmpty():
        root = components(links.unionAll(more))

    named = named.select("node", "skey", "low", "copies").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(named.join(least, "root").select("skey", "copies", "component_id"), "join-components")
    out = join_by_key(known.where("skey IS NOT NULL").select("doc_id", F.col("n").alias("n_shingles"), "skey"), named, "skey", "copies")
    alone = known.where("skey IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def op11_jaccard_join(docs: DataFrame) -> DataFrame:
    return jaccard_classes(docs)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
p AS (SELECT r, len(s) AS n, unnest(s) AS g FROM s),
x AS (SELECT a.r AS a, b.r AS b FROM p a JOIN p b ON a.g = b.g AND a.r <> b.r AND 100 * b.n >= 85 * a.n AND 100 * a.n >= 85 * b.n
      GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, x.b FROM c JOIN x ON c.b = x.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(t.doc_id)::BIGINT AS component_id
FROM s JOIN c ON c.a = s.r JOIN d t ON t.r = c.b GROUP BY s.r, s.doc_id, len(s.s)
"""
