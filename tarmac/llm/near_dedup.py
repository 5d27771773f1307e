"""MinHash near-dedup (1): DartMinHash signatures, banded candidates, exact verification.

Signatures. A text is its five-word shingles, weighted by how often each occurs (or, with
``weighted=False``, each once). Each shingle owns a strip as wide as its weight; darts hit it at the times of a Poisson process
drawn from the shingle's hash, so texts that share a shingle share its darts. Only darts
before a horizon that falls with the text's total weight are thrown: about k ln k + 2k of
them, whatever the text's length. A dart's hash names one of k coordinates; the earliest dart
of a coordinate is its signature entry. Two texts agree in a coordinate with a probability
equal to their (weighted) Jaccard similarity. Texts with an empty coordinate get a horizon
twice as far.

Classes. Equal texts are one node. Nodes that agree in all ROWS entries of a band share a
bucket. Each bucket names its most popular member as leader, the one whose own buckets are
the fullest (the original that copies scatter around), and every member is compared with its
leaders: linear in the bucket. Buckets whose members then still lie in different components
are compared in full, in tiles of about TILE x TILE members, across components only, and only
links come out. So no link between candidates is lost, no bucket is gathered in one task, and
no pair is emitted that isn't a link. Similarity is the exact weighted Jaccard: the sum of the
smaller counts over the sum of the larger ones. It is the plain Jaccard of the elements
(shingle, its how-manieth occurrence), which is how it is verified. Without weights it is the
plain Jaccard of the shingle sets; texts that repeat no shingle have the same one both ways.
With 28 bands of 5, a pair of similarity 0.8 is a candidate with probability 1 - 2e-5.

Defined results: a null text is the empty text; texts without words are in a class of their
own each. Equal texts share a class. The class id is the smallest doc_id of the class (null
only if all are null); rows that repeat a doc_id and text share one result. A text of fewer
than five words is one shingle. A-Z count as a-z. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm import textnum as tn
from tarmac.llm.common import join_by_key, stored, text_of
from tarmac.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 28
ROWS = 5
TILE = 256


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64 hash bits."""
    return ((h >> tn.U(11)).astype(np.float64) + 1.0) / 2.0**53


def dart_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, k: int,
                 seed: int = 0) -> np.ndarray:
    """Signatures (n_texts x k) of weighted sets; row i uses the elements with text == i,
    which must be distinct. Texts without weight get zeros."""
    total = np.bincount(text, weights=weight, minlength=n_texts)
    sign = np.zeros((n_texts, k), np.uint64)
    reach = (k * np.log(k) + 2 * k) / np.where(total > 0, total, 1)
    todo = total > 0
    while todo.any():
        mine = todo[text]
        t, w = text[mine], weight[mine]
        layers = np.ceil(w).astype(np.int64)
        layer = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
        key = tn.mix(np.repeat(element[mine], layers) + layer.astype(np.uint64) * tn.BASE, seed + 20)
        t, wide = np.repeat(t, layers), np.minimum(np.repeat(w, layers) - layer, 1.0)
        when = np.zeros(len(t))
        slots, times, darts = [], [], []
        while len(t):
            key = tn.mix(key, 21)
            when = when - np.log(_unit(key))
            live = np.flatnonzero(when <= reach[t])
            t, key, when, wide = t[live], key[live], when[live], wide[live]
            dart = tn.mix(key, 22)
            hit = (wide >= 1.0) | (_unit(tn.mix(dart, 23)) <= wide) if (wide < 1.0).any() else slice(None)
            slots.append(t[hit] * k + ((dart[hit] >> tn.U(20)) % tn.U(k)).astype(np.int64))
            times.append(when[hit])
            darts.append(dart[hit])
        slot, dart = np.concatenate(slots), np.concatenate(darts)
        late_first = np.argsort(-np.concatenate(times), kind="stable")
        best = np.zeros(n_texts * k, np.uint64)
        full = np.zeros(n_texts * k, bool)
        best[slot[late_first]] = dart[late_first]  # of equal slots the last, the earliest dart, stays
        full[slot] = True
        done = todo & full.reshape(n_texts, k).all(1)
        sign[done] = best.reshape(n_texts, k)[done]
        todo &= ~done
        reach = np.where(todo, reach * 2, reach)
    return sign


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of the distinct shingles of each text."""
    words = tn.Words(*tn.column_bytes(column), tn.NOT_SPACE)
    h, text = tn.shingles(words, words.hashes(True), size)
    if not len(h):
        return text, h, np.zeros(0)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])]))
    return text[first], h[first], np.diff(np.append(first, len(h))).astype(np.float64)


def elements(column: pa.Array, size: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of what verification counts: distinct shingles, weighted once for each occurrence."""
    text, h, count = shingle_sets(column, size)
    again = count.astype(np.int64) if weighted else np.ones(len(h), np.int64)
    nth = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
    text, h = np.repeat(text, again), np.repeat(h, again)
    late = np.flatnonzero(nth)
    h[late] = tn.mix(h[late] + nth[late].astype(np.uint64) * tn.BASE, 12)
    return text, h


def band_hashes(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sign), bands), np.uint64)
    for r in range(rows):
        out = tn.mix(out ^ sign.reshape(len(sign), bands, rows)[:, :, r], 30 + r)
    return tn.mix(out + np.arange(bands, dtype=np.uint64) * tn.BASE, 40).view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE,
               weighted: bool = True) -> DataFrame:
    """doc_id, node (128-bit text hash) and the band hashes (none for a text without words)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "t"):
                text, h, count = shingle_sets(part.column("t"), shingle)
                n = part.num_rows
                got = np.zeros(n, bool)
                got[text] = True
                hashes = band_hashes(dart_minhash(text, h, count if weighted else np.ones(len(h)), n, bands * rows),
                                     bands, rows)
                offsets = np.concatenate([[0], np.cumsum(got * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("node"),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[got].ravel()))],
                    ["doc_id", "node", "bands"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")) \
        .select("doc_id", F.unhex(F.md5(F.col("t").cast("binary"))).alias("node"), "t")
    return rows_.mapInArrow(sign, "doc_id long, node binary, bands array<long>")


def _similar(threshold: float, shingle: int, weighted: bool):
    """Of rows (a, b, ta, tb) the pairs (a, b) whose texts are similar enough."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "ta", "tb"):
                sides = []
                for c in ("ta", "tb"):
                    pair, h = elements(part.column(c), shingle, weighted)
                    sides.append((pair, tn.mix(h ^ tn.mix(pair.astype(np.uint64), 9), 10)))
                (pa_, ka), (pb, kb) = sides
                n = part.num_rows
                common = np.bincount(pa_[np.isin(ka, kb)], minlength=n)
                union = np.bincount(pa_, minlength=n) + np.bincount(pb, minlength=n) - common
                keep = pa.array(common >= threshold * union)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])
    return check


def _tile_links(threshold: float, shingle: int, weighted: bool):
    """Links of one tile: pairs of different roots, one from each block, that are similar."""
    def compare(tile: pa.Table) -> pa.Table:
        nodes, roots = tile.column("node").to_pylist(), tile.column("root").to_pylist()
        block = tile.column("block").to_numpy()
        text, h = elements(tile.column("t"), shingle, weighted)
        n = len(nodes)
        size = np.bincount(text, minlength=n)
        _, which, times = np.unique(h, return_inverse=True, return_counts=True)
        shared = times[which] > 1
        rank = np.cumsum(times > 1) - 1
        text, which = text[shared], rank[which[shared]]
        order = np.argsort(which, kind="stable")
        text, which = text[order], which[order]
        common, columns = np.zeros((n, n), np.float32), 8192
        for lo in range(0, int(which[-1]) + 1 if len(which) else 0, columns):
            i, j = np.searchsorted(which, [lo, lo + columns])
            held = np.zeros((n, columns), np.float32)
            held[text[i:j], which[i:j] - lo] = 1
            common += held @ held.T
        _, root = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)
        ok = common >= threshold * (size[:, None] + size[None, :] - common)
        ok &= (root[:, None] != root[None, :]) & (np.arange(n)[:, None] < np.arange(n)[None, :])
        if len(np.unique(block)) > 1:
            ok &= block[:, None] != block[None, :]
        x, y = np.nonzero(ok)
        return pa.table({"a": pa.array([nodes[i] for i in x], pa.binary()), "b": pa.array([nodes[i] for i in y], pa.binary())})
    return compare


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                 shingle: int = SHINGLE, weighted: bool = True) -> DataFrame:
    """doc_id, class_id and class_size (rows) of every row of ``docs``."""
    return _classed_rows(docs, similarity, bands, rows, shingle, weighted).drop("node")


def _classed_rows(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                  shingle: int = SHINGLE, weighted: bool = True) -> DataFrame:
    """doc_id, node (text digest), class_id and class_size of every row of ``docs``."""
    sign = stored(signatures(docs, bands, rows, shingle, weighted), "dart-signatures")
    worded = sign.where(F.size("bands") > 0)
    nodes = worded.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                       F.any_value("bands").alias("bands"))
    member = nodes.select("node", F.explode("bands").alias("band"))
    full = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = stored(member.join(full, "band"), "dart-buckets")

    # texts of all nodes that share a bucket, one row each
    rep = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    ids = worded.join(member.select("node").distinct(), "node", "left_semi").groupBy("node") \
        .agg(F.min("doc_id").alias("rep")).select("node", F.coalesce("rep", F.lit(2**63 - 1)).alias("rep"))
    bodies = docs.select(rep.alias("rep"), text_of().alias("t"))
    texts = bodies.join(ids, "rep").where(F.col("node") == F.unhex(F.md5(F.col("t").cast("binary")))) \
        .dropDuplicates(["rep", "node"]).select("node", "t")
    texts = stored(texts, "dart-texts")

    popular = member.join(member.groupBy("node").agg(F.sum("n").alias("pop")), "node")
    leader = popular.groupBy("band").agg(F.max(F.struct("pop", "node")).alias("lead")).select("band", "lead.node") \
        .withColumnRenamed("node", "leader")
    star = popular.join(leader, "band").where("node <> leader") \
        .select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
    pairs = star.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a") \
        .join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")
    links = stored(pairs.mapInArrow(_similar(similarity, shingle, weighted), "a binary, b binary"), "dart-links")
    root = components(links)

    # buckets that still hold several components, compared in full but for pairs inside one
    rooted = member.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    rest = rooted.join(split.select("band"), "band", "left_semi")
    blocks = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select("band", "node", "root", "block", F.least("block", "other").alias("i"),
                       F.greatest("block", "other").alias("j")).join(texts, "node")
    more = rest.groupBy("band", "i", "j").applyInArrow(_tile_links(similarity, shingle, weighted), "a binary, b binary")
    more = stored(more.distinct(), "dart-links")
    if not more.isEmpty():
        root = components(links.unionAll(more))

    named = nodes.select("node", "rep", "copies").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    named = stored(named.select("node", "root", "copies").join(classes, "root").drop("root"), "dart-classes")
    out = join_by_key(worded.select("doc_id", "node"), named, "node", "copies").select("doc_id", "node", "class_id", "class_size")
    alone = sign.where(F.size("bands") == 0)
    return out.unionByName(alone.select("doc_id", "node", F.col("doc_id").alias("class_id"),
                                        F.lit(1).cast("long").alias("class_size")))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows whose doc_id names the class of their text, with all their columns. Rows are told
    apart by doc_id and text, so another text under a kept doc_id, or under none, is judged by itself."""
    kept = _classed_rows(docs, **options).where("doc_id <=> class_id") \
        .select(F.col("doc_id").alias("_nd_id"), F.col("node").alias("_nd_node")).distinct()
    same = F.unhex(F.md5(text_of().cast("binary"))) == F.col("_nd_node")
    out = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_nd_id")) & same, "left_semi")
    return out.select(*[out[c] for c in docs.columns])


def op1_dart_minhash(docs: DataFrame) -> DataFrame:
    return near_classes(docs).withColumn("kept", F.expr("doc_id <=> class_id"))
