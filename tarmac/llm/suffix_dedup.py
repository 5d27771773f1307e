"""Suffix-array dedup (4): removal of every byte that a string of SIZE bytes repeats.

Which strings can be equal is settled by content. Every SIZE-byte window has a minimiser, the
smallest hash of the 24-byte grams in it; equal windows have equal minimisers. Consecutive
windows of one minimiser form a run, about 40 windows in the mean. Only minimisers whose gram
occurs more than once can hide a repeat; all other runs end there.

Of equal runs (128-bit hash of their bytes) every one but the first is covered as a whole.
What is left are minimisers with several different runs, or with one in which their gram
occurs twice. Those runs are the collection whose
suffixes are sorted: one bucket of minimisers per task, by column-wise construction of the
collection's Burrows-Wheeler transform. Round j inserts, for every run at once, the suffix of
length j + 1 before the symbol that the last round put down; the place is found by counting
symbols, and old and new rows are merged in one sequential pass. Before, runs are cut to the
windows whose first and last grams occur again in the bucket. Suffixes whose common prefix
with their neighbour reaches SIZE are equal windows; all but the earliest are covered. One
prefix length matters, so the common prefix is compared once, when the order is complete,
and not kept up each round.

A minimiser with more than HOT different runs (a passage of a third of all documents meets as
many contexts) is dealt out by window. Windows have one length, so their equality is settled
like that of runs: a partial aggregate finds the earliest place per 128-bit hash, and an equi-join
covers the later ones. No task gathers a hot minimiser or window.

Defined results: a null text is empty; texts under SIZE bytes have no windows. Order is by
doc_id (null last), then start; rows that share a doc_id but not the text are not earlier than
one another; rows equal in both are one document. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm import textnum as tn
from tarmac.llm.common import stored, text_of

SIZE = 100
GRAM = 24
MOST_WINDOWS = 128
PER_BUCKET = 2048
HOT = 65_536
BLOCK = 128
LAST = np.iinfo(np.int64).max


def _sliding(best: np.ufunc, h: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    m, done = h, 1
    while done * 2 <= width:
        m, done = best(m[:-done], m[done:]), done * 2
    return best(m[:len(m) - (width - done)], m[width - done:]) if width > done else m


def runs(data: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """First byte, number of windows, text and minimiser of every run of windows, and whether
    the minimiser's gram occurs there twice (only then can a run hold a window twice)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none.view(np.uint64), none.astype(bool)
    h = _gram_hashes(data, gram)
    width = size - gram + 1
    least = _sliding(np.minimum, h, width)
    edge = np.zeros(len(least) + 1, np.int64)
    long = np.diff(offsets) >= size
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - size + 1, -1)
    inside = np.cumsum(edge)[:-1] > 0
    change = np.empty(len(least), bool)
    change[0] = True
    change[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    change[offsets[:-1][long]] = True
    begin = np.flatnonzero(change)
    count = np.diff(np.append(begin, len(least)))
    begin, count = begin[inside[begin]], count[inside[begin]]
    parts = -(-count // MOST_WINDOWS)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(begin, parts) + k * MOST_WINDOWS
    count = np.minimum(np.repeat(count, parts) - k * MOST_WINDOWS, MOST_WINDOWS)
    # a gram is some window's minimiser if it equals the largest minimiser around it
    chosen = np.flatnonzero(_sliding(np.maximum, np.pad(least, width - 1), width) == h)
    twice = (h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) < width + MOST_WINDOWS)
    return first, count, np.searchsorted(offsets, first, "right") - 1, least[first], \
        np.isin(least[first], h[chosen[1:][twice]])


_CODES = tn.mix(np.arange(256, dtype=np.uint64), 7)


def _minimisers(size: int, gram: int, per_text: bool):
    """(v, n): grams of a minimiser in a slice; or (v, doc): each minimiser of a text once."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "t"):
                _, _, text, v, own = runs(*tn.column_bytes(part.column("t")), size, gram)
                v = v.view(np.int64)
                if not per_text:
                    v, n = np.unique(np.concatenate([v, v[own]]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n.astype(np.int64))], ["v", "n"])
                elif len(v):
                    order = np.lexsort((v, text))
                    text, v = text[order], v[order]
                    one = np.concatenate([[True], (text[1:] != text[:-1]) | (v[1:] != v[:-1])])
                    docs = part.column("doc").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(v[one]), pa.array(docs[text[one]])], ["v", "doc"])
    return emit


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts, for the shuffles that whole texts take part in."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [z.compress(t.as_buffer()) if t.is_valid else b"" for t in batch.column("t").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(packed, pa.binary())],
                                         ["id", "th", "z"])


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    for t in column:
        yield z.decompress(t.as_buffer()) if len(t.as_buffer()) else b""


REPEATED = "id long, th long, pos long, windows int, v long, h1 long, h2 long, lead boolean, own boolean, run binary"


def _repeated_runs(size: int, gram: int):
    """The runs of a text whose minimiser is among its ``seen``; lead: first of its kind in the text."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(_unpacked(batch.column("z")), pa.large_binary())
            whole = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), batch.column("seen"), texts],
                                               ["id", "th", "seen", "t"])
            for part in tn.slices(whole, "t"):
                data, offsets = tn.column_bytes(part.column("t").cast(pa.large_string()))
                first, count, text, v, own = runs(data, offsets, size, gram)
                seen = part.column("seen")
                owner = np.repeat(np.arange(part.num_rows), seen.value_lengths().to_numpy())
                known = seen.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                in_text = lambda t, x: tn.mix(x ^ tn.mix(t.astype(np.uint64), 5))
                keep = np.isin(in_text(text, v), in_text(owner, known))
                first, count, text, v, own = first[keep], count[keep], text[keep], v[keep].view(np.int64), own[keep]
                raw = data.tobytes()
                pieces = [raw[a:b] for a, b in zip(first.tolist(), (first + count + size - 1).tolist(), strict=True)]
                digests = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in pieces), "<i8")
                h1, h2 = digests[::2], digests[1::2]
                order = np.lexsort((first, h2, h1, text))
                lead = np.ones(len(first), bool)
                a, b = order[1:], order[:-1]
                lead[a] = (text[a] != text[b]) | (h1[a] != h1[b]) | (h2[a] != h2[b])
                ids, th = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("id", "th"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids, th, first - offsets[:-1][text], count.astype(np.int32), v, h1, h2, lead, own)]
                    + [pa.array(pieces, pa.binary())],
                    ["id", "th", "pos", "windows", "v", "h1", "h2", "lead", "own", "run"])
    return emit


def _places(bwt: np.ndarray, at: np.ndarray, symbol: np.ndarray, n: int) -> np.ndarray:
    """Where the suffixes that extend those at ``at`` by ``symbol`` go: behind the n empty
    ones, all with a smaller first symbol, and those of the same symbol further up. Symbols are
    counted per block of rows, and inside the block of each place."""
    blocks = -(-len(bwt) // BLOCK)
    kinds = int(bwt.max()) + 1
    rows = np.zeros((blocks, BLOCK), np.uint8)
    rows.reshape(-1)[:len(bwt)] = bwt
    index = rows + (np.arange(blocks) * kinds)[:, None]
    counts = np.bincount(index.ravel(), minlength=blocks * kinds).reshape(blocks, kinds)
    above = np.cumsum(counts, axis=0) - counts
    total = counts.sum(axis=0)
    total[0] = 0
    smaller = np.cumsum(total) - total
    block, inside = at // BLOCK, at % BLOCK
    same = (rows[block] == symbol[:, None]) & (np.arange(BLOCK) < inside[:, None])
    return n + smaller[symbol] + above[block, symbol] + same.sum(axis=1)


def sorted_suffixes(data: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """First bytes of all suffixes of at least ``least`` bytes of the strings data[start:end),
    in lexical order (equal ones by string), by column-wise insertion.

    ``bwt`` holds, in suffix order, the symbol before each suffix inserted so far (0: none).
    Bytes are numbered in their order, from 1.
    """
    n, size = len(start), end - start
    used = np.zeros(256, bool)
    used[data] = True
    code = np.cumsum(used).astype(np.uint8)
    bwt = np.where(size > 0, code[data[np.maximum(end - 1, 0)]], 0).astype(np.uint8)
    live, at = np.flatnonzero(size > 0), np.flatnonzero(size > 0)
    done = 0
    while len(live):
        place = _places(bwt, at, bwt[at], n)
        order = np.argsort(place)
        live, place, done = live[order], place[order], done + 1
        ahead = np.where(size[live] > done, code[data[np.maximum(end[live] - 1 - done, 0)]], 0).astype(np.uint8)
        old = np.ones(len(bwt) + len(live), bool)
        old[place] = False
        merged = np.empty(len(old), np.uint8)
        merged[old] = bwt
        merged[place] = ahead
        bwt = merged
        more = ahead > 0
        live, at = live[more], place[more]
    by_symbol = np.argsort(bwt, kind="stable")
    follow = np.empty(len(bwt), np.int64)
    follow[by_symbol] = np.arange(len(bwt)) - np.count_nonzero(bwt == 0) + n
    byte = np.full(len(bwt), -1, np.int64)
    live, at = np.arange(n), np.arange(n)
    for done in range(int(size.max()) + 1 if n else 0):
        if done >= least:
            byte[at] = end[live] - done
        more = size[live] > done
        live, at = live[more], follow[at[more]]
    return byte[byte >= 0]


def _same_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes from a equal those from b."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    left = np.arange(len(a))
    steps = [*range(0, size - 7, 8)] + ([size - 8] if size % 8 else [])
    for k in steps:
        left = left[eight[a[left] + k] == eight[b[left] + k]]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


COVER = "id long, th long, pos long, windows int"


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * tn.powers(tn.BASE, n), out=prefix[1:])
        return tn.mix((prefix[gram:] - prefix[:-gram]) * tn.powers(tn.inverse(tn.BASE), n + 1)[:n - gram + 1])


def _trimmed(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each run the part from its first to its last window whose first and last grams some
    other window of the bucket has too; other windows are equal to none."""
    count = end - start - size + 1
    run = np.repeat(np.arange(len(start)), count)
    window = start[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    h = _gram_hashes(data, gram)
    _, kind, times = np.unique(h[window] ^ tn.mix(h[window + size - gram], 2), return_inverse=True, return_counts=True)
    kept = np.flatnonzero(times[kind] > 1)
    run, window = run[kept], window[kept]
    head = np.flatnonzero(np.diff(run, prepend=-1))
    last = np.append(head[1:], len(run))[:len(head)] - 1
    return window[head], window[last] + size


def _cover(size: int, gram: int):
    """Windows of a bucket's runs that an earlier equal window repeats, as runs of windows."""
    def find(bucket: pa.Table) -> pa.Table:
        column = bucket.column("run").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        ids, th, pos = (bucket.column(c).to_numpy() for c in ("id", "th", "pos"))
        window = sorted_suffixes(data, *_trimmed(data, offsets[:-1], offsets[1:], size, gram), size)
        if len(window):
            group = np.cumsum(np.concatenate([[True], ~_same_prefix(data, window[1:], window[:-1], size)]))
            run = np.searchsorted(offsets, window, "right") - 1
            begin = pos[run] + window - offsets[:-1][run]
            order = np.lexsort((begin, th[run], ids[run], group))
            g, run, begin, window = group[order], run[order], begin[order], window[order]
            head = np.concatenate([[True], g[1:] != g[:-1]])
            best = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
            later = (ids[run] > ids[run[best]]) | ((th[run] == th[run[best]]) & (begin > begin[best]))
            window = np.sort(window[later])
        run = np.searchsorted(offsets, window, "right") - 1
        head = np.flatnonzero(np.concatenate([[True], (np.diff(window) != 1) | (np.diff(run) != 0)])) if len(window) else window
        count = np.diff(np.append(head, len(window)))
        run = run[head]
        return pa.table({"id": ids[run], "th": th[run], "pos": pos[run] + window[head] - offsets[:-1][run],
                         "windows": count.astype(np.int32)})
    return find


def _strip(size: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for i, raw in enumerate(_unpacked(batch.column("z"))):
                data = np.frombuffer(raw, np.uint8)
                pairs = batch.column("cover")[i]
                edge = np.zeros(len(data) + 1, np.int64)
                if pairs.is_valid:
                    pos, windows = (pairs.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + windows + size - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                n_bytes.append(len(data))
                n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                kept.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return emit


def covered(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(id, th, pos, windows): runs of windows that an earlier equal string repeats."""
    # rows without an id, or with a repeated one, are told apart by text; texts that share a key by
    # chance share minimisers that occur more than once, and nothing else
    doc = F.xxhash64("id", "th").alias("doc")
    rows = _keyed(docs).select("*", doc)
    count = rows.mapInArrow(_minimisers(size, gram, False), "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    again = count.where("n > 1").select("v")
    seen = rows.mapInArrow(_minimisers(size, gram, True), "v long, doc long").join(again, "v") \
        .groupBy("doc").agg(F.collect_set("v").alias("seen"))
    packed = rows.mapInArrow(_pack, "id long, th long, z binary").select("*", doc)
    found = stored(packed.join(seen, "doc").mapInArrow(_repeated_runs(size, gram), REPEATED), "suffix-runs")

    kinds = found.where("lead").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"),
                                                        F.min("v").alias("v"), F.max("own").alias("own"))
    kinds = stored(kinds, "suffix-kinds")
    place = ["id", "th", "pos", "windows"]
    later = found.where("lead").select("h1", "h2", *place) \
        .join(kinds.where("first < last").select("h1", "h2", "first"), ["h1", "h2"]).where("id > first").select(*place)
    whole = later.unionByName(found.where("NOT lead").select(*place))

    several = kinds.groupBy("v").agg(F.count(F.lit(1)).alias("kinds"), F.max("own").alias("own")).where("kinds > 1 OR own")
    firsts = kinds.drop("own").join(several.drop("own"), "v").select("h1", "h2", F.col("first").alias("id"), "kinds")
    left = stored(found.where("lead").join(firsts, ["h1", "h2", "id"]).select("v", "kinds", "run", *place), "suffix-left")
    cold = left.where(F.col("kinds") <= hot).select("v", "run", *place)
    dealt = left.where(F.col("kinds") > hot).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("windows") - 1))) \
        .select(F.unhex(F.md5(F.expr(f"substring(run, k + 1, {size})"))).alias("h"), "id", "th",
                (F.col("pos") + F.col("k")).alias("pos"), F.lit(1).alias("windows"))
    best = dealt.groupBy("h").agg(F.min(F.struct("id", "th", "pos")).alias("best"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").drop("n")
    single = dealt.join(best, "h").where("id > best.id OR (th = best.th AND pos > best.pos)").select(*place)
    buckets = cold.count() // per_bucket + 1
    bucket = F.pmod(F.xxhash64("v"), F.lit(buckets)).alias("bucket")
    part = cold.groupBy(bucket).applyInArrow(_cover(size, gram), COVER)
    return whole.unionByName(single).unionByName(part)


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("id"),
                       F.xxhash64(text).alias("th"), text.alias("t"))


def suffix_dedup(docs: DataFrame, size: int = SIZE, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    spans = covered(docs, size, **options).groupBy("id", "th") \
        .agg(F.collect_set(F.struct("pos", "windows")).alias("cover"))
    packed = _keyed(docs).mapInArrow(_pack, "id long, th long, z binary")
    out = packed.join(spans, ["id", "th"], "left").mapInArrow(
        _strip(size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != int(LAST), F.col("doc_id")))


def op4_suffix_dedup(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs)


#: Every window as hex digits; its later occurrences; their union per document as islands.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, {2 * SIZE}) AS s
      FROM (SELECT doc_id, h, unnest(range(0, greatest(strlen(h) // 2 - {SIZE - 1}, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{SIZE + 1}) + {SIZE} AS fresh FROM r),
k AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
e AS (SELECT doc_id, island, min(i) AS a, max(i) + {SIZE} AS b FROM k GROUP BY ALL),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM e),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS fin,
             string_agg(substr(h, (2 * last + 1)::BIGINT, (2 * (a - last))::BIGINT), '' ORDER BY a) AS kept
      FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, strlen(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(fin, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
