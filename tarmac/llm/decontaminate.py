"""Benchmark decontamination (6): prefix-filtered set join of item windows and documents.

A window is ten consecutive words of an item (an item of fewer words is one window). It is the
set of its five-word shingles. Shingles are ordered by rarity, that is by how often documents
hold them; since a hit must contain all of a window, one prefix shingle is enough: the rarest.
Each occurrence of a prefix shingle in a document proposes one place for the window. Length
and position bounds drop places that reach outside the text, and the remaining ones are
verified: by the words' hashes first, then by the words themselves, byte for byte.

Documents stream past the windows and are never shuffled. The items are read in blocks of at
most BLOCK_WORDS words, so what is broadcast is bounded whatever the benchmark's size; the
documents pass one map per block.

Defined results: null or wordless documents have no words and no hits; null or wordless items
have no windows. A null item_id takes part as the empty string; items that share an id count
once. Rows are judged one by one, so repeated doc_ids and other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm import textnum as tn
from tarmac.llm.common import text_of

WINDOW = 10
SHINGLE = 5
BLOCK_WORDS = 2_000_000
SPANS = "t string, id long, spans binary, items array<string>"


def _words(column: pa.Array) -> tuple[tn.Words, np.ndarray]:
    words = tn.Words(*_folded(column), tn.ALNUM)
    return words, words.hashes(False)


def _folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tn.column_bytes(column)
    return tn.FOLD[data], offsets


class Windows:
    """The windows of a block of items, as arrays."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids = ids
        words, h = _words(pa.array(texts, pa.string()))
        #: all words, a blank behind each, and where they start
        self.raw = b"".join(w + b" " for w in words.strings().to_pylist())
        self.at_word = np.concatenate([[0], np.cumsum(words.end - words.start + 1)]).astype(np.int64)
        count = np.diff(words.first)
        runs = np.where(count >= WINDOW, count - WINDOW + 1, (count > 0).astype(count.dtype))
        self.item = np.repeat(np.arange(len(count)), runs)
        first = words.first[:-1][self.item] + np.arange(len(self.item)) - np.repeat(np.cumsum(runs) - runs, runs)
        self.head = first
        self.size = np.minimum(count[self.item], WINDOW)
        #: word hashes, padded beyond the window's size
        self.words = np.where(np.arange(WINDOW) < self.size[:, None],
                              np.append(h, np.zeros(WINDOW, np.uint64))[first[:, None] + np.arange(WINDOW)], tn.U(0))
        #: words of a shingle: five, or all of a smaller window
        self.width = np.minimum(self.size, SHINGLE)
        place = np.arange(WINDOW - SHINGLE + 1)
        held = place <= (self.size - self.width)[:, None]
        starts = np.broadcast_to(place, held.shape)[held] + np.repeat(np.arange(len(self.size)) * WINDOW, held.sum(1))
        width = np.repeat(self.width, held.sum(1))
        self.shingle = np.zeros(held.shape, np.uint64)
        self.shingle[held] = tn.run_hashes(self.words.ravel(), starts, starts + width)
        self.held = held
        self.known = np.unique(self.shingle[held])

    def choose(self, times: np.ndarray) -> None:
        """Take each window's rarest shingle (``times`` by ``known``; ties: the first) as its prefix."""
        often = np.full(self.held.shape, np.iinfo(np.int64).max)
        often[self.held] = times[np.searchsorted(self.known, self.shingle[self.held])]
        self.at = often.argmin(1) if len(often) else np.zeros(0, np.int64)
        self.prefix = self.shingle[np.arange(len(self.at)), self.at]
        order = np.argsort(self.prefix, kind="stable")
        for name in ("item", "head", "size", "words", "width", "at", "prefix"):
            setattr(self, name, getattr(self, name)[order])
        del self.shingle, self.held, self.known


class Filter:
    """Positions in an array of hashes that are among some sorted hashes."""

    def __init__(self, sorted_hashes: np.ndarray):
        self.sorted = sorted_hashes
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(sorted_hashes >> tn.U(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(self.bits[(hashes >> tn.U(44)).astype(np.int64)])
        if not len(near) or not len(self.sorted):
            return near[:0]
        at = np.minimum(np.searchsorted(self.sorted, hashes[near]), len(self.sorted) - 1)
        return near[self.sorted[at] == hashes[near]]


def _runs(words: tn.Words, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``width`` words inside a text."""
    first = np.arange(max(len(h) - width + 1, 0))
    first = first[words.text[first] == words.text[first + width - 1]] if len(first) else first
    return first, tn.run_hashes(h, first, first + width)


def _blocks(benchmark: DataFrame) -> Iterator[Windows]:
    """Items in blocks of about BLOCK_WORDS words, read one partition at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), text_of().alias("t"))
    for row in rows.toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"]) // 2 + 1
        if size >= BLOCK_WORDS:
            yield Windows(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Windows(ids, texts)


def _rarity(docs: DataFrame, block: Windows) -> np.ndarray:
    """How often documents hold each shingle of the block: summed per task, then over tasks."""
    widths = [int(w) for w in np.unique(block.width)]
    shared = docs.sparkSession.sparkContext.broadcast(block.known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(shared.value)
        times = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for part in tn.slices(batch, "t"):
                words, h = _words(part.column("t"))
                for width in widths:
                    _, runs = _runs(words, h, width)
                    hit = runs[known.find(runs)]
                    np.add.at(times, np.searchsorted(known.sorted, hit), 1)
        i = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(times[i])], ["i", "n"])

    rows = docs.select(text_of().alias("t")).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    out = np.zeros(len(block.known), np.int64)
    found = rows.toPandas()  # at most a row per shingle of the block
    out[found["i"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _spoken(words: tn.Words, first: int, end: int) -> bytes:
    """Words first .. end, a blank behind each."""
    return b"".join(words.data[a:b].tobytes() + b" " for a, b in zip(words.start[first:end], words.end[first:end], strict=True))


def _matches(words: tn.Words, h: np.ndarray, block: Windows, known: Filter) -> tuple[np.ndarray, np.ndarray]:
    """First word and window index of every occurrence of a window."""
    firsts, which = [], []
    for width in np.unique(block.width):
        first, runs = _runs(words, h, int(width))
        hit = known.find(runs)
        lo = np.searchsorted(block.prefix, runs[hit], "left")
        n = np.searchsorted(block.prefix, runs[hit], "right") - lo
        window = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(first[hit], n)
        start = at - block.at[window]
        end = start + block.size[window]
        text = words.text[at]
        ok = (block.width[window] == width) & (start >= words.first[text]) & (end <= words.first[text + 1])
        start, window = start[ok], window[ok]
        place = np.arange(WINDOW)
        inside = place < block.size[window][:, None]
        theirs = h[np.minimum(start[:, None] + place, len(h) - 1)]
        same = ((theirs == block.words[window]) | ~inside).all(1)
        start, window = start[same], window[same]
        equal = np.fromiter((_spoken(words, s, s + n) == block.raw[block.at_word[f]:block.at_word[f + n]]
                             for s, n, f in zip(start, block.size[window], block.head[window], strict=True)), bool, len(start))
        firsts.append(start[equal])
        which.append(window[equal])
    return np.concatenate(firsts or [np.zeros(0, int)]), np.concatenate(which or [np.zeros(0, int)])


def _hit_map(docs: DataFrame, block: Windows) -> DataFrame:
    """Adds the block's hit words (spans: pairs of first and end word) and items to each row."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        known = Filter(np.unique(windows.prefix))
        for batch in batches:
            for part in tn.slices(batch, "t"):
                words, h = _words(part.column("t"))
                start, window = _matches(words, h, windows, known)
                text = words.text[start]
                spans, items = part.column("spans").to_pylist(), part.column("items").to_pylist()
                for i in np.unique(text):
                    mine = text == i
                    first = start[mine] - words.first[i]
                    pairs = np.stack([first, first + windows.size[window[mine]]], 1).astype("<i8")
                    spans[i] += pairs.tobytes()
                    items[i] = sorted({*items[i], *(windows.ids[k] for k in windows.item[window[mine]])})
                yield pa.RecordBatch.from_arrays(
                    [part.column("t"), part.column("id"), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                    ["t", "id", "spans", "items"])

    return docs.mapInArrow(find, SPANS)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tn.slices(batch, "t"):
            words = tn.Words(*_folded(part.column("t")), tn.ALNUM)
            n_words = np.diff(words.first)
            n_hit = np.zeros(part.num_rows, np.int64)
            for i, raw in enumerate(part.column("spans").to_pylist()):
                if raw:
                    pairs = np.frombuffer(raw, "<i8").reshape(-1, 2)
                    edge = np.zeros(n_words[i] + 1, np.int64)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 1], -1)
                    n_hit[i] = (np.cumsum(edge)[:-1] > 0).sum()
            items = part.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n_words.astype(np.int64)), pa.array(n_hit),
                 pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "n_items", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items and the sorted item_ids of every row of ``docs``."""
    rows = docs.select(text_of().alias("t"), F.col("doc_id").cast("long").alias("id"),
                       F.lit(b"").alias("spans"), F.array().cast("array<string>").alias("items"))
    for block in _blocks(benchmark):
        if len(block.item):
            block.choose(_rarity(docs, block))
            rows = _hit_map(rows, block)
    return rows.mapInArrow(_judge, "doc_id long, n_words long, n_hit long, n_items long, items array<string>")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of any item, with all their columns: one filter per
    block on each row's own text, without a join or a shuffle."""
    kept = docs
    for block in _blocks(benchmark):
        if len(block.item):
            block.choose(_rarity(docs, block))
            kept = kept.where(~_is_hit(docs, block)(text_of()))
    return kept


def _is_hit(docs: DataFrame, block: Windows):
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.arrow_udf("boolean")
    def hit(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = shared.value
        known = Filter(np.unique(windows.prefix))
        for batch in texts:
            out = [np.zeros(0, bool)]
            for part in tn.slices(pa.RecordBatch.from_arrays([batch], ["t"]), "t"):
                words, h = _words(part.column("t"))
                start, _ = _matches(words, h, windows, known)
                out.append(np.isin(np.arange(part.num_rows), words.text[start]))
            yield pa.array(np.concatenate(out))

    return hit


def op6_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    d = contamination(docs, benchmark)
    joined = F.array_join("items", ",")
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined, 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s
       FROM (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
             FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bs),
ds AS (SELECT doc_id, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
m AS (SELECT ds.doc_id, ds.l, ds.i, bs.item_id FROM ds JOIN bs ON ds.s = bs.s AND ds.l = bs.l),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
