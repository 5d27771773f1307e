"""Substring dedup (3): sliding sentence spans.

Every run of RUN consecutive sentences is hashed to 128 bits over its words (white space does
not count). Per run hash the smallest doc_id is found with a partial aggregate and joined back,
so a document learns which of its runs occur in an earlier document; runs that repeat inside a
document are seen locally. Sentences covered by a repeated run are removed.

A sentence ends at white space after . ! or ?, or at a line break. A text of fewer sentences is
one run. Runs of fewer than MIN_WORDS words are too short to count as a passage.

With ``grow`` (query op3_substring_dedup_grown) no run is dropped for being short while its text
is long enough: it grows by whole sentences until it holds RUN sentences and MIN_WORDS words; at
the end of the text it grows backwards. So short lines, verse and dialogue are compared too. Only
texts of fewer than MIN_WORDS words have no run. A sentence of LONG_SENTENCE words or more is a run
of its own besides, so a passage is found by one long sentence between cut ones. Closing quotes and
brackets after a stop belong to the sentence, and the wide stops of Chinese and Japanese end one
without white space. A passage whose whole sentences are fewer than RUN and shorter than
LONG_SENTENCE words stays (figures in the README).

A hot run (a passage in a third of all documents) reaches the shuffle once per task, and the
join back to its documents is an equi-join that adaptive execution splits.

Defined results: null and wordless texts have no sentences and stay as they are (null: empty).
Order is by doc_id, null last; rows that share a doc_id (or have none) do not count as earlier
than one another, and each loses the runs it shares with earlier documents. Other columns play
no part.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm import textnum as tn
from tarmac.llm.common import text_of

RUN = 2
MIN_WORDS = 8
LONG_SENTENCE = 25
LAST = np.iinfo(np.int64).max
#: Characters that end a sentence before white space.
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?"]] = True
#: Stops that end a sentence without white space; what closes a quote behind a stop.
WIDE_STOPS = "。！？｡"
CLOSERS = "\"')]}”’»」』）"


def _found(data: np.ndarray, signs: str) -> np.ndarray:
    """For each byte the size of the sign that ends there, or 0."""
    size = np.zeros(len(data), np.int64)
    for sign in signs:
        code = np.frombuffer(sign.encode(), np.uint8)
        at = np.flatnonzero(data == code[-1])
        at = at[at >= len(code) - 1]
        for k in range(1, len(code)):
            at = at[data[at - k] == code[-1 - k]]
        size[at] = len(code)
    return size


def _stopped(w: tn.Words) -> np.ndarray:
    """Whether each word ends with a stop, but for closing signs; words are cut behind wide
    stops first."""
    n = len(w.data)
    closer, wide = _found(w.data, CLOSERS), _found(w.data, WIDE_STOPS) > 0
    at = np.flatnonzero(wide) + 1  # first byte behind a wide stop and its closing signs
    ahead = np.zeros(n + 4, np.int64)
    ahead[np.maximum(np.flatnonzero(closer) + 1 - closer[closer > 0], 0)] = closer[closer > 0]
    while (ahead[at] > 0).any():
        at = at + ahead[at]
    at = np.unique(at)
    word = np.searchsorted(w.start, at, "right") - 1
    inside = (at > w.start[word]) & (at < w.end[word]) if len(at) else np.zeros(0, bool)
    at, word = at[inside], word[inside]
    w.text = np.insert(w.text, word + 1, w.text[word])
    w.start = np.sort(np.concatenate([w.start, at]))
    w.end = np.sort(np.concatenate([w.end, at]))
    w.first = np.searchsorted(w.start, w.offsets)
    end = w.end.copy()
    while True:
        size = closer[end - 1]
        more = (size > 0) & (end - size > w.start)
        if not more.any():
            return STOPS[w.data[end - 1]] | wide[end - 1]
        end = np.where(more, end - size, end)


class Sentences:
    """Sentences of the texts of a slice (first word, end word, text) and their runs."""

    def __init__(self, column: pa.Array, run: int, grow: int = 0):
        data, offsets = tn.column_bytes(column)
        self.words = w = tn.Words(data, offsets, tn.NOT_SPACE)
        stopped = _stopped(w) if grow and len(w.start) else STOPS[data[w.end - 1]]
        n = len(w.start)
        starts = np.zeros(n, bool)
        if n:
            breaks = np.concatenate([[0], np.cumsum(data == 10)])
            starts[0] = True
            starts[1:] = (stopped[:-1] | (breaks[w.start[1:]] > breaks[w.end[:-1]])
                          | (w.text[1:] != w.text[:-1]))
        self.start = np.flatnonzero(starts)
        self.end = np.append(self.start[1:], n)[:len(self.start)]
        self.text = w.text[self.start]
        #: sentences of text i are first[i] .. first[i + 1]
        self.first = np.searchsorted(self.text, np.arange(len(offsets)))
        count = np.diff(self.first)
        runs = np.where(count >= run, count - run + 1, (count > 0).astype(count.dtype))
        self.run_text = np.repeat(np.arange(len(count)), runs)
        self.run_first = (np.arange(len(self.run_text)) - np.repeat(np.cumsum(runs) - runs, runs)
                          + self.first[:-1][self.run_text])
        self.run_end = np.minimum(self.run_first + run, self.first[1:][self.run_text])
        if grow:
            self._grown(run, grow)

    def _grown(self, run: int, least: int) -> None:
        """From each sentence the shortest run of ``run`` sentences and ``least`` words; the
        shortest that ends the text where too little follows."""
        low, limit = self.first[:-1][self.text], self.first[1:][self.text]
        first = np.arange(len(self.start))
        end = np.maximum(first + run, np.searchsorted(self.end, self.start + least) + 1)
        back = np.minimum(limit - run, np.searchsorted(self.start, self.end[limit - 1] - least, "right") - 1)
        over = end > limit
        long = np.flatnonzero(self.end - self.start >= LONG_SENTENCE)
        first = np.concatenate([np.where(over, np.maximum(back, low), first), long])
        self._runs(first, np.concatenate([np.minimum(end, limit), long + 1]))

    def _runs(self, first: np.ndarray, end: np.ndarray) -> None:
        """Each of the runs of sentences first .. end once."""
        n = len(self.start) + 1
        self.run_first, self.run_end = np.divmod(np.unique(first * n + end), n)
        self.run_text = self.text[self.run_first]

    def hashes(self, min_words: int, keys: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes per run, over words hashed under two keys; runs that are too short are left
        out of the run arrays."""
        long = self.end[self.run_end - 1] - self.start[self.run_first] >= min_words if len(self.run_first) else []
        keep = np.flatnonzero(long)
        self.run_text, self.run_first, self.run_end = self.run_text[keep], self.run_first[keep], self.run_end[keep]
        a, b = self.start[self.run_first], self.end[self.run_end - 1] if len(keep) else keep
        return tuple(tn.run_hashes(self.words.keyed(False, key), a, b, seed).view(np.int64) for seed, key in enumerate(keys, 1))


def _runs(run: int, min_words: int, grow: bool, keys: tuple[int, int]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "t"):
                s = Sentences(part.column("t"), run, min_words if grow else 0)
                h1, h2 = s.hashes(min_words, keys)
                ids, th = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
                if len(h1):  # a run counts once per text
                    order = np.lexsort((h2, h1, s.run_text))
                    t, x, y = s.run_text[order], h1[order], h2[order]
                    one = np.ones(len(t), bool)
                    one[1:] = (t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(a[one]) for a in (x, y, ids[t], th[t])], ["h1", "h2", "id", "th"])
    return emit


def _rebuild(run: int, min_words: int, grow: bool, keys: tuple[int, int]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "t"):
                s = Sentences(part.column("t"), run, min_words if grow else 0)
                h1, h2 = s.hashes(min_words, keys)
                column = part.column("seen")
                seen = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(part.num_rows), sizes)
                gone = np.zeros(len(h1), bool)
                if len(h1):
                    order = np.lexsort((s.run_first, h2, h1, s.run_text))  # later copies inside a text
                    t, x, y = s.run_text[order], h1[order], h2[order]
                    gone[order[1:]] = (t[1:] == t[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
                    known = np.sort(tn.mix(seen.view(np.uint64) ^ tn.mix(owner.astype(np.uint64), 5)))
                    if len(known):
                        mine = tn.mix(h1.view(np.uint64) ^ tn.mix(s.run_text.astype(np.uint64), 5))
                        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                        gone |= known[at] == mine
                edge = np.zeros(len(s.start) + 1, np.int64)
                np.add.at(edge, s.run_first[gone], 1)
                np.add.at(edge, s.run_end[gone], -1)
                covered = np.cumsum(edge)[:-1] > 0
                per_text = np.add.reduceat(np.append(covered, False).astype(np.int64), s.first[:-1]) \
                    if part.num_rows else np.zeros(0, np.int64)
                per_text[np.diff(s.first) == 0] = 0
                texts = _kept(s, covered, per_text, part.column("t"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(s.first).astype(np.int64)), pa.array(per_text),
                     pa.array(texts, pa.string())], ["doc_id", "n_sentences", "n_removed", "text"])
    return emit


def _kept(s: Sentences, covered: np.ndarray, per_text: np.ndarray, column: pa.Array) -> list[str]:
    """Texts without their covered sentences; a sentence owns the white space after it."""
    texts = column.to_pylist()
    for i in np.flatnonzero(per_text):
        lo, hi = s.first[i], s.first[i + 1]
        begin, end = s.words.offsets[i], s.words.offsets[i + 1]
        cut = np.append(s.words.start[s.start[lo:hi]], end)
        raw = s.words.data
        kept = [raw[begin:cut[0]].tobytes()]
        kept += [raw[cut[k]:cut[k + 1]].tobytes() for k in range(hi - lo) if not covered[lo + k]]
        texts[i] = b"".join(kept).decode("utf-8")
    return texts


def substring_dedup(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, grow: bool = False) -> DataFrame:
    """doc_id, n_sentences, n_removed and the text that is left, for every row."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("id"), text_of().alias("t")) \
        .withColumn("th", F.hash("t"))  # rows without an id, or with a repeated one, are told apart by text
    keys = (secrets.randbits(64), secrets.randbits(64))  # of this job: no text can be made to collide
    runs = rows.mapInArrow(_runs(run, min_words, grow, keys), "h1 long, h2 long, id long, th int")
    first = runs.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")) \
        .where("first < last").drop("last")
    seen = runs.join(first, ["h1", "h2"]).where("id > first").groupBy("id", "th").agg(F.collect_set("h1").alias("seen"))
    out = rows.join(seen, ["id", "th"], "left").mapInArrow(
        _rebuild(run, min_words, grow, keys), "doc_id long, n_sentences long, n_removed long, text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != int(LAST), F.col("doc_id")))


def op3_substring_dedup(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs)


def op3_substring_dedup_grown(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs, grow=True)


#: Sentences keep the white space after them; chr(1) marks their ends.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*') AS lead FROM documents),
s AS (SELECT doc_id, t, lead, list_filter(string_split(regexp_replace(substr(t, length(lead) + 1),
        '([.!?][\x20\x09-\x0D]+|[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM d),
w AS (SELECT *, list_transform(parts, lambda x: regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS ws, least(len(parts), {RUN}) AS n FROM s),
r AS (SELECT doc_id, n, k, flatten(list_slice(ws, k, k + n - 1)) AS run
      FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n, -1) + 2)) AS k FROM w WHERE len(ws) > 0)),
q AS (SELECT doc_id, n, k, row_number() OVER (PARTITION BY array_to_string(run, ' ') ORDER BY doc_id, k) AS place
      FROM r WHERE len(run) >= {MIN_WORDS}),
c AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(k, k + n)) AS i FROM q WHERE place > 1) GROUP BY doc_id)
SELECT w.doc_id, len(parts)::BIGINT AS n_sentences, coalesce(len(gone), 0)::BIGINT AS n_removed,
       CASE WHEN gone IS NULL THEN t ELSE lead || array_to_string(list_transform(list_filter(range(1, len(parts) + 1),
            lambda i: NOT list_contains(gone, i)), lambda i: parts[i]), '') END AS text
FROM w LEFT JOIN c ON c.doc_id = w.doc_id
"""
