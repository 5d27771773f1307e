"""Whole-batch text arithmetic with numpy on the buffers of an Arrow string column.

Texts of a batch lie back to back in one byte array. Words are found by byte class and hashed
eight bytes at a time. Runs of words get a position-free polynomial hash: with prefix sums
P[i] = sum(item_j * B**j, j < i) the run [s, e) has the hash (P[e] - P[s]) * B**-s modulo
2**64, mixed afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0xD6E8FEB86659FD93 | 1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: keeps the first k bytes of a little-endian 8-byte load
KEEP = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [2**64 - 1], dtype=np.uint64)
LONG_WORD = 512


def _powers(base: U, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW: dict[int, np.ndarray] = {}


def powers(base: U, n: int) -> np.ndarray:
    key = int(base)
    if key not in _POW or len(_POW[key]) < n:
        _POW[key] = _powers(base, max(n, 1 << 16))
        while len(_POW) > 6:
            _POW.pop(next(iter(_POW)))
    return _POW[key][:n]


def inverse(base: U) -> U:
    return U(pow(int(base), -1, 2**64))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and the n + 1 offsets of the texts in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + n + 1] if n else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, *columns: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ``most`` bytes in the text columns, or a single longer row."""
    n = batch.num_rows
    if not n:
        return
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                for c in columns)
    total, first = np.concatenate([[0], np.cumsum(sizes)]), 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words of the texts of one slice: byte spans [start, end) and the text of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        mask = is_word[data] if n else np.zeros(0, bool)
        first = np.zeros(n + 1, bool)
        first[offsets] = True  # a text starts here
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, mask[:-1]
            after[-1], after[:-1] = False, mask[1:]
            before &= ~first[:-1]
            after &= ~first[1:]
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        #: words of text i are first[i] .. first[i + 1]
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def strings(self) -> pa.Array:
        """The words themselves, as a large_binary column."""
        size = self.end - self.start
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.start] += 1
        edge[self.end] -= 1
        held = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(size),
                                     [None, pa.py_buffer(offsets), pa.py_buffer(self.data[held].tobytes())])

    def keyed(self, fold: bool, key: int) -> np.ndarray:
        """64-bit hash of each word under a secret 64-bit key; ``fold`` reads A-Z as a-z.

        Every eight bytes pass the whole finaliser, which starts from the key: without it
        nobody can make up two words of one hash.
        """
        if not len(self.start):
            return np.zeros(0, np.uint64)
        data = np.concatenate([FOLD[self.data] if fold else self.data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(self.data) + 1,), (1,))
        size = self.end - self.start
        h = mix(mix(size.astype(np.uint64) ^ U(key), 1) ^ U(key), 2)
        short = np.flatnonzero(size <= LONG_WORD)
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = int.from_bytes(hashlib.blake2b(data[self.start[i]:self.end[i]], digest_size=8,
                                                  key=key.to_bytes(8, "little")).digest(), "little")
        at, left, who = self.start[short], size[short], short
        while len(at):
            h[who] = mix(h[who] ^ (eight[at] & KEEP[np.minimum(left, 8)]), 3)
            more = np.flatnonzero(left > 8)
            at, left, who = at[more] + 8, left[more] - 8, who[more]
        return mix(h ^ U(key), 4)

    def hashes(self, fold: bool) -> np.ndarray:
        """64-bit hash of each word; ``fold`` reads A-Z as a-z."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        data = np.concatenate([FOLD[self.data] if fold else self.data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(self.data) + 1,), (1,))
        size = self.end - self.start
        h = size.astype(np.uint64)
        with np.errstate(over="ignore"):
            at, left, who = self.start, size, None
            if size.max() > LONG_WORD:
                who = np.flatnonzero(size <= LONG_WORD)
                at, left = at[who], left[who]
                for i in np.flatnonzero(size > LONG_WORD):
                    h[i] = int.from_bytes(hashlib.blake2b(data[self.start[i]:self.end[i]], digest_size=8).digest(),
                                          "little")
            while len(at):
                x = (h if who is None else h[who]) ^ (eight[at] & KEEP[np.minimum(left, 8)])
                x *= U(0x9E3779B97F4A7C15)
                x ^= x >> U(32)
                if who is None:
                    h, more = x, np.flatnonzero(left > 8)
                    who = more
                else:
                    h[who] = x
                    more = np.flatnonzero(left > 8)
                    who = who[more]
                at, left = at[more] + 8, left[more] - 8
        return mix(h)


def run_hashes(items: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each run items[start:end) of 64-bit items; equal runs have equal hashes."""
    n = len(items)
    if not len(start):
        return np.zeros(0, np.uint64)
    base = BASE ^ U(seed << 8)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(items, seed + 11) * powers(base, n), out=prefix[1:])
        h = (prefix[end] - prefix[start]) * powers(inverse(base), n + 1)[start]
        return mix(h ^ (end - start).astype(np.uint64), seed + 3)


def byte_class(outside: str) -> np.ndarray:
    """True for every byte value that is not among the characters of ``outside``."""
    table = np.ones(256, bool)
    table[[ord(c) for c in outside]] = False
    return table


#: ASCII white space, x20 and x09 to x0D.
SPACE = " \t\n\x0b\x0c\r"
NOT_SPACE = byte_class(SPACE)
#: A-z, 0-9 and everything beyond ASCII are word bytes (A-Z are folded to a-z).
ALNUM = byte_class("".join(chr(c) for c in range(128) if not chr(c).isalnum()))


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of ``size`` words; a shorter, non-empty text is one run."""
    count = np.diff(words.first)
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    text = np.repeat(np.arange(len(count)), runs)
    start = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs) + words.first[:-1][text]
    end = np.minimum(start + size, words.first[1:][text])
    return run_hashes(hashes, start, end), text
