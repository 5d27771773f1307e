"""Token counts (8): an exact length histogram whose prefix sums answer every context limit.

Tasks encode whole texts and count documents per encoded length; lengths are summed up over
tasks. For a context limit L the histogram gives the documents and tokens that fit, and the
tokens that remain when every document is cut at L: tokens of shorter documents plus L for
each longer one.

Defined results: null and empty texts have length 0; an empty table gives no rows. Only the
text column is read. The histogram has a row per distinct length; prefix sums run in blocks
of lengths, so no task needs them all.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import running_sum, stored, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY = 64 * 1024 * 1024
LIMITS = (512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072)
PIECE = 1 << 18
#: What the pattern's \s matches. Runs of LONG_BLANK signs are encoded by themselves.
LONG_BLANK = 4096
BLANKS = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_BLANK},}}")

_encoders: dict[bytes, object] = {}


def _encoder(ranks: bytes, pattern: str):
    """One encoder per Python worker and vocabulary."""
    import tiktoken

    key = hashlib.sha1(ranks + pattern.encode()).digest()
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding(f"v-{key.hex()}", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text cut before single blanks between two non-blanks, where the pattern always
    splits; pieces encode to the same tokens as the whole and bound the memory of a call."""
    first = 0
    while len(text) - first > most:
        cut = re.compile(r"(?<=\S) (?=\S)").search(text, first + most)
        if not cut:
            break
        yield text[first:cut.start()]
        first = cut.start()
    yield text[first:]


def n_tokens(encoder, text: str) -> int:
    """Tokens of a whole text.

    The pattern makes one piece of a run of white space, but for its last sign where more text
    follows, which belongs to what comes next. Long runs are cut out as that piece and merged
    without the pattern, whose search backs up over every sign of a run.
    """
    n = first = 0
    for run in BLANKS.finditer(text):
        n += sum(len(encoder.encode_ordinary(p)) for p in pieces(text[first:run.start()]))
        first = run.end() if run.end() == len(text) else run.end() - 1
        n += len(encoder._encode_single_piece(text[run.start():first]))
    return n + sum(len(encoder.encode_ordinary(p)) for p in pieces(text[first:]))


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(length, docs) per task; the vocabulary file is read once and broadcast, checked to be small."""
    with open(vocabulary, "rb") as fh:
        ranks = fh.read(MAX_VOCABULARY + 1)
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary {vocabulary} exceeds {MAX_VOCABULARY} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            lengths = np.fromiter((n_tokens(encoder, t.as_py() or "") for t in batch.column(0)),
                                  np.int64, batch.num_rows)
            length, docs_ = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(docs_.astype(np.int64))], ["length", "docs"])

    return docs.select(text_of().alias("t")).mapInArrow(count, "length long, docs long")


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """length, n_docs, docs_below, tokens_below of every length that occurs."""
    h = token_lengths(docs, vocabulary, pattern).groupBy("length").agg(F.sum("docs").alias("n_docs"))
    h = stored(h, "token-histogram").withColumn("tokens", F.col("length") * F.col("n_docs"))
    h = running_sum(h, [], "length", "n_docs", "docs_below")
    return running_sum(h, [], "length", "tokens", "tokens_below")


def every_limit(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each occurring length taken as the limit: documents and tokens up to it, the share
    of documents (the quantile that the length is), and all tokens after cutting at it."""
    h = stored(histogram(docs, vocabulary), "token-sums")
    total = h.agg(F.sum("n_docs"), F.sum("tokens")).first()
    all_docs, all_tokens = (F.lit(n).cast("long") for n in total)
    docs_fit = F.col("docs_below") + F.col("n_docs")
    tokens_fit = F.col("tokens_below") + F.col("tokens")
    return h.select(
        "length", "n_docs", docs_fit.alias("docs_fit"), tokens_fit.alias("tokens_fit"),
        (docs_fit / all_docs).alias("quantile"),
        (tokens_fit + F.col("length") * (all_docs - docs_fit)).alias("truncated_tokens"),
        all_docs.alias("total_docs"), all_tokens.alias("total_tokens"))


def at_limits(sums: DataFrame, limits=LIMITS) -> DataFrame:
    """Answers for given context limits from ``every_limit``: one aggregate over the histogram."""
    pick = sums.agg(*[F.sum(F.col("n_docs") * F.least(F.col("length"), F.lit(x))).alias(f"t{x}") for x in limits],
                    *[F.sum(F.when(F.col("length") <= x, F.col("n_docs")).otherwise(0)).alias(f"d{x}") for x in limits])
    rows = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("context_limit"), F.col(f"d{x}").alias("docs_fit"),
                                        F.col(f"t{x}").alias("truncated_tokens")) for x in limits])).alias("r")
    return pick.select(rows).select("r.*")


def op8_token_counts(docs: DataFrame) -> DataFrame:
    return every_limit(docs)
