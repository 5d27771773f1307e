"""A lookup layout over several columns (SNK-08): one table order that serves them all.

Each column's values are ranked by sampled quantiles; the bits of the ranks are interleaved (a
Z-order curve), rows are range-partitioned and sorted along it. Every file and row group then
spans a small range of each column, so Parquet's minima and maxima skip most of them whichever
column a lookup names. Columns of many values get Bloom filters as well. The number of files
follows the number of rows; rows of one place on the curve are split by a hash, so a hot value
does not make one large file.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows sampled for the quantiles, whatever the table's size
SAMPLE = 100_000
BITS = 6
#: a file's rows are sorted in one task's memory
ROWS_PER_FILE = 500_000


def cut_points(df: DataFrame, columns: Sequence[str], rows: int, bits: int = BITS) -> dict[str, list]:
    """At most 2**bits - 1 increasing values per column that split a sample evenly."""
    fraction = min(1.0, SAMPLE / max(rows, 1))
    sample = df.select(*columns).sample(fraction, seed=7).toPandas()  # about SAMPLE rows
    out = {}
    for c in columns:
        values = sorted(sample[c].dropna().tolist())
        picks = [values[i * len(values) // 2**bits] for i in range(1, 2**bits)] if values else []
        # a value's own start is a cut, so common values get a rank of their own
        out[c] = sorted({v for v in picks if bisect.bisect_left(values, v) > 0})
    return out


def rank_of(column: Column, cuts: list, size: int | None = None) -> Column:
    """The number of cut points up to the value (nulls last), as a search tree of comparisons;
    with ``size`` spread evenly over 0 .. size - 1."""
    size = size or len(cuts) + 1

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo * size // (len(cuts) + 1))
        mid = (lo + hi) // 2
        return F.when(column < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(cuts))


def interleaved(columns: Sequence[str], cuts: dict[str, list], bits: int = BITS) -> Column:
    """The place on the Z-order curve: bit i of column k's rank is bit i * columns + k."""
    place = F.lit(0).cast("long")
    for k, c in enumerate(columns):
        rank = rank_of(F.col(c), cuts[c], 2**bits).cast("long")
        for i in range(bits):
            bit = F.shiftright(rank, i).bitwiseAND(F.lit(1).cast("long"))
            place = place.bitwiseOR(F.shiftleft(bit, i * len(columns) + k))
    return place


def ordered(df: DataFrame, columns: Sequence[str], rows_per_file: int = ROWS_PER_FILE, bits: int = BITS) -> DataFrame:
    """``df`` dealt into files of about ``rows_per_file`` rows along the curve, each sorted."""
    rows = df.count()
    place = interleaved(columns, cut_points(df, columns, rows, bits), bits)
    files = max(1, math.ceil(rows / rows_per_file))
    d = df.withColumn("_place", place).withColumn("_split", F.xxhash64(*df.columns))
    return d.repartitionByRange(files, "_place", "_split").sortWithinPartitions("_place", *columns).drop("_place", "_split")


def bloom_options(columns: Sequence[str], values: int = 100_000) -> dict[str, str]:
    """Writer options that give row groups Bloom filters on ``columns``."""
    out = {}
    for c in columns:
        out[f"parquet.bloom.filter.enabled#{c}"] = "true"
        out[f"parquet.bloom.filter.expected.ndv#{c}"] = str(values)
    return out
