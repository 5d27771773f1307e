"""Derived columns (FN-06..20): plain column expressions.

Divisions use ``try_divide`` so a zero denominator yields NULL under ANSI
mode instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rec_time(dep: Column, arr: Column) -> Column:
    """FN-06: time recovered in the air: -dep-arr if both early, else dep-arr."""
    return F.when((dep < 0) & (arr < 0), -dep - arr).otherwise(dep - arr)


def route(origin: Column, dest: Column) -> Column:
    """FN-08: 'origin-dest'."""
    return F.concat(origin, F.lit("-"), dest)


def ratio(num: str | Column, den: str | Column) -> Column:
    """FN-09/10: safe ratio (NULL on zero or NULL denominator)."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    return F.try_divide(n, d)


def normalize(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """FN-11: divide each of ``cols`` by the per-row denominator ``by``."""
    return df.withColumns({c: F.try_divide(F.col(c), F.col(by)) for c in cols})


def sq_distance(a: list[Column], b: list[Column]) -> Column:
    """FN-16: squared Euclidean distance between two equally long vectors."""
    acc = F.lit(0.0)
    for x, y in zip(a, b):
        acc = acc + (x - y) * (x - y)
    return acc


def label_text(*parts: Column) -> Column:
    """FN-20: cast to text and join with ' - '."""
    return F.concat_ws(" - ", *[p.cast("string") for p in parts])
