"""Cross-tabs and shares (RSH-*, AGG-10, WIN-02/03).

Pivots always get an explicit value list, so Spark does not run an extra
job to discover the distinct values, and the aggregate is a single
``groupBy(index).pivot(col, values).sum(...)`` (partial aggregation first).
Absent cells stay NULL, as in a pandas pivot table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac.operators.aggregates import indicator

DELAY_GROUPS = list(range(-2, 13))  # -2 .. 12, the 15-minute delay groups


def group_name(g: int) -> str:
    return f"G{g}".replace("-", "M")


def pivot_by_group(fl: DataFrame, index: str, group: str = "ARR_DELAY_GROUP",
                   value: str = "FLIGHTS") -> DataFrame:
    """RSH-02..07: index x delay group, summed flights (columns G_2..G12)."""
    p = fl.groupBy(index).pivot(group, DELAY_GROUPS).agg(F.sum(value))
    return p.select(index, *[F.col(str(g)).alias(group_name(g)) for g in DELAY_GROUPS])


def pivot_values(df: DataFrame, index: str, col: str, values: list, value: str) -> DataFrame:
    """RSH-01: long -> wide with a given value list."""
    return df.groupBy(index).pivot(col, values).agg(F.sum(value))


def row_totals(fl: DataFrame, index: str, group: str = "ARR_DELAY_GROUP", value: str = "FLIGHTS") -> DataFrame:
    """AGG-10: total per cross-tab row (sum over the non-null groups)."""
    return (fl.where(F.col(group).isNotNull()).groupBy(index)
            .agg(F.sum(value).alias("TOTAL")))


def all_totals(fl: DataFrame, index: str, group: str = "ARR_DELAY_GROUP", value: str = "FLIGHTS") -> DataFrame:
    """AGG-10: row, column and grand totals of a cross-tab.

    The cells are summed first; grouping sets then add them up, so the flights are read once and
    not multiplied. KIND is the grouping id over (index, group): 1 a row total, 2 a column total,
    3 the grand total. It tells a group of nulls (KIND 1 or 2, null name) from a total's blank.
    """
    cells = fl.groupBy(index, group).agg(F.sum(value).alias("cell"))
    return cells.groupingSets([[F.col(index)], [F.col(group)], []], index, group) \
        .agg(F.grouping_id().alias("KIND"), F.sum("cell").alias("TOTAL")).select(index, group, "KIND", "TOTAL")


def row_percent(fl: DataFrame, index: str, group: str = "ARR_DELAY_GROUP", value: str = "FLIGHTS") -> DataFrame:
    """WIN-02: 100 * cell / row total, long form (index, group, cell, pct).

    The window partitions the (index, group) counts, not the flights.
    """
    cells = (fl.where(F.col(group).isNotNull()).groupBy(index, group)
             .agg(F.sum(value).alias("FLIGHTS")))
    tot = F.sum("FLIGHTS").over(W.partitionBy(index))
    return cells.withColumn("PCT", F.round(F.lit(100.0) * F.col("FLIGHTS") / tot, 6))


def cause_rate(fl: DataFrame, causes: list[str], index: str = "DAY_OF_WEEK",
               group: str = "ARR_DELAY_GROUP") -> DataFrame:
    """WIN-03: flights delayed by each cause / flights in delay groups 0..12,
    per weekday (two grouped sums in one pass)."""
    late = F.col(group).between(0, 12)
    agg = fl.groupBy(index).agg(
        F.sum(F.when(late, F.col("FLIGHTS"))).alias("__den"),
        *[F.sum(indicator(c)).alias(c) for c in causes])
    return agg.select(index, *[F.round(F.try_divide(F.col(c), F.col("__den")), 6).alias(c) for c in causes])
