"""Calendar functions (FN-01..04) and the federal-holiday calendar (SRC-12).

All are built-in column expressions; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso_week(y: Column | str, m: Column | str, d: Column | str) -> Column:
    """FN-01: ISO-8601 week of (year, month, day); 2010-01-01 -> 53."""
    return F.weekofyear(F.make_date(F.col(y) if isinstance(y, str) else y,
                                    F.col(m) if isinstance(m, str) else m,
                                    F.col(d) if isinstance(d, str) else d))


def iso_dow(d: Column) -> Column:
    """ISO weekday 1 (Monday) .. 7 (Sunday)."""
    return F.weekday(d) + 1


def date_parts(df: DataFrame, date_col: str) -> DataFrame:
    """FN-03: Month, ISO Week and weekday (1-7) of a date column."""
    d = F.col(date_col)
    return df.withColumns({"Month": F.month(d), "Week": F.weekofyear(d), "DayOfWeek": iso_dow(d)})


def clean_date(year: Column, text: Column) -> Column:
    """FN-02: 'Weekday, Month D' + year -> date.

    Non-word characters become blanks (FN-14), then the month name and day
    number are taken by position and parsed with the year.
    """
    words = F.split(F.trim(F.regexp_replace(text, r"[^A-Za-z0-9]+", " ")), " ")
    return F.try_to_date(F.concat_ws(" ", year.cast("string"), words.getItem(1), words.getItem(2)),
                         "yyyy MMMM d")


# Federal holidays as (name, month, rule, day or k, ISO weekday). Fixed
# values of the calendar: 'fixed' dates move to Friday when on a Saturday and
# to Monday when on a Sunday; 'nth' is the k-th given weekday of the month;
# 'last' the last given weekday of the month.
HOLIDAY_RULES = [
    ("New Year's Day", 1, "fixed", 1, 0),
    ("Birthday of Martin Luther King, Jr.", 1, "nth", 3, 1),
    ("Washington's Birthday", 2, "nth", 3, 1),
    ("Memorial Day", 5, "last", 0, 1),
    ("Independence Day", 7, "fixed", 4, 0),
    ("Labor Day", 9, "nth", 1, 1),
    ("Columbus Day", 10, "nth", 2, 1),
    ("Veterans Day", 11, "fixed", 11, 0),
    ("Thanksgiving Day", 11, "nth", 4, 4),
    ("Christmas Day", 12, "fixed", 25, 0),
]


def _holiday_date(y: Column, m: Column, rule: Column, n: Column, w: Column) -> Column:
    first = F.make_date(y, m, F.lit(1))
    fixed = F.make_date(y, m, n)
    fixed_dow = iso_dow(fixed)
    observed = (F.when(fixed_dow == 6, F.date_sub(fixed, 1))
                .when(fixed_dow == 7, F.date_add(fixed, 1)).otherwise(fixed))
    nth = F.date_add(first, ((w - iso_dow(first) + 7) % 7 + (n - 1) * 7).cast("int"))
    last = F.last_day(first)
    lastw = F.date_sub(last, ((iso_dow(last) - w + 7) % 7).cast("int"))
    return F.when(rule == "fixed", observed).when(rule == "nth", nth).otherwise(lastw)


def years_around(years: DataFrame, year_col: str = "YEAR") -> DataFrame:
    """Every year from one before the earliest to one after the latest."""
    y = F.col(year_col)
    return years.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).where(F.col("lo").isNotNull()) \
        .select(F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias(year_col))


def holidays(years: DataFrame, year_col: str = "YEAR") -> DataFrame:
    """Holiday calendar (Year, Date, Holiday, Month, Week) for the given years.

    Each year row is expanded by the literal rule list (a generator, no
    join), so the calendar follows whatever years the data holds.
    """
    rules = F.array(*[F.struct(F.lit(nm).alias("h"), F.lit(mo).alias("m"), F.lit(r).alias("r"),
                               F.lit(k).alias("k"), F.lit(w).alias("w"))
                      for nm, mo, r, k, w in HOLIDAY_RULES])
    y = years.select(F.col(year_col).cast("int").alias("Year")).distinct()
    e = y.select("Year", F.inline(rules))
    d = _holiday_date(F.col("Year"), F.col("m"), F.col("r"), F.col("k"), F.col("w"))
    return e.select("Year", d.alias("Date"), F.col("h").alias("Holiday")).transform(
        lambda df: df.withColumns({"Month": F.month("Date"), "Week": F.weekofyear("Date")}))
