"""Days against tables of intervals, by equality joins.

An interval is laid into bins as wide as a quarter of it or more (a power of two of days), so it takes
at most five or six of them, however long it is. A day knows its bin at every width. Both sides meet
on (width, bin), and an exact test follows; every pair meets once, as an interval has one width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

WIDTHS = 22  # widths of 1, 2, 4, ... days; the last holds four thousand years in a bin


def day_pairs(days: DataFrame, intervals: DataFrame, day: str = "date", start: str = "start", end: str = "end") -> DataFrame:
    """(day, columns of intervals): every day with every interval that holds it, both ends included."""
    a, b = F.unix_date(start), F.unix_date(end)
    level = F.greatest(F.ceil(F.log2((b - a + 1) / 4.0)), F.lit(0)).cast("int")
    bins = F.sequence(F.expr(f"shiftright(unix_date(`{start}`), _level)"), F.expr(f"shiftright(unix_date(`{end}`), _level)"))
    cut = intervals.filter(F.col(start) <= F.col(end)).withColumn("_level", level).withColumn("_bin", F.explode(bins))
    spots = F.transform(F.sequence(F.lit(0), F.lit(WIDTHS - 1)), lambda k: F.struct(
        k.alias("_level"), F.call_function("shiftright", F.unix_date(F.col(day)), k).alias("_bin")))
    asked = days.select(F.col(day)).distinct().filter(F.col(day).isNotNull()).select(day, F.inline(spots))
    return asked.join(cut, ["_level", "_bin"]).filter(F.col(day).between(F.col(start), F.col(end))).drop("_level", "_bin")


def within(rows: DataFrame, intervals: DataFrame, keep: Sequence[str], day: str = "date", start: str = "start", end: str = "end") -> DataFrame:
    """One copy of a row for every interval its day falls in, with the ``keep`` columns of it.

    Only distinct days are matched; rows take their pairs by an equality join on the day.
    """
    return rows.join(day_pairs(rows, intervals, day, start, end).select(day, *keep), day)
