"""Calendar expressions shared by the time-window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def months_before(when: Column, months: int) -> Column:
    """Calendar subtraction with end-of-month clamping; keeps the time of day."""
    return when - F.make_interval(months=F.lit(months))


def as_moment(when: Column) -> Column:
    return when.cast("timestamp_ntz")


def day_of(when: Column) -> Column:
    """Midnight of the day, as a zone-free timestamp."""
    return F.date_trunc("day", when).cast("timestamp_ntz")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def from_year(column: str, first_year: int) -> Column:
    """``year(column) >= first_year`` as a range on the raw column, which reaches the scan."""
    return F.col(column) >= F.lit(f"{first_year}-01-01").cast("timestamp_ntz")


def year_range(column: str, first_year: int, last_year: int | None = None) -> Column:
    last = first_year if last_year is None else last_year
    upper = F.col(column) < F.lit(f"{last + 1}-01-01").cast("timestamp_ntz")
    return from_year(column, first_year) & upper


def between_days(column: str, start, end) -> Column:
    """Half-open ``[start, end)`` on the raw column."""
    low, high = (F.lit(str(v)).cast("timestamp_ntz") for v in (start, end))
    return (F.col(column) >= low) & (F.col(column) < high)


def quarter_dummies(df: DataFrame, date_column: str) -> DataFrame:
    """One 0/1 column per calendar quarter."""
    quarter = F.quarter(date_column)
    return df.withColumns({f"q{k}": F.when(quarter == k, 1).otherwise(0) for k in range(1, 5)})


def month_index(when: Column, first_year: int, months: int) -> Column:
    """Months since January of ``first_year``, clamped to ``[0, months - 1]``."""
    raw = (F.year(when) - first_year) * 12 + F.month(when) - 1
    return F.least(F.greatest(raw, F.lit(0)), F.lit(months - 1))


def timestamp_from_parts(year: str, month: str, day: str, hour: str, minute: str | None = None) -> Column:
    """Zone-free timestamp from part columns of any castable type; null when a part is bad."""
    parts = [F.expr(f"try_cast(trim({c}) AS INT)") if c else F.lit(0) for c in (year, month, day, hour, minute)]
    return F.try_make_timestamp_ntz(*parts, F.lit(0).cast("decimal(16,6)"))
