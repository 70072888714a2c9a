"""Column expressions shared by the operators.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation and, where they are predicates on a bare column, reach the
Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date, datetime
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = str | date | datetime


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(value: Moment) -> Column:
    """A zone-less timestamp literal, so comparisons keep the column bare."""
    return F.to_timestamp_ntz(F.lit(str(value)))


def day(value: Moment) -> Column:
    return F.to_date(F.lit(str(value)))


def within(c: str | Column, start: Moment | None, end: Moment | None) -> Column:
    """Half-open range ``start <= c < end``; an open side is None."""
    c = as_column(c)
    tests = []
    if start is not None:
        tests.append(c >= moment(start))
    if end is not None:
        tests.append(c < moment(end))
    return reduce(lambda a, b: a & b, tests, F.lit(True)) if tests else F.lit(True)


def outside_days(c: str | Column, first: Moment, last: Moment) -> Column:
    """True for dates not in the closed window [first, last]."""
    return ~as_column(c).between(day(first), day(last))


def yes_flag(c: str | Column) -> Column:
    """Y/N text to boolean; NULL stays NULL."""
    return as_column(c) == F.lit("Y")


def count_where(predicate: Column) -> Column:
    """Rows where the predicate holds, NULL counting as not; NULL on empty input."""
    return F.sum(F.when(predicate, F.lit(1)).otherwise(F.lit(0)))


def labelled(c: str | Column, labels: Mapping[str, str]) -> Column:
    """Code to label; a code without a label gives NULL."""
    c = as_column(c)
    out = F
    for code, text in labels.items():
        out = out.when(c == F.lit(code), F.lit(text))
    return out


def tiered(c: str | Column, steps: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """First matching step wins; NULL matches none and lands in ``otherwise``."""
    out = F
    for test, text in steps:
        out = out.when(test, F.lit(text))
    return out.otherwise(F.lit(otherwise))


def weekday_name(c: str | Column) -> Column:
    """Full English weekday name of a timestamp or date."""
    return F.date_format(F.to_date(as_column(c)), "EEEE")


def is_weekend(c: str | Column) -> Column:
    return F.dayofweek(F.to_date(as_column(c))).isin(1, 7)


def day_type(c: str | Column) -> Column:
    """'weekend' or 'weekday'; a missing timestamp counts as weekday."""
    return F.when(is_weekend(c), F.lit("weekend")).otherwise(F.lit("weekday"))


def _whole_seconds(c: Column) -> Column:
    # Built from the clock fields of a zone-less timestamp, which never consult
    # the session zone: local times inside a daylight-saving gap stay as written.
    days = F.unix_date(F.to_date(c)).cast("bigint")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def elapsed_seconds(start: str | Column, end: str | Column) -> Column:
    """Second boundaries crossed between two timestamps (not elapsed time truncated)."""
    start = as_column(start).cast("timestamp_ntz")
    end = as_column(end).cast("timestamp_ntz")
    return _whole_seconds(end) - _whole_seconds(start)


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """Double division giving NULL where the denominator is zero.

    Written as a plain condition: ``nullif`` would add a projection of its
    own, which keeps a sort and limit below it from becoming a top-k.
    """
    return F.when(denominator != F.lit(0), numerator.cast("double") / denominator.cast("double"))


def percent(numerator: Column, denominator: Column, digits: int | None = 2) -> Column:
    value = F.when(denominator != F.lit(0),
                   F.lit(100.0) * numerator.cast("double") / denominator.cast("double"))
    return value if digits is None else F.round(value, digits)


def row_total(columns: Iterable[str | Column]) -> Column:
    """Row-wise sum in which one NULL makes the whole sum NULL."""
    return reduce(add, [as_column(c) for c in columns])


def weeks_since(c: str | Column, start: Moment) -> Column:
    """Whole weeks from ``start``, floored, so the day before it is week -1."""
    return F.floor(F.datediff(as_column(c), day(start)) / F.lit(7)).cast("int")


def indicator(predicate: Column) -> Column:
    return F.when(predicate, F.lit(1)).otherwise(F.lit(0))


def percent_change(log_effect: Column) -> Column:
    """Log points to percent."""
    return F.lit(100.0) * (F.exp(log_effect) - F.lit(1.0))
