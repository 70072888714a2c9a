"""Data-quality checks that all return (check, table_name, column_name, failures, status).

Checks on one table that only look at single rows share one pass over it.
Checks on keys aggregate to the key first, so a key with very many rows is
combined before the shuffle.

``run`` answers any number of checks on any number of tables at once: each table
is read once, as a stream of (check, key) entries, and one aggregation by check and
key, then one by check, gives all failures.  The functions ``expect_...`` declare
what it takes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import columns as C


def _verdict(failures: Column, warn_above: int = 0, error_above: int = 0) -> Column:
    return (
        F.when(failures > error_above, "error").when(failures > warn_above, "warn").otherwise("pass")
    )


def _result(failures: DataFrame, check: str, table: str, column: str) -> DataFrame:
    n = F.coalesce(F.col("failures"), F.lit(0)).cast("bigint")
    return failures.select(
        F.lit(check).alias("check"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
        n.alias("failures"), _verdict(n).alias("status"))


def row_checks(df: DataFrame, table: str, *, not_null: Sequence[str] = (),
               accepted: Mapping[str, Sequence] | None = None,
               thresholds: Mapping[str, tuple[Column, int, int]] | None = None) -> DataFrame:
    """All checks of a table that look at one row at a time, counted in one pass.

    ``not_null``: rows missing a value.  ``accepted``: rows holding a value
    outside the list; a missing value passes.  ``thresholds``: column to
    (condition, warn above, error above).
    """
    tests = [("not_null", c, F.col(c).isNull(), 0, 0) for c in not_null]
    tests += [("accepted_values", c, ~F.col(c).isin(list(v)), 0, 0) for c, v in (accepted or {}).items()]
    tests += [("threshold", c, *limits) for c, limits in (thresholds or {}).items()]
    counted = df.agg(*[F.count(F.when(t[2], F.lit(1))).alias(f"_{i}") for i, t in enumerate(tests)])
    rows = [
        F.struct(F.lit(check).alias("check"), F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                 F.col(f"_{i}").alias("failures"), _verdict(F.col(f"_{i}"), warn, error).alias("status"))
        for i, (check, c, _, warn, error) in enumerate(tests)
    ]
    return counted.select(F.inline(F.array(*rows)))


def not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Rows missing a value, per column."""
    return row_checks(df, table, not_null=columns)


def accepted_values(df: DataFrame, table: str, accepted: Mapping[str, Sequence]) -> DataFrame:
    """Rows holding a value outside the list, per column; a missing value passes."""
    return row_checks(df, table, accepted=accepted)


def threshold(df: DataFrame, table: str, column: str, bad: Column, *, warn_above: int = 0,
              error_above: int = 20) -> DataFrame:
    """Rows meeting a condition, tolerated with a warning up to a known number."""
    return row_checks(df, table, thresholds={column: (bad, warn_above, error_above)})


def unique(df: DataFrame, table: str, column: str) -> DataFrame:
    """Values occurring more than once; missing values are ignored."""
    return _result(_repeated(df.where(F.col(column).isNotNull()), [column]), "unique", table, column)


def unique_combination(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Combinations occurring more than once."""
    return _result(_repeated(df, columns), "unique_combination", table, ",".join(columns))


def _repeated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).count().where(F.col("count") > 1).agg(F.count(F.lit(1)).alias("failures"))


def relationships(child: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key the parent lacks.  Only distinct child keys are joined."""
    keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"))
    orphans = keys.join(parent.select(F.col(parent_column).alias("_key")), "_key", "left_anti")
    return _result(orphans.agg(F.sum("_n").alias("failures")), "relationships", table, column)


def reconcile(check: str, table: str, column: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row totals that have to agree."""
    both = left.select(F.col(left.columns[0]).alias("_l")).withColumn("_r", right.scalar())
    differs = C.indicator(~F.col("_l").eqNullSafe(F.col("_r"))).alias("failures")
    return _result(both.select(differs), check, table, column)


def partition_identity(df: DataFrame, table: str, unit: str, column: str, parts: Sequence[str]) -> DataFrame:
    """Units having each part add up to all units, so every unit has exactly one of them.

    Failures are the difference between the two numbers.
    """
    per_unit = df.groupBy(unit).agg(*[
        F.max(F.when(F.col(column) == p, F.lit(1)).otherwise(F.lit(0))).alias(f"_{i}") for i, p in enumerate(parts)])
    held = reduce(lambda a, b: a + b, [F.col(f"_{i}") for i in range(len(parts))])
    gap = per_unit.where(F.col(unit).isNotNull()).agg(F.abs(F.sum(held) - F.count(F.lit(1))).alias("failures"))
    return _result(gap, "partition_identity", table, column)


def report(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


# --- many checks in one pass ----------------------------------------------------------------

@dataclass(frozen=True)
class Feed:
    """What rows of ``table`` give to a check: ``value`` for their key, on one of two sides, where ``when`` holds."""

    table: str
    when: Column
    key: tuple[str, ...] = ()
    value: Column | None = None  # 1 without one
    other: bool = False


@dataclass(frozen=True)
class Expectation:
    check: str
    table: str
    column: str
    measure: str  # one of the keys of _MEASURES
    feeds: tuple[Feed, ...]
    warn_above: int = 0
    error_above: int = 0


#: Failures of a check from its keys, each with the sums of either side, NULL where it has no rows.
_MEASURES = {
    "rows": "sum(a)",
    "repeated keys": "count_if(a > 1)",
    "rows without other": "sum(a) FILTER (WHERE b IS NULL)",
    "unlike totals": "int(coalesce(sum(a), 0) <> coalesce(sum(b), 0))",
    "unlike numbers of keys": "abs(count(a) - count(b))",
}


def expect_not_null(table: str, column: str) -> Expectation:
    return Expectation("not_null", table, column, "rows", (Feed(table, F.col(column).isNull()),))


def expect_accepted(table: str, column: str, values: Sequence) -> Expectation:
    return Expectation("accepted_values", table, column, "rows", (Feed(table, ~F.col(column).isin(list(values))),))


def expect_within(table: str, column: str, bad: Column, warn_above: int = 0, error_above: int = 20) -> Expectation:
    return Expectation("threshold", table, column, "rows", (Feed(table, bad),), warn_above, error_above)


def expect_unique(table: str, column: str) -> Expectation:
    return Expectation("unique", table, column, "repeated keys", (Feed(table, F.col(column).isNotNull(), (column,)),))


def expect_unique_together(table: str, columns: Sequence[str]) -> Expectation:
    """Missing values count as values, as in ``unique_combination``."""
    return Expectation("unique_combination", table, ",".join(columns), "repeated keys",
                       (Feed(table, F.lit(True), tuple(columns)),))


def expect_known(table: str, column: str, parent: str, parent_column: str) -> Expectation:
    return Expectation("relationships", table, column, "rows without other", (
        Feed(table, F.col(column).isNotNull(), (column,)),
        Feed(parent, F.col(parent_column).isNotNull(), (parent_column,), other=True)))


def expect_same_total(check: str, table: str, column: str, left: tuple[str, Column, Column | None],
                      right: tuple[str, Column, Column | None]) -> Expectation:
    """Two sums of whole numbers that have to agree; a side is (table, condition, value or None for rows)."""
    return Expectation(check, table, column, "unlike totals", (
        Feed(left[0], left[1], (), left[2]), Feed(right[0], right[1], (), right[2], other=True)))


def expect_one_part(table: str, unit: str, column: str, parts: Sequence[str]) -> Expectation:
    """Pairs of unit and part have to be as many as units, so every unit has exactly one of the parts."""
    some = F.col(unit).isNotNull()
    return Expectation("partition_identity", table, column, "unlike numbers of keys", (
        Feed(table, some & F.col(column).isin(list(parts)), (unit, column)), Feed(table, some, (unit,), other=True)))


def run(expectations: Sequence[Expectation], tables: Mapping[str, DataFrame]) -> DataFrame:
    """The report of all checks whose tables are there, each table read once.

    Keys are compared as text, column by column.  A row check costs an entry only for
    rows that fail it; entries of one key are combined before the shuffle.
    """
    wanted = [e for e in expectations if all(f.table in tables for f in e.feeds)]
    streams = []
    for name, df in tables.items():
        entries = [_entry(i, f) for i, e in enumerate(wanted) for f in e.feeds if f.table == name]
        if entries:
            streams.append(df.select(F.inline(F.array_compact(F.array(*entries)))))
    spark = next(iter(tables.values())).sparkSession
    shown = spark.createDataFrame(
        [(i, e.check, e.table, e.column, e.warn_above, e.error_above) for i, e in enumerate(wanted)],
        "id int, check string, table_name string, column_name string, warn int, error int")
    if not streams:
        return shown.select("check", "table_name", "column_name", F.lit(0).cast("bigint").alias("failures"),
                            F.lit("pass").alias("status"))
    keys = reduce(DataFrame.unionByName, streams).groupBy("id", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    used = sorted({e.measure for e in wanted})
    measured = keys.groupBy("id").agg(*[F.expr(_MEASURES[m]).cast("bigint").alias(f"_{k}") for k, m in enumerate(used)])
    failures = F.coalesce(*[F.when(F.col("id").isin([i for i, e in enumerate(wanted) if e.measure == m]), F.col(f"_{k}"))
                            for k, m in enumerate(used)], F.lit(0)).cast("bigint")
    return F.broadcast(measured).join(shown, "id", "right").select(  # one row a check
        "check", "table_name", "column_name", failures.alias("failures"),
        F.when(failures > F.col("error"), "error").when(failures > F.col("warn"), "warn").otherwise("pass").alias("status"))


def _entry(number: int, feed: Feed) -> Column:
    key = F.array(*[F.col(c).cast("string") for c in feed.key]).cast("array<string>")
    value, none = F.coalesce((F.lit(1) if feed.value is None else feed.value).cast("bigint"), F.lit(0)), F.lit(None).cast("bigint")
    a, b = (none, value) if feed.other else (value, none)
    return F.when(feed.when, F.struct(F.lit(number).alias("id"), key.alias("key"), a.alias("a"), b.alias("b")))
