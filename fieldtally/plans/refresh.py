"""Marts kept up to date from new months only.

A fact partitioned by month is reduced to partial rows that can be added up: cells of
date, hour and day type for the trip marts, sketches for distinct counts.  Partials are
stored by month; a refresh reads the fact's folders of months that have none yet, and
marts are made from the partials, whose number depends on the calendar alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.operators import distinct
from fieldtally.plans import marts
from fieldtally.sources import writers

Partial = Callable[[DataFrame], DataFrame]


def rows_of_months(spark: SparkSession, path: str, months: Sequence[str | None]) -> DataFrame:
    """Rows of a table partitioned by month; folders of other months are not opened. None means rows without a month."""
    month = F.col("month")
    named = [m for m in months if m is not None]
    wanted = month.cast("string").isin(named) if named else F.lit(False)
    return spark.read.parquet(path).where(wanted | month.isNull() if None in months else wanted)


def refresh(spark: SparkSession, fact: str, stored: str, partial: Partial, *,
            again: Sequence[str | None] = ()) -> list[str | None]:
    """Bring the partials in ``stored`` up to date with the months of ``fact``; returns the months read.

    ``partial`` reduces fact rows to rows that keep ``month``.  Months named in ``again`` are
    reduced anew.  Only the folders of these months are replaced, each when its rows are
    complete, so a refresh that failed is simply run again.
    """
    have = writers.months_present(spark, fact)
    todo = sorted((have - writers.months_present(spark, stored)) | (have & set(again)), key=lambda m: (m is None, m))
    if todo:
        (partial(rows_of_months(spark, fact, todo)).withColumn("month", F.col("month").cast("string"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(stored))
    return todo


def trip_cells(trips: DataFrame) -> DataFrame:
    """Partial rows of the daily and the hourly mart: one a month, date, hour and day type."""
    return trips.groupBy("month", "trip_date", "hour_of_day", "day_type").agg(*marts.trip_sums())


def user_sketches(column: str) -> Partial:
    """Partial rows of a distinct count: one sketch a month."""
    return lambda rows: distinct.sketches(rows, ["month"], column)


def daily_trip_summary(spark: SparkSession, cells: str) -> DataFrame:
    """The daily mart from stored cells, equal to the one built from all trips."""
    return marts.daily_of_cells(spark.read.parquet(cells))


def hourly_demand(spark: SparkSession, cells: str) -> DataFrame:
    """The hourly mart from stored cells."""
    return marts.hourly_of_cells(spark.read.parquet(cells))
