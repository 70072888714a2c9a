"""Materialised tables and month-keyed incremental loads."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldtally.sources.readers import matching_files, read_parquet_by_name
from fieldtally.sources.schemas import TRIPS


def materialise(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), rows: Observation | None = None) -> DataFrame:
    """Write a table, replacing an earlier run, and return it as read back.

    The new table is written beside the old one and takes its place only when it
    is complete, so a run that fails leaves the old rows, and ``df`` may read the table
    it replaces.  ``rows`` receives the number of rows as ``row_count`` from the write
    itself.  On stores without a rename the last step copies.
    """
    if rows is not None:
        df = df.observe(rows, F.count(F.lit(1)).alias("row_count"))
    beside = f"{path.rstrip('/')}._{uuid.uuid4().hex[:12]}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    try:
        writer.parquet(beside)
        _swap(df.sparkSession, beside, path)
    finally:
        _delete(df.sparkSession, beside)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder ``new`` where ``path`` is; the old one is kept aside until then."""
    system, target = _hadoop(spark, path)
    _, source = _hadoop(spark, new)
    aside = f"{new}_old"
    _, old = _hadoop(spark, aside)
    had = system.exists(target)
    if had and not system.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not had:
        system.mkdirs(target.getParent())
    if not system.rename(source, target):
        if had:
            system.rename(old, target)
        raise OSError(f"cannot move the new table to {path}")
    _delete(spark, aside)


def _delete(spark: SparkSession, path: str) -> None:
    system, at = _hadoop(spark, path)
    if system.exists(at):
        system.delete(at, True)


_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"  # the folder Spark gives rows without a month


def months_present(spark: SparkSession, path: str) -> set[str | None]:
    """Months already loaded, from the partition folders alone; None for rows without one."""
    found = {f.rsplit("month=", 1)[1] for f in matching_files(spark, f"{path}/month=*")}
    return {None if m == _NO_MONTH else m for m in found}


def months_of(df: DataFrame, ts: str) -> list[str | None]:
    """The months that occur in ``df``, in order, None last if rows lack a month; one value a calendar month."""
    found = [r[0] for r in with_month(df, ts).select("month").distinct().collect()]
    return sorted(m for m in found if m is not None) + [None] * (None in found)


def with_month(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("month", F.date_format(F.to_date(ts), "yyyy-MM"))


def load_months(df: DataFrame, path: str, ts: str, months: Sequence[str | None], *,
                force: bool = False) -> list[str | None]:
    """Add the wanted months of ``df`` to a month-partitioned table; returns those written.

    ``None`` among the months stands for rows whose timestamp is missing.
    Months already there are skipped unless ``force``, and only the folders of
    the months written are replaced, so a rerun changes nothing.
    """
    have = set() if force else months_present(df.sparkSession, path)
    todo = [m for m in months if m not in have]
    dated = [m for m in todo if m is not None]
    if todo:
        wanted = F.col(ts).isNull() if None in todo else F.lit(False)
        if dated:
            first = F.to_date(F.lit(f"{min(dated)}-01"))
            after = F.add_months(F.to_date(F.lit(f"{max(dated)}-01")), 1)
            # The range on the bare timestamp reaches the scan; the exact months do not.
            wanted = wanted | ((F.col(ts) >= first.cast("timestamp_ntz")) & (F.col(ts) < after.cast("timestamp_ntz")))
        month = F.col("month")
        fresh = with_month(df.where(wanted), ts).where(month.isNull() | month.isin(dated) if dated else month.isNull())
        (
            fresh.hint("rebalance", F.col("month"))  # files of a sensible size, a large month in several
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("month")
            .parquet(path)
        )
    return todo


def load_month_files(spark: SparkSession, pattern: str, path: str, months: Sequence[str], *,
                     force: bool = False) -> list[str]:
    """``load_months`` for monthly trip files: ``{month}`` in the pattern names one month's file."""
    have = set() if force else months_present(spark, path)
    todo = [m for m in months if m not in have]
    for m in todo:
        fresh = read_parquet_by_name(spark, pattern.format(month=m), TRIPS).withColumn("month", F.lit(m))
        (
            fresh.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("month")
            .parquet(path)
        )
    return todo
