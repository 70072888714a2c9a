"""Marts and distinct counts from stored monthly partials."""

import shutil

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import cohorts, distinct
from fieldtally.plans import bindings as B
from fieldtally.plans import enriched, marts, queries, refresh, staging
from fieldtally.sources import writers


@pytest.fixture(scope="module")
def trips(spark, sf):
    """Enriched trips of three months."""
    raw = staging.trips(B.trips(queries._months_of_events(spark, sf)))
    return enriched.trips_enriched(raw, staging.zones(queries._zones(spark, sf)), B.SCOPE[0], "2025-01-01")


def equal(a, b):
    rounded = lambda df: df.withColumns({c: F.round(c, 6) for c in ("total_driver_pay", "total_base_fare")})
    a, b = rounded(a), rounded(b).select(*a.columns)
    return a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_marts_of_cells_equal_the_full_build_and_read_new_months_only(spark, trips, folder):
    fact, cells = f"{folder}/fact", f"{folder}/cells"
    months = writers.months_of(trips, "pickup_datetime")
    assert len(months) >= 3
    writers.load_months(trips, fact, "pickup_datetime", months[:1])
    assert refresh.refresh(spark, fact, cells, refresh.trip_cells) == months[:1]
    writers.load_months(trips, fact, "pickup_datetime", months)
    new = refresh.rows_of_months(spark, fact, months[1:])
    scan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and {f.split("month=")[1][:7] for f in _files(new)} == set(months[1:])
    shutil.rmtree(f"{fact}/month={months[0]}")  # a month already reduced is not looked at again
    assert refresh.refresh(spark, fact, cells, refresh.trip_cells) == months[1:]
    assert refresh.refresh(spark, fact, cells, refresh.trip_cells) == []
    assert equal(refresh.daily_trip_summary(spark, cells), marts.daily_trip_summary(trips))
    assert equal(refresh.hourly_demand(spark, cells), marts.hourly_demand(trips))


def _files(df):
    return [r[0] for r in df.select(F.input_file_name()).distinct().collect()]


def test_a_month_delivered_again_is_reduced_anew(spark, trips, folder):
    fact, cells = f"{folder}/fact", f"{folder}/cells"
    months = writers.months_of(trips, "pickup_datetime")[:2]
    writers.load_months(trips, fact, "pickup_datetime", months)
    refresh.refresh(spark, fact, cells, refresh.trip_cells)
    doubled = trips.unionByName(trips.where(F.date_format("pickup_datetime", "yyyy-MM") == months[1]))
    writers.load_months(doubled, fact, "pickup_datetime", months[1:], force=True)
    assert refresh.refresh(spark, fact, cells, refresh.trip_cells, again=[months[1], "1999-01"]) == months[1:]
    inside = F.date_format("pickup_datetime", "yyyy-MM").isin(months)
    assert equal(refresh.daily_trip_summary(spark, cells), marts.daily_trip_summary(doubled.where(inside)))


def test_rows_without_a_month_have_partials_too(spark, folder):
    rows = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-01-06"), (2, None), (3, None), (None, None)], "u int, d string").select(
        "u", F.to_timestamp_ntz("d").alias("t"))
    writers.load_months(rows, f"{folder}/fact", "t", ["2024-01", None])
    assert refresh.refresh(spark, f"{folder}/fact", f"{folder}/s", refresh.user_sketches("u")) == ["2024-01", None]
    stored = spark.read.parquet(f"{folder}/s")
    found = {r.month: r.n for r in distinct.estimates(stored.withColumn("month", F.col("month").cast("string")), "n").collect()}
    assert found == {"2024-01": 2, None: 2}
    assert distinct.estimates(distinct.merged(stored), "n").first().n == 3
    assert refresh.refresh(spark, f"{folder}/fact", f"{folder}/s", refresh.user_sketches("u")) == []


@pytest.mark.parametrize("n", [1, 100, 5_000, 300_000])
def test_merged_sketches_stay_within_the_bound(spark, n):
    """Values that overlap between parts, and a value that a third of all rows hold."""
    rows = spark.range(2 * n).select((F.col("id") % 7).alias("part"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % n).alias("v"))
    parts = distinct.sketches(rows, ["part"], "v")
    exact = {r.part: r.n for r in rows.groupBy("part").agg(F.countDistinct("v").alias("n")).collect()}
    bound = 3 * distinct.standard_error()
    for r in distinct.estimates(parts, "n").collect():
        assert abs(r.n - exact[r.part]) <= bound * exact[r.part]
    total = rows.agg(F.countDistinct("v")).first()[0]
    assert abs(distinct.estimates(distinct.merged(parts), "n").first().n - total) <= bound * total


def test_approximate_counts_are_an_option(spark):
    orders = spark.range(40_000).select((F.col("id") % 9000).alias("user_id"), (F.col("id") % 3).cast("int").alias("order_number"))
    exact = {r.order_number: r.n_users_reaching for r in cohorts.sequence_retention(orders).collect()}
    assert exact == {r.order_number: r.n for r in orders.groupBy("order_number").agg(F.countDistinct("user_id").alias("n")).collect()}
    near = {r.order_number: r.n_users_reaching for r in cohorts.sequence_retention(orders, approximate=0.02).collect()}
    assert all(abs(near[k] - exact[k]) <= 0.06 * exact[k] for k in exact)
