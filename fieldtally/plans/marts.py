"""Analysis-ready tables built from the enriched facts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import columns as C
from fieldtally.operators import cohorts, demand
from fieldtally.session import cut_lineage


def trip_sums() -> list[Column]:
    """What the trip marts add up; the results of parts can be added up again by ``added_sums``."""
    return [
        F.count(F.lit(1)).alias("trip_count"),
        C.count_where(F.col("provider_name") == "Uber").alias("uber_trip_count"),
        C.count_where(F.col("provider_name") == "Lyft").alias("lyft_trip_count"),
        C.count_where(F.col("is_shared_request")).alias("shared_request_count"),
        C.count_where(F.col("is_shared_match")).alias("shared_match_count"),
        C.count_where(F.col("is_cbd_fee_trip")).alias("cbd_fee_trip_count"),
        F.sum("driver_pay").alias("total_driver_pay"),
        F.sum("base_passenger_fare").alias("total_base_fare"),
    ]


_SUMS = ("trip_count", "uber_trip_count", "lyft_trip_count", "shared_request_count", "shared_match_count",
         "cbd_fee_trip_count", "total_driver_pay", "total_base_fare")


def daily_trip_summary(trips: DataFrame) -> DataFrame:
    """One row per date: volumes, flags, economics and the trailing seven-row mean."""
    return _daily(trips.groupBy("trip_date").agg(*trip_sums()))


def daily_of_cells(cells: DataFrame) -> DataFrame:
    """The same from sums by any finer grouping."""
    return _daily(cells.groupBy("trip_date").agg(*[F.sum(c).alias(c) for c in _SUMS]))


def _daily(sums: DataFrame) -> DataFrame:
    daily = sums.select(
        "trip_date",
        C.weekday_name("trip_date").alias("day_of_week"),
        C.day_type("trip_date").alias("day_type"),
        *_SUMS,
        C.percent(F.col("total_driver_pay"), F.col("total_base_fare")).alias("driver_share_of_fare_pct"),
    )
    return demand.rolling_mean(daily, "trip_date", "trip_count", out="rolling_7d_avg_trips")


def hourly_demand(trips: DataFrame) -> DataFrame:
    """One row per hour of day and day type.  Days are counted from one row per day and hour."""
    return hourly_of_cells(trips.groupBy("hour_of_day", "day_type", "trip_date").agg(
        F.count(F.lit(1)).alias("trip_count"), F.sum("driver_pay").alias("total_driver_pay"),
        F.sum("base_passenger_fare").alias("total_base_fare")))


def hourly_of_cells(cells: DataFrame) -> DataFrame:
    """The same from one row per hour, day type and date."""
    return cells.groupBy("hour_of_day", "day_type").agg(
        F.sum("trip_count").alias("trip_count"),
        F.count("trip_date").alias("n_days"),
        F.sum("total_driver_pay").alias("total_driver_pay"),
        F.sum("total_base_fare").alias("total_base_fare"),
    ).select(
        "hour_of_day", "day_type", "trip_count", "n_days",
        F.round(C.guarded_ratio(F.col("trip_count"), F.col("n_days"))).alias("avg_trips_per_hour"),
        "total_driver_pay", "total_base_fare",
        C.percent(F.col("total_driver_pay"), F.col("total_base_fare")).alias("driver_share_of_fare_pct"),
    )


def user_rfm(orders: DataFrame, items: DataFrame, tier: Mapping | None = None) -> DataFrame:
    """One row per user; a user without prior items has a volume of zero."""
    volume = items.where(F.col("source_eval_set") == "prior").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_items"))
    return cohorts.recency_frequency(orders).join(volume, "user_id", "left").select(
        "user_id",
        F.col("total_orders").alias("frequency"),
        "recency_days",
        cohorts.recency_tier("recency_days", **dict(tier or {})).alias("recency_tier"),
        F.coalesce("_items", F.lit(0)).alias("monetary_proxy_items"),
    )


def order_sequence_summary(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per order number: retention, reorder rate and mean running volume.

    Items are read once, down to one row per order, which gives both the
    reorder rate and the running volume.
    """
    per_order = cut_lineage(items.groupBy("user_id", "order_number", "source_eval_set").agg(
        F.count(F.lit(1)).alias("_n"), C.count_where(F.col("is_reordered")).alias("_r")))
    rates = per_order.groupBy("order_number").agg(F.sum("_n").alias("total_items"), F.sum("_r").alias("_r")).select(
        "order_number", "total_items",
        C.percent(F.col("_r"), F.col("total_items")).alias("reorder_rate_pct"))
    volume = cohorts.mean_running_count(per_order.where(F.col("source_eval_set") == "prior"), "_n")
    return (
        cohorts.sequence_retention(orders)
        .join(rates, "order_number", "left")
        .join(volume, "order_number", "left")
        .withColumn("avg_cumulative_items_prior", F.round("avg_cumulative_items_prior", 1))
    )


def _share(items: DataFrame, label: str, total: str) -> DataFrame:
    return items.groupBy(label).agg(
        F.count(F.lit(1)).alias(total), C.count_where(F.col("is_reordered")).alias("_r"))


def department_basket_composition(items: DataFrame) -> DataFrame:
    """Every department with its share of all items and its reorder rate."""
    counted = cut_lineage(_share(items, "department", "total_items"))  # items are read once, for rows and total
    everything = counted.agg(F.sum("total_items")).scalar()
    return counted.select(
        "department", "total_items",
        C.percent(F.col("total_items"), everything).alias("pct_of_all_items"),
        C.percent(F.col("_r"), F.col("total_items")).alias("reorder_rate_pct"),
    )


def product_reorder_leaderboard(items: DataFrame, floor: int = 1000) -> DataFrame:
    """Every product bought at least ``floor`` times with its reorder rate."""
    return _share(items, "product_name", "total_purchases").where(F.col("total_purchases") >= floor).select(
        "product_name", "total_purchases",
        C.percent(F.col("_r"), F.col("total_purchases")).alias("reorder_rate_pct"),
    )
