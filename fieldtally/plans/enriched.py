"""Reusable derivations at the grain of the facts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import columns as C
from fieldtally.operators import joins

# Licence codes and company names.
COMPANIES = {"HV0003": "Uber", "HV0005": "Lyft"}

# The columns of the source that the enriched trips keep.
_KEPT = (
    "hvfhs_license_num", "dispatching_base_num",
    "request_datetime", "on_scene_datetime", "pickup_datetime", "dropoff_datetime",
    "pickup_location_id", "dropoff_location_id", "trip_miles", "trip_time",
    "base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge", "airport_fee", "tips",
    "driver_pay", "cbd_congestion_fee",
)


def trips_enriched(trips: DataFrame, zones: DataFrame, start: C.Moment | None = None, end: C.Moment | None = None,
                   companies: Mapping[str, str] = COMPANIES, *, broadcast_rows: int = joins.BROADCAST_ROWS) -> DataFrame:
    """Trips picked up in [start, end) with company, both zones, calendar buckets and waiting intervals.

    The zone table plays two roles.  It is counted once: up to ``broadcast_rows`` rows it is
    broadcast, and beyond that the zones with a large share of the trips are spread over tasks.
    """
    pickup = zones.select(F.col("location_id").alias("pickup_location_id"), F.col("zone").alias("pickup_zone"),
                          F.col("borough").alias("pickup_borough"))
    dropoff = zones.select(F.col("location_id").alias("dropoff_location_id"), F.col("zone").alias("dropoff_zone"),
                           F.col("borough").alias("dropoff_borough"))
    scoped = trips.where(C.within("pickup_datetime", start, end))
    if joins.has_few_rows(zones, broadcast_rows):
        placed = scoped.join(F.broadcast(pickup), "pickup_location_id").join(F.broadcast(dropoff), "dropoff_location_id")
    else:
        slim = scoped.select(*_KEPT, "shared_request_flag", "shared_match_flag")  # what a piece carries through the shuffles
        by_dropoff = joins.heavy_keys(scoped, ["dropoff_location_id"])
        placed = joins.spread_join(joins.spread_join(slim, pickup, ["pickup_location_id"]), dropoff,
                                   ["dropoff_location_id"], heavy=by_dropoff)
    return placed.select(
        *_KEPT,
        C.labelled("hvfhs_license_num", companies).alias("provider_name"),
        "pickup_zone", "pickup_borough", "dropoff_zone", "dropoff_borough",
        F.to_date("pickup_datetime").alias("trip_date"),
        C.weekday_name("pickup_datetime").alias("day_of_week"),
        C.day_type("pickup_datetime").alias("day_type"),
        F.hour("pickup_datetime").cast("bigint").alias("hour_of_day"),
        C.elapsed_seconds("request_datetime", "pickup_datetime").alias("wait_time_sec"),
        C.elapsed_seconds("request_datetime", "on_scene_datetime").alias("approach_time_sec"),
        C.elapsed_seconds("on_scene_datetime", "pickup_datetime").alias("dwell_time_sec"),
        C.yes_flag("shared_request_flag").alias("is_shared_request"),
        C.yes_flag("shared_match_flag").alias("is_shared_match"),
        (F.col("cbd_congestion_fee") > 0).alias("is_cbd_fee_trip"),
    )


def tagged_items(prior: DataFrame, train: DataFrame) -> DataFrame:
    """Both item sets as one table that remembers where each row came from."""
    return prior.withColumn("source_eval_set", F.lit("prior")).unionByName(
        train.withColumn("source_eval_set", F.lit("train")))


def order_products_enriched(items: DataFrame, products: DataFrame, aisles: DataFrame, departments: DataFrame,
                            orders: DataFrame | None = None) -> DataFrame:
    """Every tagged item with product, aisle, department and order context.

    Names are joined to the product table first, so items meet one product
    dimension and the order table instead of three dimensions in turn.
    Without ``orders`` the items carry their order's columns already, and the
    fact is not shuffled by order again.
    """
    catalogue = products.join(aisles, "aisle_id").join(departments, "department_id")
    placed = items.join(catalogue, "product_id")
    if orders is not None:
        placed = placed.join(orders.select("order_id", "user_id", "order_number", "order_dow", "order_hour_of_day",
                                           "days_since_prior_order"), "order_id")
    return placed.select(
        "order_id", "product_id", "add_to_cart_order", "is_reordered", "source_eval_set",
        "product_name", "aisle_id", "aisle", "department_id", "department",
        "user_id", "order_number", "order_dow", "order_hour_of_day", "days_since_prior_order",
    )
