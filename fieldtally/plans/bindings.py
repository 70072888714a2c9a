"""The star-schema test tables seen as trips, order sequences and baskets.

The operators take column names, so most queries bind them to these tables
directly.  The staged models need the raw trip and order tables; the functions
here derive them, without dropping a row:

* a trip is an event: its user is the pickup location, ``k`` of its
  properties the dropoff location, and both come from the customer table;
* an order is an order; its number and gap come from its customer's history,
  and each customer's last order is held out, as 'test' while still open and
  as 'train' otherwise;
* an item is a line; it is a reorder if the customer had the part before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions import columns as C
from fieldtally.operators.ordering import sequence_within
from fieldtally.sources import schemas
from fieldtally.sources.readers import to_contract

# Gaps between orders here are months, not days: cap and tier edges to match.
GAP_CAP = 365
GAP_TIERS = {
    "cap": GAP_CAP,
    "tiers": ((270, "D: 270-364 days"), (180, "C: 180-269 days"), (90, "B: 90-179 days")),
    "censored": "E: 365+ days (censored, at-risk)",
    "recent": "A: 0-89 days (very recent)",
}

# The month of events, its policy date and the windows around it.
SCOPE = ("2024-01-03", "2024-01-29")
POLICY = "2024-01-15"
PRE_PERIOD = ("2024-01-01", "2024-01-14")
HOLIDAYS = ("2024-01-09", "2024-01-11")
TRANSITION = ("2024-01-13", "2024-01-18")
REFERENCE_WEEK = -2

# Regions in the role of boroughs, and fee incidence that splits the core one.
CORE_AREAS = ("AMERICA",)
OUTER_AREAS = ("AFRICA", "ASIA", "EUROPE")
TREAT_AT, BORDER_AT = 42.0, 38.0

# Units here are busier or quieter than zones: ask for more days to have any to drop.
PRESENCE = 0.9

# Purchases a product needs for the leaderboard (64 product names share all lines).
LEADERBOARD_FLOOR = 900


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(c: Column) -> Column:
    return F.expr("interval '1' second") * c


def trips(events: DataFrame) -> DataFrame:
    """Events as raw trips, with every irregularity the models have to cope with.

    Durations can be 0 or negative and disagree with the timestamps, pay can be
    negative, one licence pair has no company name, and a fee or a flag can be
    missing.
    """
    kind, value, ts = F.col("event_type"), F.col("value"), F.col("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    raw = events.withColumn("k", k)
    k = F.col("k")
    lit = F.lit
    return to_contract(raw.select(
        F.when(kind.isin("view", "click"), "HV0003").when(kind == "purchase", "HV0005")
        .when(kind == "signup", "HV0002").otherwise("HV0004").alias("hvfhs_license_num"),
        kind.alias("dispatching_base_num"),
        (ts - _seconds(k * 7 + 60)).alias("request_datetime"),
        (ts - _seconds(value)).alias("on_scene_datetime"),
        ts.alias("pickup_datetime"),
        (ts + _seconds(value + k * 60 - 60)).alias("dropoff_datetime"),
        F.col("user_id").alias("PULocationID"),
        k.alias("DOLocationID"),
        (value / 10).alias("trip_miles"),
        (k * 60 - 60).alias("trip_time"),
        value.alias("base_passenger_fare"),
        F.when(k > 80, 6.5).otherwise(0.0).alias("tolls"),
        lit(0.25).alias("bcf"),
        (k * lit(0.05)).alias("sales_tax"),
        F.when(kind == "purchase", 2.75).otherwise(0.0).alias("congestion_surcharge"),
        F.when(kind != "error", 0.0).alias("airport_fee"),
        (k * lit(0.1)).alias("tips"),
        (value - k * lit(0.01)).alias("driver_pay"),
        F.when(kind == "click", lit("Y")).when(kind != "error", lit("N")).alias("shared_request_flag"),
        F.when((kind == "click") & (k < 50), lit("Y")).when((kind == "purchase") & (k < 3), lit("Y"))
        .otherwise(lit("N")).alias("shared_match_flag"),
        F.when(kind.isin("click", "purchase"), 1.5).when(kind != "signup", 0.0).alias("cbd_congestion_fee"),
    ), schemas.TRIPS)


def zones(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Customers as locations: region, nation and segment.  Many locations share a zone name."""
    area = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    placed = customer.join(area, F.col("c_nationkey") == F.col("n_nationkey"))
    return placed.select(
        F.col("c_custkey").alias("LocationID"), F.col("r_name").alias("Borough"), F.col("n_name").alias("Zone"),
        F.col("c_mktsegment").alias("service_zone"))


def orders(raw: DataFrame) -> DataFrame:
    """Orders with their number, capped gap and held-out set in their customer's sequence."""
    slim = raw.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").alias("_at"))
    placed = sequence_within(
        slim, ["o_custkey"], [F.col("_at").asc(), F.col("o_orderkey").asc()],
        number="order_number", previous={"_before": "_at"}, last="_last")
    gap = F.datediff(F.to_date("_at"), F.to_date("_before"))
    held_out = F.when(F.col("o_orderstatus") == "O", "test").otherwise("train")
    return placed.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("_last"), held_out).otherwise("prior").alias("eval_set"),
        F.col("order_number").cast("int").alias("order_number"),
        (F.dayofweek("_at") - 1).alias("order_dow"),
        F.hour("_at").alias("order_hour_of_day"),
        F.when(gap.isNotNull(), F.least(gap, F.lit(GAP_CAP))).cast("double").alias("days_since_prior_order"),
    )


def items(lineitem: DataFrame, placed_orders: DataFrame) -> DataFrame:
    """Lines with their order's context and set, and whether the user had the part before."""
    context = placed_orders.select(
        F.col("order_id").alias("l_orderkey"), "user_id", "order_number", "order_dow", "order_hour_of_day",
        "days_since_prior_order",
        F.when(F.col("eval_set") == "prior", "prior").otherwise("train").alias("source_eval_set"))
    lines = lineitem.select("l_orderkey", F.col("l_partkey").alias("product_id"), "l_linenumber").join(
        context, "l_orderkey").withColumns({"_u": _never_null("user_id"), "_p": _never_null("product_id")})
    # First purchase by aggregation and join: unlike a window over (user, part)
    # it combines before the shuffle, and a skewed pair can still be split.
    # Keys that cannot be null get no null filter, so both sides of the join
    # read the same rows and share their shuffles; and the outer join to unique
    # keys vanishes from plans that do not ask for ``reordered``.
    first = lines.groupBy("_u", "_p").agg(F.min("order_number").alias("_first"))
    return lines.join(first, ["_u", "_p"], "left").select(
        F.col("l_orderkey").alias("order_id"), "product_id",
        F.col("l_linenumber").alias("add_to_cart_order"),
        C.indicator(F.col("order_number") > F.col("_first")).alias("reordered"),
        "source_eval_set", "user_id", "order_number", "order_dow", "order_hour_of_day", "days_since_prior_order",
    )


def _never_null(key: str) -> Column:
    return F.coalesce(key, F.lit(-(2**63)).cast("bigint"))  # no table has this key


def products(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("aisle_id"), F.col("p_type").alias("department_id"))


def aisles(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_brand").alias("aisle_id")).distinct().withColumn("aisle", F.col("aisle_id"))


def departments(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_type").alias("department_id")).distinct().withColumn(
        "department", F.col("department_id"))
