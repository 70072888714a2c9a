"""Every operator bound to the star-schema test tables: name -> (spark, folder) -> DataFrame.

Sums and estimates of floating-point columns are rounded here, and only here,
because their last digits depend on the order rows are added in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions import columns as C
from fieldtally.operators import cohorts, demand, distinct, joins, panel, quality, regression
from fieldtally.operators.panel import CORE_CONTROL, OUTER_CONTROL, TREATMENT
from fieldtally.plans import bindings as B
from fieldtally.plans import enriched, marts, refresh, staging
from fieldtally.session import scratch_table
from fieldtally.sources import readers, schemas, writers

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query; its dates are shown as midnight timestamps, which both engines hand over alike."""

    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        dates = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in dates})

    shown.__doc__ = fn.__doc__
    _REGISTRY[fn.__name__] = shown
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- tables the queries share -------------------------------------------------------------

def _trips(spark, d) -> DataFrame:
    return B.trips(B.table(spark, d, "events"))


def _scoped_trips(spark, d) -> DataFrame:
    return _trips(spark, d).where(C.within("pickup_datetime", *B.SCOPE))


def _zones(spark, d) -> DataFrame:
    return B.zones(B.table(spark, d, "customer"), B.table(spark, d, "nation"), B.table(spark, d, "region"))


def _orders(spark, d) -> DataFrame:
    return B.orders(B.table(spark, d, "orders"))


def _items(spark, d, orders: DataFrame | None = None) -> DataFrame:
    return B.items(B.table(spark, d, "lineitem"), orders or _orders(spark, d))


def _catalogue(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = B.table(spark, d, "part")
    return B.products(part), B.aisles(part), B.departments(part)


def _enriched_trips(spark, d) -> DataFrame:
    return enriched.trips_enriched(staging.trips(_trips(spark, d)), staging.zones(_zones(spark, d)), *B.SCOPE)


def _tagged_items(spark, d, orders: DataFrame | None = None) -> DataFrame:
    """Items as staged and tagged by set, still with the order context they were derived from."""
    return _items(spark, d, orders).withColumn("is_reordered", F.col("reordered") == 1).drop("reordered")


def _enriched_items(spark, d) -> DataFrame:
    return enriched.order_products_enriched(_tagged_items(spark, d), *_catalogue(spark, d))


def _classes(spark, d) -> DataFrame:
    return panel.incidence_classification(
        _trips(spark, d), "PULocationID", "cbd_congestion_fee", _zones(spark, d), "LocationID", area="Borough",
        core=B.CORE_AREAS, outer=B.OUTER_AREAS, treat_at=B.TREAT_AT, border_at=B.BORDER_AT, keep=["Zone"])


def _panel(spark, d) -> DataFrame:
    return panel.did_panel(
        _trips(spark, d), "pickup_datetime", "PULocationID", "base_passenger_fare", "driver_pay",
        _classes(spark, d), "LocationID", policy=B.POLICY, transition=B.TRANSITION, zone="Zone", area="Borough")


def _between(control: str):
    return F.col("zone_group").isin(TREATMENT, control)


def _no_holidays():
    return C.outside_days("trip_date", *B.HOLIDAYS)


def _series(spark, d) -> DataFrame:
    return panel.group_daily_series(_panel(spark, d), [TREATMENT, OUTER_CONTROL, CORE_CONTROL])


# --- sources and sinks --------------------------------------------------------------------

@query
def scan_union_by_name(spark, d):
    """Monthly files of different schema: the older one lacks the fee and has narrower ids."""
    trips = _trips(spark, d)
    folder = scratch_table(spark, "by_name")
    early, late = trips.where(C.within("pickup_datetime", None, B.POLICY)), trips.where(
        C.within("pickup_datetime", B.POLICY, None))
    narrow = early.drop("cbd_congestion_fee").withColumn("DOLocationID", F.col("DOLocationID").cast("int"))
    narrow.select(*reversed(narrow.columns)).write.parquet(f"{folder}/fhvhv_early.parquet")
    late.write.parquet(f"{folder}/fhvhv_late.parquet")
    both = readers.read_parquet_by_name(spark, f"{folder}/fhvhv_*.parquet", schemas.TRIPS)
    return both.select("hvfhs_license_num", "pickup_datetime", "PULocationID", "DOLocationID", "trip_time",
                       "base_passenger_fare", "cbd_congestion_fee")


@query
def scan_csv(spark, d):
    """A CSV whose hour is zero-padded text and whose gap is empty on some rows."""
    folder = scratch_table(spark, "csv")
    raw = B.table(spark, d, "events").select(
        F.col("event_id").alias("order_id"), "user_id", F.col("event_type").alias("eval_set"),
        F.dayofmonth("ts").alias("order_number"), (F.dayofweek("ts") - 1).alias("order_dow"),
        F.lpad(F.hour("ts").cast("string"), 2, "0").alias("order_hour_of_day"),
        F.when(F.col("event_type") != "signup", F.col("value")).alias("days_since_prior_order"))
    raw.write.option("header", True).csv(folder)
    return readers.read_csv(spark, folder, schemas.ORDERS)


@query
def sink_roundtrip(spark, d):
    """A mart written twice to the same table, then read back."""
    path = scratch_table(spark, "daily_summary")
    mart = marts.daily_trip_summary(_enriched_trips(spark, d))
    writers.materialise(mart, path)
    return _rounded(writers.materialise(mart, path), 2, "total_driver_pay", "total_base_fare")


@query
def table_row_counts(spark, d):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    return readers.table_row_counts({n: B.table(spark, d, n) for n in names})


@query
def incremental_month_load(spark, d):
    """Half the months, then all of them: those already there are skipped."""
    path = scratch_table(spark, "by_month")
    lines = B.table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")
    months = writers.months_of(lines, "l_shipdate")
    writers.load_months(lines, path, "l_shipdate", months[:len(months) // 2])
    writers.load_months(lines, path, "l_shipdate", months)
    loaded = spark.read.parquet(path)
    return loaded.groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("l_quantity").alias("quantity"),
        F.min(F.to_date("l_shipdate")).alias("first_day"), F.max(F.to_date("l_shipdate")).alias("last_day"))


@query
def source_registry(spark, d):
    """Sources written as the raw folder has them, with the optional group complete, then loaded by name and counted."""
    folder = _raw_folder(spark, d)
    tables = readers.load_sources(spark, folder)
    return readers.table_row_counts({name: spark.table(name) for name in tables})


@query
def missing_sources(spark, d):
    """The optional group is left out when one of its files is missing; a missing required file is an error."""
    folder = scratch_table(spark, "raw")
    _trips(spark, d).write.parquet(f"{folder}/fhvhv_2024-01.parquet")
    try:
        readers.load_sources(spark, folder)
        complaint = "none"
    except readers.MissingSource as e:
        complaint = "zones" if "taxi_zone_lookup" in str(e) else str(e)
    _csv(_zones(spark, d), f"{folder}/taxi_zone_lookup.csv")
    _csv(B.products(B.table(spark, d, "part")), f"{folder}/instacart/products.csv")
    found = readers.table_row_counts(readers.load_sources(spark, folder))
    return found.withColumn("missing_before", F.lit(complaint))


@query
def seed_dimension(spark, d):
    """A zone classification kept as CSV, joined to the trips of its zones."""
    folder = scratch_table(spark, "seed")
    group = F.when(F.col("Borough") == "ASIA", "treatment").when(F.col("Borough") == "EUROPE", "outer_borough_control")
    _csv(_zones(spark, d).select("LocationID", "Zone", "Borough", F.lit(1.5).alias("pct_fee_charged"),
                                 group.otherwise("exclude_other").alias("zone_group")),
         f"{folder}/{readers.CLASSIFICATION.pattern}")
    classes = staging.zone_classification(readers.load(spark, folder, readers.CLASSIFICATION))
    counts = _trips(spark, d).groupBy(F.col("PULocationID").alias("location_id")).agg(F.count(F.lit(1)).alias("_n"))
    return classes.join(counts, "location_id", "left").groupBy("zone_group").agg(
        F.count(F.lit(1)).alias("zones"), F.coalesce(F.sum("_n"), F.lit(0)).alias("trips"))


def _csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def _raw_folder(spark, d) -> str:
    folder, orders = scratch_table(spark, "raw"), _orders(spark, d)
    items = _items(spark, d, orders).select("order_id", "product_id", "add_to_cart_order", "reordered", "source_eval_set")
    _trips(spark, d).write.parquet(f"{folder}/fhvhv_2024-01.parquet")
    products, aisles, departments = _catalogue(spark, d)
    for name, df in {"taxi_zone_lookup": _zones(spark, d), "instacart/orders": orders, "instacart/products": products,
                     "instacart/order_products__prior": items.where("source_eval_set = 'prior'").drop("source_eval_set"),
                     "instacart/order_products__train": items.where("source_eval_set = 'train'").drop("source_eval_set"),
                     "instacart/aisles": aisles, "instacart/departments": departments}.items():
        _csv(df, f"{folder}/{name}.csv")
    return folder


def _months_of_events(spark, d) -> DataFrame:
    """The events, which all fall into one month, over three."""
    months = F.make_ym_interval(F.lit(0), (F.col("event_id") % 3).cast("int"))
    return B.table(spark, d, "events").withColumn("ts", F.col("ts") + months)


def _refreshed_cells(spark, d) -> str:
    """Cells of the first two months, then of the third one alone."""
    trips = staging.trips(B.trips(_months_of_events(spark, d)))
    fact, cells = scratch_table(spark, "trips_by_month"), scratch_table(spark, "trip_cells")
    placed = enriched.trips_enriched(trips, staging.zones(_zones(spark, d)), B.SCOPE[0], "2025-01-01")
    months = writers.months_of(placed, "pickup_datetime")
    for known in (months[:2], months):
        writers.load_months(placed, fact, "pickup_datetime", known)
        refresh.refresh(spark, fact, cells, refresh.trip_cells)
    return cells


@query
def incremental_daily_summary(spark, d):
    daily = refresh.daily_trip_summary(spark, _refreshed_cells(spark, d))
    return _rounded(daily, 2, "total_driver_pay", "total_base_fare")


@query
def incremental_hourly_demand(spark, d):
    hourly = refresh.hourly_demand(spark, _refreshed_cells(spark, d))
    return _rounded(hourly, 2, "total_driver_pay", "total_base_fare")


@query
def approximate_distinct(spark, d):
    """Users a month and in all: exact, and whether stored and merged sketches stay within three standard errors."""
    events = _months_of_events(spark, d)
    fact, stored = scratch_table(spark, "events_by_month"), scratch_table(spark, "user_sketches")
    months = writers.months_of(events, "ts")
    for known in (months[:1], months):
        writers.load_months(events, fact, "ts", known)
        refresh.refresh(spark, fact, stored, refresh.user_sketches("user_id"))
    sketches = spark.read.parquet(stored).withColumn("month", F.col("month").cast("string"))
    found = distinct.estimates(sketches.unionByName(distinct.merged(sketches).withColumn("month", F.lit("all"))))
    dated = writers.with_month(events, "ts")
    exact = dated.groupBy("month").agg(F.countDistinct("user_id").alias("users")).unionByName(
        dated.agg(F.countDistinct("user_id").alias("users")).withColumn("month", F.lit("all")))
    off = F.abs(F.col("approximate_distinct") - F.col("users"))
    return exact.join(found, "month").select(
        "month", "users", (off <= 3 * distinct.standard_error() * F.col("users")).alias("within_bound"))


@query
def spread_join_volume(spark, d):
    """Lines by customer nation, joined over suppliers that each have many lines."""
    lines = B.table(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    suppliers = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return joins.spread_join(lines, suppliers, ["l_suppkey"]).groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))


# --- staging and enrichment ---------------------------------------------------------------

@query
def staging_contract(spark, d):
    return staging.trips(_trips(spark, d))


@query
def staging_zones(spark, d):
    return staging.zones(_zones(spark, d))


@query
def staging_orders(spark, d):
    return staging.orders(_orders(spark, d))


def _staged_items(spark, d, source: str) -> DataFrame:
    return staging.order_products(_items(spark, d).where(F.col("source_eval_set") == source))


@query
def staging_order_products_prior(spark, d):
    return _staged_items(spark, d, "prior")


@query
def staging_order_products_train(spark, d):
    return _staged_items(spark, d, "train")


@query
def staging_products(spark, d):
    return staging.products(_catalogue(spark, d)[0])


@query
def staging_aisles(spark, d):
    return staging.aisles(_catalogue(spark, d)[1])


@query
def staging_departments(spark, d):
    return staging.departments(_catalogue(spark, d)[2])


@query
def tagged_union(spark, d):
    """Both item sets as one table that remembers the set of each row."""
    return enriched.tagged_items(_staged_items(spark, d, "prior"), _staged_items(spark, d, "train"))


@query
def fct_trips(spark, d):
    """The enriched trips written as a table and read back."""
    fact = writers.materialise(_enriched_trips(spark, d), scratch_table(spark, "fct_trips"))
    return fact.withColumns({c: F.col(c).cast("string") for c in _FLAGS})


_FLAGS = ("is_shared_request", "is_shared_match", "is_cbd_fee_trip")


@query
def trips_enriched(spark, d):
    """Three-valued flags are shown as text, so a missing one compares the same in both engines."""
    return _enriched_trips(spark, d).withColumns({c: F.col(c).cast("string") for c in _FLAGS})


@query
def order_items_enriched(spark, d):
    return _enriched_items(spark, d)


@query
def interval_columns(spark, d):
    return _trips(spark, d).select(
        "pickup_datetime",
        C.elapsed_seconds("request_datetime", "pickup_datetime").alias("wait_time_sec"),
        C.elapsed_seconds("request_datetime", "on_scene_datetime").alias("approach_time_sec"),
        C.elapsed_seconds("on_scene_datetime", "pickup_datetime").alias("dwell_time_sec"))


# --- demand -------------------------------------------------------------------------------

@query
def daily_counts(spark, d):
    return demand.daily_counts(_scoped_trips(spark, d), "pickup_datetime")


@query
def category_label_counts(spark, d):
    return demand.category_label_counts(_scoped_trips(spark, d), "hvfhs_license_num", enriched.COMPANIES)


@query
def flag_funnel_rates(spark, d):
    return demand.flag_funnel_rates(
        _scoped_trips(spark, d), C.labelled("hvfhs_license_num", enriched.COMPANIES),
        C.yes_flag("shared_request_flag"), C.yes_flag("shared_match_flag"))


@query
def distribution_profile(spark, d):
    """Promised lead time of a line (a day per unit) against its order and ship dates."""
    lines = B.table(spark, d, "lineitem").select(
        "l_orderkey", "l_shipdate", (F.col("l_quantity") * 86400).cast("bigint").alias("trip_time"))
    ordered = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return demand.distribution_profile(lines.join(ordered, "l_orderkey"), "trip_time", "o_orderdate", "l_shipdate",
                                       long_after=40 * 86400)


def _supplied(spark, d, counted: DataFrame) -> DataFrame:
    """Counts by supplier, with the supplier's nation: the fact is reduced before it meets the supplier."""
    supplier = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return counted.join(supplier, "l_suppkey")


def _nations(spark, d) -> DataFrame:
    region = B.table(spark, d, "region")
    return B.table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))


_PLACE = {"n_name": "pickup_zone", "r_name": "borough"}


@query
def topk_share(spark, d):
    lines = B.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"))
    return demand.topk_share(_supplied(spark, d, lines), "s_nationkey", _nations(spark, d), "n_nationkey", _PLACE,
                             weight="lines")


@query
def fee_share(spark, d):
    return demand.fee_share(_scoped_trips(spark, d), "cbd_congestion_fee")


@query
def fee_top_origins(spark, d):
    taxed = B.table(spark, d, "lineitem").groupBy("l_suppkey").agg(C.count_where(F.col("l_tax") > 0).alias("taxed"))
    return demand.fee_top_origins(_supplied(spark, d, taxed), "taxed", "s_nationkey", _nations(spark, d),
                                  "n_nationkey", _PLACE, weight="taxed")


@query
def ratio_of_sums_by_hour(spark, d):
    return demand.ratio_of_sums_by_hour(
        _scoped_trips(spark, d), "pickup_datetime", "driver_pay", "base_passenger_fare",
        ["base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge", "airport_fee", "tips",
         "cbd_congestion_fee"])


def _flows(spark, d) -> DataFrame:
    """Numbers of lines from the supplier's nation to the customer's, counted before they meet the supplier."""
    owner = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(
        B.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    lines = B.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(owner, "l_orderkey")
    return _supplied(spark, d, lines.groupBy("l_suppkey", "c_nationkey").agg(F.count(F.lit(1)).alias("lines")))


@query
def role_playing_join(spark, d):
    return demand.pair_counts(_flows(spark, d), "s_nationkey", "c_nationkey", B.table(spark, d, "nation"),
                              "n_nationkey", "n_name", weight="lines")


@query
def topn_per_group(spark, d):
    return demand.top_destinations(_flows(spark, d), "s_nationkey", "c_nationkey", B.table(spark, d, "nation"),
                                   "n_nationkey", "n_name", weight="lines")


@query
def weekday_weekend_curve(spark, d):
    return demand.weekday_weekend_curve(_scoped_trips(spark, d), "pickup_datetime")


@query
def rolling_7d_avg(spark, d):
    return demand.rolling_daily_counts(_scoped_trips(spark, d), "pickup_datetime")


# --- cohorts ------------------------------------------------------------------------------

@query
def sequence_retention(spark, d):
    return cohorts.sequence_retention(_orders(spark, d))


@query
def latest_row_per_key(spark, d):
    return cohorts.latest_per_key(_orders(spark, d), "user_id", "order_number",
                                  ["order_id", "days_since_prior_order"], latest="last_order_number")


@query
def reorder_rate_summary(spark, d):
    return cohorts.reorder_rate_summary(_items(spark, d))


@query
def reorder_rate_by_tenure(spark, d):
    return cohorts.reorder_rate_by(_items(spark, d))


@query
def rfm_segmentation(spark, d):
    orders = _orders(spark, d)
    prior = _items(spark, d, orders).where(F.col("source_eval_set") == "prior")
    return cohorts.rfm_segmentation(orders, prior, B.GAP_TIERS)


@query
def churn_gap_recovery(spark, d):
    return cohorts.churn_gap_recovery(_orders(spark, d), cap=B.GAP_CAP, total="total_capped_gaps")


@query
def cumulative_by_tenure(spark, d):
    prior = _items(spark, d).where(F.col("source_eval_set") == "prior")
    return cohorts.cumulative_by_tenure(prior, [1, 2, 3, 5, 8, 10, 12, 15, 20])


@query
def basket_composition(spark, d):
    products, _, departments = _catalogue(spark, d)
    return cohorts.basket_composition(_items(spark, d), products, departments)


@query
def reorder_leaderboard(spark, d):
    return cohorts.reorder_leaderboard(_items(spark, d), _catalogue(spark, d)[0], floor=B.LEADERBOARD_FLOOR)


# --- marts --------------------------------------------------------------------------------

@query
def daily_summary(spark, d):
    return _rounded(marts.daily_trip_summary(_enriched_trips(spark, d)), 2, "total_driver_pay", "total_base_fare")


@query
def hourly_demand(spark, d):
    return _rounded(marts.hourly_demand(_enriched_trips(spark, d)), 2, "total_driver_pay", "total_base_fare")


@query
def user_rfm(spark, d):
    orders = _orders(spark, d)
    return marts.user_rfm(orders, _items(spark, d, orders), B.GAP_TIERS)


@query
def order_sequence_summary(spark, d):
    orders = _orders(spark, d)
    mart = marts.order_sequence_summary(orders, _tagged_items(spark, d, orders))
    # Order numbers without items have no count; as a double it compares the same in both engines.
    return mart.withColumn("total_items", F.col("total_items").cast("double"))


@query
def department_composition(spark, d):
    return marts.department_basket_composition(_enriched_items(spark, d))


@query
def product_leaderboard(spark, d):
    return marts.product_reorder_leaderboard(_enriched_items(spark, d), floor=B.LEADERBOARD_FLOOR)


# --- panels and regressions ---------------------------------------------------------------

@query
def incidence_classification(spark, d):
    return _classes(spark, d)


@query
def did_panel(spark, d):
    return _rounded(_panel(spark, d), 2, "total_base_fare", "total_driver_pay")


@query
def group_daily_series(spark, d):
    return _series(spark, d)


@query
def indexed_series(spark, d):
    groups = [TREATMENT, OUTER_CONTROL]
    out = panel.indexed_series(panel.group_daily_series(_panel(spark, d), groups), groups, *B.PRE_PERIOD)
    return _rounded(out, 6, *out.columns[1:])


@query
def presence_filter(spark, d):
    kept = panel.presence_filter(_panel(spark, d), fraction=B.PRESENCE)
    return kept.groupBy("location_id", "zone_group").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("trip_count").alias("trip_count"))


@query
def event_weeks(spark, d):
    return panel.event_weeks(_panel(spark, d), B.POLICY).groupBy("week_relative").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("trip_date").alias("first_day"),
        F.max("trip_date").alias("last_day"), F.sum("trip_count").alias("trip_count"))


_OLS_NUMBERS = ("coef", "std_error", "z_stat", "p_value")


def _pre_period(control: str):
    return _between(control) & (F.col("trip_date") <= C.day(B.PRE_PERIOD[1]))


@query
def pretrend_ols_hc1(spark, d):
    specs = {"outer, full": _pre_period(OUTER_CONTROL)}
    return _rounded(regression.pretrend_test(_series(spark, d), specs), 6, *_OLS_NUMBERS)


@query
def pretrend_specs(spark, d):
    specs = {
        "outer, full": _pre_period(OUTER_CONTROL),
        "outer, no holidays": _pre_period(OUTER_CONTROL) & _no_holidays(),
        "core, full": _pre_period(CORE_CONTROL),
        "core, no holidays": _pre_period(CORE_CONTROL) & _no_holidays(),
    }
    return _rounded(regression.pretrend_test(_series(spark, d), specs), 6, *_OLS_NUMBERS)


_FE_NUMBERS = ("coef", "std_error", "t_stat", "p_value", "ci_low", "ci_high")
_PCT_NUMBERS = ("pct_effect", "pct_low", "pct_high")


@query
def twfe_did(spark, d):
    fit = regression.did_regression(_panel(spark, d), {"primary": _between(OUTER_CONTROL) & _no_holidays()},
                                    fraction=B.PRESENCE)
    return _rounded(fit.drop("converged"), 6, *_FE_NUMBERS, *_PCT_NUMBERS)


@query
def twfe_specs(spark, d):
    fit = regression.did_regression(_panel(spark, d), {
        "primary": _between(OUTER_CONTROL) & _no_holidays(),
        "sensitivity": _between(OUTER_CONTROL),
        "robustness": _between(CORE_CONTROL) & _no_holidays(),
    }, fraction=B.PRESENCE)
    return _rounded(fit.drop("converged"), 6, *_FE_NUMBERS, *_PCT_NUMBERS)


@query
def twfe_outcomes(spark, d):
    fit = regression.did_outcomes(_panel(spark, d), _between(OUTER_CONTROL) & _no_holidays(), fraction=B.PRESENCE)
    return _rounded(fit.drop("converged"), 6, *_FE_NUMBERS, "effect", "effect_low", "effect_high")


@query
def event_study(spark, d):
    table = regression.event_study(_panel(spark, d).where(_between(OUTER_CONTROL)), B.POLICY, B.REFERENCE_WEEK,
                                   fraction=B.PRESENCE)
    return _rounded(table, 6, "coef", "se", "ci_low", "ci_high")


# --- data quality -------------------------------------------------------------------------

@query
def dq_not_null(spark, d):
    return quality.report(
        quality.not_null(_trips(spark, d), "trips", [
            "hvfhs_license_num", "pickup_datetime", "dropoff_datetime", "airport_fee", "shared_request_flag",
            "cbd_congestion_fee"]),
        quality.not_null(_orders(spark, d), "orders", ["order_id", "user_id", "days_since_prior_order"]))


@query
def dq_unique(spark, d):
    return quality.run(
        [quality.expect_unique("orders", "o_orderkey"), quality.expect_unique("orders", "o_custkey"),
         quality.expect_unique("part", "p_name"), quality.expect_unique("nation", "n_nationkey")],
        {n: B.table(spark, d, n) for n in ("orders", "part", "nation")})


@query
def dq_accepted_values(spark, d):
    return quality.report(
        quality.accepted_values(_trips(spark, d), "trips", {
            "hvfhs_license_num": ["HV0002", "HV0003", "HV0005"], "shared_request_flag": ["Y", "N"],
            "shared_match_flag": ["Y", "N"]}),
        quality.accepted_values(B.table(spark, d, "lineitem"), "lineitem", {
            "l_returnflag": ["A", "N"], "l_linestatus": ["O", "F"]}))


@query
def dq_relationships(spark, d):
    return quality.run(
        [quality.expect_known("lineitem", "l_partkey", "part", "p_partkey"),
         quality.expect_known("lineitem", "l_orderkey", "orders", "o_orderkey"),
         quality.expect_known("orders", "o_orderkey", "lineitem", "l_orderkey"),
         quality.expect_known("customer", "c_custkey", "events", "user_id")],
        {n: B.table(spark, d, n) for n in ("lineitem", "orders", "part", "customer", "events")})


@query
def dq_unique_combination(spark, d):
    return quality.run(
        [quality.expect_unique_together("lineitem", ["l_orderkey", "l_linenumber"]),
         quality.expect_unique_together("did_panel", ["trip_date", "location_id"])],
        {"lineitem": B.table(spark, d, "lineitem"), "did_panel": _panel(spark, d)})


@query
def dq_reconcile(spark, d):
    trips, enriched_trips = _scoped_trips(spark, d), _enriched_trips(spark, d)
    rows = F.count(F.lit(1)).alias("n")
    orders = _orders(spark, d)
    items = _items(spark, d, orders)
    return quality.report(
        quality.reconcile("mart_total", "daily_summary", "trip_count",
                          demand.daily_counts(enriched_trips, "pickup_datetime").agg(F.sum("trip_count")),
                          trips.agg(rows)),
        quality.reconcile("same_grain", "fct_trips", "*", enriched_trips.agg(rows), trips.agg(rows)),
        quality.reconcile("mart_total", "user_rfm", "monetary_proxy_items",
                          marts.user_rfm(orders, items, B.GAP_TIERS).agg(F.sum("monetary_proxy_items")),
                          items.where(F.col("source_eval_set") == "prior").agg(rows)))


@query
def dq_partition_identity(spark, d):
    return quality.report(
        quality.partition_identity(_orders(spark, d), "orders", "user_id", "eval_set", ["train", "test"]),
        quality.partition_identity(_orders(spark, d), "orders", "user_id", "eval_set", ["prior", "train"]))


@query
def dq_threshold(spark, d):
    return quality.row_checks(_trips(spark, d), "trips", thresholds={
        "trip_time": (F.col("trip_time") <= 0, 0, 20),
        "trip_miles": (F.col("trip_miles") > 30, 0, 20),
        "base_passenger_fare": (F.col("base_passenger_fare") < 0, 0, 20),
    })
