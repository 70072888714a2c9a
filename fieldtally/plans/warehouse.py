"""The whole model graph: raw files to staged, enriched and mart tables, and their checks.

Staging stays lazy.  Tables that several others read, and every mart, are
written to Parquet once and read back.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions import columns as C
from fieldtally.operators import panel, quality
from fieldtally.plans import enriched, marts, staging
from fieldtally.sources import readers, writers

# Boroughs of the city, those around the priced zone, and the policy dates.
CORE_BOROUGHS = ("Manhattan",)
OUTER_BOROUGHS = ("Brooklyn", "Queens", "Bronx", "Staten Island")
POLICY_START = "2025-01-05"
TRANSITION_MONTH = ("2025-01-01", "2025-02-01")
MARCH = ("2025-03-01", "2025-04-01")


@dataclass(frozen=True)
class Settings:
    """What a build may vary; the defaults are the reference study's."""

    scope: tuple[str, str] = MARCH
    policy: str = POLICY_START
    transition: tuple[str, str] = TRANSITION_MONTH
    core: tuple[str, ...] = CORE_BOROUGHS
    outer: tuple[str, ...] = OUTER_BOROUGHS
    treat_at: float = 95.0
    border_at: float = 30.0
    leaderboard_floor: int = 1000
    tiers: Mapping = field(default_factory=dict)


def build(spark: SparkSession, root: str, out: str, settings: Settings = Settings(),
          classes: DataFrame | None = None, counts: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """All models of the sources under ``root``; marts are written under ``out``.

    ``classes`` is a ready zone classification; without one the file of
    ``readers.CLASSIFICATION`` under ``root`` is taken, and where there is none
    it is derived from the fee incidence inside the scope.  Delivery models are built only where
    the delivery sources exist.  ``counts`` receives the rows of each written table, seen while writing.
    """
    stg = staging.staged(readers.load_sources(spark, root))
    models = dict(stg)

    def keep(name: str, df: DataFrame) -> DataFrame:
        rows = Observation()
        models[name] = writers.materialise(df, f"{out.rstrip('/')}/{name}", rows=rows)
        if counts is not None:
            counts[name] = rows.get["row_count"]
        return models[name]

    models["int_trips_enriched"] = enriched.trips_enriched(stg["stg_trips"], stg["stg_zones"], *settings.scope)
    fact = keep("fct_trips", models["int_trips_enriched"])
    keep("mart_daily_trip_summary", marts.daily_trip_summary(fact))
    keep("mart_hourly_demand", marts.hourly_demand(fact))
    seed = readers.CLASSIFICATION
    if classes is None and readers.matching_files(spark, f"{root.rstrip('/')}/{seed.pattern}"):
        classes = staging.zone_classification(readers.load(spark, root, seed))
    if classes is None:
        scoped = stg["stg_trips"].where(C.within("pickup_datetime", *settings.scope))
        classes = panel.incidence_classification(
            scoped, "pickup_location_id", "cbd_congestion_fee", stg["stg_zones"], "location_id", area="borough",
            core=settings.core, outer=settings.outer, treat_at=settings.treat_at, border_at=settings.border_at,
            keep=["zone"])
    zone_classes = keep("zone_classification", classes)
    keep("mart_did_zone_daily_panel", panel.did_panel(
        stg["stg_trips"], "pickup_datetime", "pickup_location_id", "base_passenger_fare", "driver_pay",
        zone_classes, "location_id", policy=settings.policy, transition=settings.transition))

    if "stg_orders" in stg:
        items = keep("int_order_products_enriched", enriched.order_products_enriched(
            enriched.tagged_items(stg["stg_order_products_prior"], stg["stg_order_products_train"]),
            stg["stg_products"], stg["stg_aisles"], stg["stg_departments"], stg["stg_orders"]))
        orders = stg["stg_orders"]
        keep("mart_user_rfm", marts.user_rfm(orders, items, settings.tiers))
        keep("mart_order_sequence_summary", marts.order_sequence_summary(orders, items))
        keep("mart_department_basket_composition", marts.department_basket_composition(items))
        keep("mart_product_reorder_leaderboard",
             marts.product_reorder_leaderboard(items, settings.leaderboard_floor))
    return models


# The declared checks, model by model.
_TIERS = ("A: 0-7 days (very recent)", "B: 8-14 days", "C: 15-21 days", "D: 22-29 days",
          "E: 30+ days (censored, at-risk)")
_ROW_CHECKS = {
    "stg_trips": dict(
        not_null=["hvfhs_license_num", "pickup_datetime", "dropoff_datetime", "pickup_location_id",
                  "dropoff_location_id"],
        accepted={"hvfhs_license_num": ["HV0002", "HV0003", "HV0004", "HV0005"],
                  "shared_request_flag": ["Y", "N"], "shared_match_flag": ["Y", "N"]},
        limits={"trip_time": ("trip_time <= 0", 0, 20)}),
    "stg_zones": dict(not_null=["location_id"]),
    "stg_orders": dict(not_null=["order_id", "user_id", "order_number"],
                       accepted={"eval_set": ["prior", "train", "test"]}),
    "stg_order_products_prior": dict(not_null=["order_id", "product_id"]),
    "stg_order_products_train": dict(not_null=["order_id", "product_id"]),
    "stg_products": dict(not_null=["product_id"]),
    "stg_aisles": dict(not_null=["aisle_id"]),
    "stg_departments": dict(not_null=["department_id"]),
    "int_trips_enriched": dict(
        not_null=["provider_name", "pickup_zone", "dropoff_zone", "hour_of_day"],
        accepted={"provider_name": ["Uber", "Lyft"], "day_type": ["weekday", "weekend"]}),
    "int_order_products_enriched": dict(not_null=["product_name", "department"],
                                        accepted={"source_eval_set": ["prior", "train"]}),
    "fct_trips": dict(not_null=["provider_name"]),
    "mart_daily_trip_summary": dict(not_null=["trip_date"]),
    "mart_hourly_demand": dict(not_null=["hour_of_day"]),
    "mart_user_rfm": dict(not_null=["user_id"], accepted={"recency_tier": list(_TIERS)}),
    "mart_order_sequence_summary": dict(not_null=["order_number"]),
    "mart_department_basket_composition": dict(not_null=["department"]),
    "mart_product_reorder_leaderboard": dict(not_null=["product_name"]),
    "zone_classification": dict(
        not_null=["location_id"],
        accepted={"zone_group": [panel.TREATMENT, panel.BORDER, panel.CORE_CONTROL, panel.OUTER_CONTROL,
                                 panel.OUTSIDE]}),
    "mart_did_zone_daily_panel": dict(
        not_null=["trip_date", "location_id"],
        accepted={"zone_group": [panel.TREATMENT, panel.OUTER_CONTROL, panel.CORE_CONTROL],
                  "is_treatment": [0, 1], "is_post": [0, 1]}),
}
_UNIQUE = (
    ("stg_zones", "location_id"), ("stg_orders", "order_id"), ("stg_products", "product_id"),
    ("stg_aisles", "aisle_id"), ("stg_departments", "department_id"), ("zone_classification", "location_id"),
    ("mart_daily_trip_summary", "trip_date"), ("mart_user_rfm", "user_id"),
    ("mart_order_sequence_summary", "order_number"), ("mart_department_basket_composition", "department"),
    ("mart_product_reorder_leaderboard", "product_name"),
)
_UNIQUE_TOGETHER = (
    ("stg_order_products_prior", ["order_id", "product_id"]),
    ("stg_order_products_train", ["order_id", "product_id"]),
    ("mart_hourly_demand", ["hour_of_day", "day_type"]),
    ("mart_did_zone_daily_panel", ["trip_date", "location_id"]),
)
_RELATIONSHIPS = (
    ("stg_trips", "pickup_location_id", "stg_zones", "location_id"),
    ("stg_trips", "dropoff_location_id", "stg_zones", "location_id"),
    ("stg_order_products_prior", "order_id", "stg_orders", "order_id"),
    ("stg_order_products_prior", "product_id", "stg_products", "product_id"),
    ("stg_order_products_train", "order_id", "stg_orders", "order_id"),
    ("stg_order_products_train", "product_id", "stg_products", "product_id"),
    ("stg_products", "aisle_id", "stg_aisles", "aisle_id"),
    ("stg_products", "department_id", "stg_departments", "department_id"),
)


def checks(models: Mapping[str, DataFrame], settings: Settings = Settings()) -> DataFrame:
    """Every declared check of the models present, as one report; each model is read once."""
    wanted = []
    for name, spec in _ROW_CHECKS.items():
        wanted += [quality.expect_not_null(name, c) for c in spec.get("not_null", ())]
        wanted += [quality.expect_accepted(name, c, v) for c, v in spec.get("accepted", {}).items()]
        wanted += [quality.expect_within(name, c, F.expr(bad), warn, error)
                   for c, (bad, warn, error) in spec.get("limits", {}).items()]
    wanted += [quality.expect_unique(m, c) for m, c in _UNIQUE]
    wanted += [quality.expect_unique_together(m, cs) for m, cs in _UNIQUE_TOGETHER]
    wanted += [quality.expect_known(*r) for r in _RELATIONSHIPS]
    every = F.lit(True)
    wanted += [
        quality.expect_same_total("mart_total", "mart_daily_trip_summary", "trip_count",
                                  ("mart_daily_trip_summary", every, F.col("trip_count")),
                                  ("stg_trips", C.within("pickup_datetime", *settings.scope), None)),
        quality.expect_same_total("same_grain", "fct_trips", "*", ("fct_trips", every, None), ("int_trips_enriched", every, None)),
        quality.expect_one_part("stg_orders", "user_id", "eval_set", ["train", "test"]),
        quality.expect_same_total("mart_total", "mart_user_rfm", "monetary_proxy_items",
                                  ("mart_user_rfm", every, F.col("monetary_proxy_items")),
                                  ("stg_order_products_prior", every, None)),
    ]
    return quality.run(wanted, models)
