"""Raw tables under their analysis names: explicit columns, booleans, no logic."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.sources import schemas


def _select(df: DataFrame, contract: T.StructType, renamed: Mapping[str, str] | None = None) -> DataFrame:
    renamed = renamed or {}
    return df.select(*[F.col(f.name).alias(renamed.get(f.name, f.name)) for f in contract.fields])


def trips(raw: DataFrame) -> DataFrame:
    return _select(raw, schemas.TRIPS,
                   {"PULocationID": "pickup_location_id", "DOLocationID": "dropoff_location_id"})


def zones(raw: DataFrame) -> DataFrame:
    return _select(raw, schemas.ZONES, {"LocationID": "location_id", "Borough": "borough", "Zone": "zone"})


def orders(raw: DataFrame) -> DataFrame:
    return _select(raw, schemas.ORDERS)


def order_products(raw: DataFrame) -> DataFrame:
    return raw.select("order_id", "product_id", "add_to_cart_order", (F.col("reordered") == 1).alias("is_reordered"))


def products(raw: DataFrame) -> DataFrame:
    return _select(raw, schemas.PRODUCTS)


def aisles(raw: DataFrame) -> DataFrame:
    return _select(raw, schemas.AISLES)


def departments(raw: DataFrame) -> DataFrame:
    return _select(raw, schemas.DEPARTMENTS)


def zone_classification(raw: DataFrame) -> DataFrame:
    return _select(raw, schemas.ZONE_CLASSIFICATION,
                   {"LocationID": "location_id", "Borough": "borough", "Zone": "zone"})


def staged(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every staging model whose raw table was loaded."""
    builders = {
        "trips": trips,
        "zones": zones,
        "orders": orders,
        "order_products_prior": order_products,
        "order_products_train": order_products,
        "products": products,
        "aisles": aisles,
        "departments": departments,
    }
    return {f"stg_{name}": build(raw[name]) for name, build in builders.items() if name in raw}
