"""Column contracts of the raw tables, so no reader infers a schema.

Each column has the widest type any file stores it with: Parquet readers widen
but never narrow.
"""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _INT, _LONG, _DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_TIME = T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


TRIPS = _table(
    hvfhs_license_num=_STRING,
    dispatching_base_num=_STRING,
    originating_base_num=_STRING,
    request_datetime=_TIME,
    on_scene_datetime=_TIME,
    pickup_datetime=_TIME,
    dropoff_datetime=_TIME,
    PULocationID=_LONG,
    DOLocationID=_LONG,
    trip_miles=_DOUBLE,
    trip_time=_LONG,
    base_passenger_fare=_DOUBLE,
    tolls=_DOUBLE,
    bcf=_DOUBLE,
    sales_tax=_DOUBLE,
    congestion_surcharge=_DOUBLE,
    airport_fee=_DOUBLE,
    tips=_DOUBLE,
    driver_pay=_DOUBLE,
    shared_request_flag=_STRING,
    shared_match_flag=_STRING,
    access_a_ride_flag=_STRING,
    wav_request_flag=_STRING,
    wav_match_flag=_STRING,
    cbd_congestion_fee=_DOUBLE,
)

ZONES = _table(LocationID=_LONG, Borough=_STRING, Zone=_STRING, service_zone=_STRING)

ORDERS = _table(
    order_id=_LONG,
    user_id=_LONG,
    eval_set=_STRING,
    order_number=_INT,
    order_dow=_INT,
    order_hour_of_day=_INT,
    days_since_prior_order=_DOUBLE,
)

ORDER_PRODUCTS = _table(order_id=_LONG, product_id=_LONG, add_to_cart_order=_INT, reordered=_INT)
PRODUCTS = _table(product_id=_LONG, product_name=_STRING, aisle_id=_LONG, department_id=_LONG)
AISLES = _table(aisle_id=_LONG, aisle=_STRING)
DEPARTMENTS = _table(department_id=_LONG, department=_STRING)

ZONE_CLASSIFICATION = _table(
    LocationID=_LONG, Zone=_STRING, Borough=_STRING, pct_fee_charged=_DOUBLE, zone_group=_STRING)
