"""The model graph end to end on a small raw folder, with both verticals."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldtally.plans import warehouse
from fieldtally.sources import schemas
from fieldtally.sources.readers import to_contract


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    rng = random.Random(3)
    rows = []
    for i in range(400):
        at = datetime(2025, 2, 27) + timedelta(minutes=97 * i)
        zone = rng.choice([1, 2, 3, 4])
        wait = timedelta(seconds=rng.randrange(900))
        rows.append((rng.choice(["HV0003", "HV0005"]), at - wait, at - wait / 2, at, at + timedelta(minutes=15), zone,
                     rng.choice([1, 2, 3, 4]), 900, 20.0, 14.0, "N", "N", 1.5 if zone == 1 else 0.0))
    trips = spark.createDataFrame(
        rows, "hvfhs_license_num string, request_datetime timestamp_ntz, on_scene_datetime timestamp_ntz,"
        "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID int, DOLocationID int,"
        "trip_time int, base_passenger_fare double, driver_pay double, shared_request_flag string,"
        "shared_match_flag string, cbd_congestion_fee double")
    early = trips.where("pickup_datetime < '2025-03-01'").drop("cbd_congestion_fee")
    early.write.parquet(f"{root}/fhvhv_2025-02.parquet")
    to_contract(trips.where("pickup_datetime >= '2025-03-01'"), schemas.TRIPS).write.parquet(
        f"{root}/fhvhv_2025-03.parquet")
    (root / "taxi_zone_lookup.csv").write_text(
        "LocationID,Borough,Zone,service_zone\n1,Manhattan,Core,Y\n2,Manhattan,North,Y\n3,Queens,Corona,B\n"
        "4,Queens,Corona,B\n")
    return root


@pytest.fixture(scope="module")
def delivery(raw):
    folder = Path(raw) / "instacart"
    folder.mkdir()
    orders, prior, train = [], [], []
    order_id = 0
    for user in range(1, 13):
        for n in range(1, user + 2):
            order_id += 1
            last = n == user + 1
            kind = ("train" if user % 3 else "test") if last else "prior"
            gap = "" if n == 1 else str(float(min(30, user * n)))
            orders.append(f"{order_id},{user},{kind},{n},{n % 7},{n % 24:02d},{gap}")
            if kind != "test":
                target = train if kind == "train" else prior
                target += [f"{order_id},{p},{p},{int(n > 1)}" for p in range(1, 2 + n % 3)]
    header = "order_id,product_id,add_to_cart_order,reordered"
    files = {
        "orders.csv": ["order_id,user_id,eval_set,order_number,order_dow,order_hour_of_day,days_since_prior_order",
                       *orders],
        "order_products__prior.csv": [header, *prior],
        "order_products__train.csv": [header, *train],
        "products.csv": ["product_id,product_name,aisle_id,department_id", "1,\"Milk, whole\",1,1", "2,Bread,2,2",
                         "3,Jam,2,2"],
        "aisles.csv": ["aisle_id,aisle", "1,dairy", "2,pantry"],
        "departments.csv": ["department_id,department", "1,cold", "2,dry"],
    }
    for name, lines in files.items():
        (folder / name).write_text("\n".join(lines) + "\n")
    return raw


def test_build_and_checks(spark, delivery, tmp_path):
    settings = warehouse.Settings(leaderboard_floor=50)
    models = warehouse.build(spark, str(delivery), str(tmp_path), settings)
    fact = models["fct_trips"]
    assert fact.count() == models["stg_trips"].where("pickup_datetime >= '2025-03-01'").count()
    assert models["mart_daily_trip_summary"].agg(F.sum("trip_count")).first()[0] == fact.count()
    groups = {r.location_id: r.zone_group for r in models["zone_classification"].collect()}
    assert groups == {1: "treatment", 2: "manhattan_north_control", 3: "outer_borough_control",
                      4: "outer_borough_control"}
    panel = models["mart_did_zone_daily_panel"]
    assert panel.agg(F.min("trip_date")).first()[0].month == 2  # the whole range, not only the scope
    assert panel.agg(F.sum("trip_count")).first()[0] == 400
    assert models["mart_user_rfm"].count() == 12
    assert {r.product_name for r in models["mart_product_reorder_leaderboard"].collect()} == {"Milk, whole", "Bread"}

    report = {(r.check, r.table_name, r.column_name): r for r in warehouse.checks(models, settings).collect()}
    assert {k: r.failures for k, r in report.items() if r.status != "pass"} == {}
    # Written tables are read once; of the others, trips and zones also stand behind the lazy enriched trips.
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = warehouse.checks(models, settings)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for table in ("fct_trips", "mart_user_rfm", "int_order_products_enriched", "zone_classification", "mart_hourly_demand"):
        assert plan.count(f"/{table}]") + plan.count(f"/{table},") == 1, table
    assert plan.count("orders.csv") == 1 and plan.count("order_products__prior.csv") == 1
    kinds = [k[0] for k in report]
    assert {k: kinds.count(k) for k in set(kinds)} == {
        "not_null": 32, "unique": 11, "accepted_values": 12, "relationships": 8, "unique_combination": 4,
        "threshold": 1, "mart_total": 2, "same_grain": 1, "partition_identity": 1}


def test_failing_rows_show_up(spark, raw, tmp_path):
    models = warehouse.build(spark, str(raw), str(tmp_path))
    trips = models["stg_trips"]
    models["stg_trips"] = trips.union(trips.where("pickup_datetime >= '2025-03-01'").limit(1).withColumn(
        "trip_time", F.lit(0).cast("long")).withColumn("pickup_location_id", F.lit(99).cast("long")))
    bad = {(r.check, r.column_name): (r.failures, r.status) for r in warehouse.checks(models).where(
        "status <> 'pass'").collect()}
    assert bad == {("threshold", "trip_time"): (1, "warn"), ("relationships", "pickup_location_id"): (1, "error"),
                   ("mart_total", "trip_count"): (1, "error")}


def test_a_given_classification_is_used(spark, raw, folder):
    seed = Path(raw) / "crz_zone_classification.csv"
    seed.write_text("LocationID,Zone,Borough,pct_fee_charged,zone_group\n1,Core,Manhattan,99.0,treatment\n"
                    "2,North,Manhattan,1.0,manhattan_north_control\n3,Corona,Queens,0.0,outer_borough_control\n"
                    "4,\"Corona, East\",Queens,0.0,exclude_border\n")
    try:
        models = warehouse.build(spark, str(raw), folder)
    finally:
        seed.unlink()
    groups = {r.location_id: r.zone_group for r in models["zone_classification"].collect()}
    assert groups == {1: "treatment", 2: "manhattan_north_control", 3: "outer_borough_control", 4: "exclude_border"}
    assert models["mart_did_zone_daily_panel"].where("location_id = 4").count() == 0
