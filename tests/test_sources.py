from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fieldtally.plans import staging
from fieldtally.session import is_local, shared_folder
from fieldtally.sources import readers, schemas, writers
from fieldtally.streaming import incremental


def trip_file(spark, path, month, id_type, fee):
    rows = spark.range(4).select(
        F.lit("HV0003").alias("hvfhs_license_num"), F.col("id").cast(id_type).alias("PULocationID"),
        F.lit(datetime(2024, month, 15, 8)).cast("timestamp_ntz").alias("pickup_datetime"),
        F.lit(2.5).alias("base_passenger_fare"))
    if fee is not None:
        rows = rows.withColumn("cbd_congestion_fee", F.lit(fee))
    else:
        rows = rows.select(*reversed(rows.columns))
    rows.coalesce(1).write.parquet(path)


def test_files_align_by_name_with_missing_columns_and_wider_ids(spark, folder):
    trip_file(spark, f"{folder}/fhvhv_2024-12.parquet", 12, "int", None)
    trip_file(spark, f"{folder}/fhvhv_2025-01.parquet", 1, "bigint", 1.5)
    df = readers.read_parquet_by_name(spark, f"{folder}/fhvhv_*.parquet", schemas.TRIPS)
    assert df.columns == schemas.TRIPS.fieldNames()
    got = df.groupBy("cbd_congestion_fee", F.month("pickup_datetime").alias("m")).agg(
        F.sum("PULocationID").alias("s"), F.sum("base_passenger_fare").alias("f")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == ["(1.5, 1, 6, 10.0)", "(None, 12, 6, 10.0)"]
    plan = df.where("cbd_congestion_fee > 0").select("PULocationID")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(cbd_congestion_fee" in plan and "tips" not in plan
    with pytest.raises(readers.MissingSource):
        readers.read_parquet_by_name(spark, f"{folder}/none_*.parquet", schemas.TRIPS)


def write(path, text):
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)


ORDERS = "order_id,user_id,eval_set,order_number,order_dow,order_hour_of_day,days_since_prior_order\n"


def test_csv_matches_columns_by_name_and_reads_padded_numbers(spark, folder):
    write(f"{folder}/o.csv", ORDERS + "1,5,prior,1,0,08,\n2,5,train,2,6,23,30.0\n")
    rows = readers.read_csv(spark, f"{folder}/o.csv", schemas.ORDERS).orderBy("order_id").collect()
    assert [tuple(r) for r in rows] == [(1, 5, "prior", 1, 0, 8, None), (2, 5, "train", 2, 6, 23, 30.0)]
    write(f"{folder}/bad.csv", ORDERS + "1,5,prior,first,0,08,\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.read_csv(spark, f"{folder}/bad.csv", schemas.ORDERS).collect()


def test_seed_with_quoted_names(spark, folder):
    write(f"{folder}/seed.csv", 'LocationID,Zone,Borough,pct_fee_charged,zone_group\n'
          '103,"Island/Ellis, Liberty",Manhattan,99.1,treatment\n1,Newark,EWR,,exclude_other\n')
    rows = staging.zone_classification(readers.read_csv(spark, f"{folder}/seed.csv", schemas.ZONE_CLASSIFICATION))
    assert [tuple(r) for r in rows.orderBy("location_id").collect()] == [
        (1, "Newark", "EWR", None, "exclude_other"), (103, "Island/Ellis, Liberty", "Manhattan", 99.1, "treatment")]


def test_optional_sources_are_all_or_nothing_and_required_ones_must_exist(spark, folder):
    with pytest.raises(readers.MissingSource, match="fhvhv"):
        readers.load_sources(spark, folder)
    trip_file(spark, f"{folder}/fhvhv_2025-01.parquet", 1, "int", 1.5)
    with pytest.raises(readers.MissingSource, match="zone"):
        readers.load_sources(spark, folder)
    write(f"{folder}/taxi_zone_lookup.csv", "LocationID,Borough,Zone,service_zone\n1,EWR,\"Airport, Newark\",EWR\n")
    assert set(readers.load_sources(spark, folder)) == {"trips", "zones"}
    write(f"{folder}/instacart/orders.csv", ORDERS)
    tables = readers.load_sources(spark, folder)
    assert set(tables) == {"trips", "zones"}
    assert tables["zones"].first().Zone == "Airport, Newark"
    assert spark.table("trips").count() == 4
    counts = {r.table_name: r.row_count for r in readers.table_row_counts(tables).collect()}
    assert counts == {"trips": 4, "zones": 1}


def months(spark, n):
    return spark.range(n).select("id", F.expr("timestamp_ntz'2024-01-31 23:00:00' + make_dt_interval(cast(id as int) * 10)").alias("t"))


def test_months_are_loaded_once_unless_forced(spark, folder):
    path = f"{folder}/by_month"
    df = months(spark, 8)  # 31 January to 10 April
    assert writers.load_months(df, path, "t", ["2024-01", "2024-02"]) == ["2024-01", "2024-02"]
    assert writers.months_present(spark, path) == {"2024-01", "2024-02"}
    doubled = df.union(df)
    assert writers.load_months(doubled, path, "t", ["2024-02", "2024-03"]) == ["2024-03"]
    count = {r.month: r["count"] for r in spark.read.option("basePath", path).parquet(path)
             .groupBy(F.col("month").cast("string").alias("month")).count().collect()}
    assert count == {"2024-01": 1, "2024-02": 2, "2024-03": 8}
    assert writers.load_months(df, path, "t", ["2024-03"], force=True) == ["2024-03"]
    assert writers.load_months(df, path, "t", ["2024-03"]) == []
    assert spark.read.parquet(path).count() == 1 + 2 + 4


def test_month_files_keep_their_month_and_schema(spark, folder):
    trip_file(spark, f"{folder}/fhvhv_2024-12.parquet", 12, "int", None)
    trip_file(spark, f"{folder}/fhvhv_2025-01.parquet", 1, "bigint", 1.5)
    pattern, path = folder + "/fhvhv_{month}.parquet", f"{folder}/loaded"
    assert writers.load_month_files(spark, pattern, path, ["2024-12"]) == ["2024-12"]
    assert writers.load_month_files(spark, pattern, path, ["2024-12", "2025-01"]) == ["2025-01"]
    table = spark.read.schema(schemas.TRIPS).parquet(path)
    assert table.count() == 8 and table.where("cbd_congestion_fee is null").count() == 4


def test_materialise_replaces_an_earlier_run(spark, folder):
    writers.materialise(spark.range(5).toDF("x"), f"{folder}/t")
    assert writers.materialise(spark.range(3).toDF("x"), f"{folder}/t").count() == 3


def test_a_failing_rewrite_keeps_the_old_rows(spark, folder):
    path = f"{folder}/t"
    writers.materialise(spark.range(5).toDF("x"), path)
    broken = spark.range(8, numPartitions=4).select(F.when(F.col("id") < 7, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("x"))
    with pytest.raises(Exception, match="no"):
        writers.materialise(broken, path)
    assert spark.read.parquet(path).count() == 5 and [f.name for f in Path(folder).iterdir()] == ["t"]
    # A table may be made from the one it replaces.
    twice = spark.read.parquet(path).union(spark.read.parquet(path)).withColumn("part", F.col("x") % 2)
    doubled = writers.materialise(twice, path, partition_by=["part"])
    assert doubled.count() == 10 and [f.name for f in Path(folder).iterdir()] == ["t"]
    assert writers.materialise(spark.range(1).toDF("x"), f"{folder}/new/deep/t").count() == 1


def test_rows_are_counted_by_the_write_itself(spark, folder):
    seen = Observation()
    group = "counted-write"
    spark.sparkContext.setJobGroup(group, group)
    writers.materialise(spark.range(1000, numPartitions=4).toDF("x"), f"{folder}/t", rows=seen)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    assert seen.get["row_count"] == 1000
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == len(jobs) == 1
    spark.sparkContext.setJobGroup("", "")


def test_headers_of_a_thousand_files_are_one_job(spark, folder):
    names = [("product_id", "product_name", "aisle_id", "department_id"), ("aisle_id", "department_id", "product_name", "product_id")]
    for i in range(1000):
        row = {"product_id": i, "product_name": f'"a, {i}"', "aisle_id": 1, "department_id": 2}
        write(f"{folder}/many files/p%{i}.csv", ",".join(names[i % 2]) + "\n" + ",".join(str(row[c]) for c in names[i % 2]) + "\n")
    write(f"{folder}/many files/empty.csv", "")
    group = "headers"
    spark.sparkContext.setJobGroup(group, group)
    found = readers._headers(spark, readers._files_of(spark, f"{folder}/many files"))
    # Spark lists so many paths by a job of its own; one more reads all headers.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 2
    spark.sparkContext.setJobGroup("", "")
    assert len(found) == 1001 and sorted(set(found.values())) == sorted({(), *names})
    table = readers.read_csv(spark, f"{folder}/many files", schemas.PRODUCTS)
    assert table.count() == 1000 and table.where("product_name <> concat('a, ', product_id) OR aisle_id <> 1").count() == 0


def test_a_header_is_found_in_a_file_of_many_pieces(spark, folder):
    write(f"{folder}/big.csv", "product_id,product_name,aisle_id,department_id\n" + "".join(f"{i},n{i},1,2\n" for i in range(200_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        found = readers._headers(spark, readers._files_of(spark, f"{folder}/big.csv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert list(found.values()) == [("product_id", "product_name", "aisle_id", "department_id")]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_stream_takes_each_file_once(spark, folder):
    source, table, state = f"{folder}/in", f"{folder}/out", f"{folder}/state"
    df = months(spark, 6)
    df.where("id < 2").coalesce(1).write.parquet(source)
    for _ in range(2):
        incremental.load_new_files(spark, source, df.schema, table, state, "t")
    assert incremental.loaded(spark, table).count() == 2
    df.where("id >= 2").coalesce(1).write.mode("append").parquet(source)
    incremental.load_new_files(spark, source, df.schema, table, state, "t")
    assert incremental.loaded(spark, table).count() == 6
    assert sorted(r[0] for r in incremental.loaded(spark, table).select(F.col("month").cast("string")).distinct().collect()) == [
        "2024-01", "2024-02", "2024-03"]


def test_quotes_are_doubled_and_each_file_orders_its_columns(spark, folder):
    write(f"{folder}/products/a.csv", 'product_id,product_name,aisle_id,department_id\n1,"8"" Pie, frozen",3,4\n')
    write(f"{folder}/products/b.csv", 'aisle_id,department_id,product_name,product_id\n5,6,"Salt",2\n')
    rows = sorted(readers.read_csv(spark, f"{folder}/products", schemas.PRODUCTS).collect())
    assert [tuple(r) for r in rows] == [(1, '8" Pie, frozen', 3, 4), (2, "Salt", 5, 6)]
    write(f"{folder}/lines.csv", 'product_id,product_name,aisle_id,department_id\n1,"two\nlines",3,4\n')
    assert readers.read_csv(spark, f"{folder}/lines.csv", schemas.PRODUCTS, multi_line=True).first().product_name == "two\nlines"


def test_rows_of_any_month_and_of_none_are_loaded(spark, folder):
    df = months(spark, 3).union(spark.sql("select 9L, timestamp_ntz'1987-05-06 00:00:00'")).union(
        spark.sql("select 10L, cast(null as timestamp_ntz)"))
    found = writers.months_of(df, "t")
    assert found == ["1987-05", "2024-01", "2024-02", None]
    path = f"{folder}/all"
    writers.load_months(df, path, "t", found[:2])
    assert writers.load_months(df, path, "t", found) == ["2024-02", None]
    assert writers.months_present(spark, path) == set(found) and spark.read.parquet(path).count() == 5
    assert writers.load_months(df, path, "t", found) == []


def test_a_cluster_must_name_shared_storage():
    assert is_local("local") and is_local("local[8]")
    assert not is_local("local-cluster[2,1,1024]") and not is_local("yarn")

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
