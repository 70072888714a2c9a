from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import columns as C
from fieldtally.functions import distributions as dist


def one(spark, **expressions):
    return spark.range(1).toDF("i").select(*[e.alias(n) for n, e in expressions.items()]).first()


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_elapsed_seconds_counts_boundaries(spark):
    row = one(
        spark,
        crossing=C.elapsed_seconds(ts("2024-01-01 00:00:00.9"), ts("2024-01-01 00:00:01.1")),
        inside=C.elapsed_seconds(ts("2024-01-01 00:00:01.1"), ts("2024-01-01 00:00:01.9")),
        back=C.elapsed_seconds(ts("2024-01-01 00:00:01.1"), ts("2024-01-01 00:00:00.9")),
        missing=C.elapsed_seconds(F.lit(None).cast("timestamp_ntz"), ts("2024-01-01 00:00:00")),
    )
    assert (row.crossing, row.inside, row.back, row.missing) == (1, 0, -1, None)


def test_local_times_in_a_daylight_saving_gap_keep_their_clock(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = one(
            spark,
            gap=C.elapsed_seconds(ts("2025-03-09 01:59:00"), ts("2025-03-09 02:30:00")),
            name=C.weekday_name(ts("2025-03-09 02:30:00")),
            hour=F.hour(ts("2025-03-09 02:30:00")),
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (row.gap, row.name, row.hour) == (31 * 60, "Sunday", 2)


def test_labels_flags_and_tiers_keep_nulls_apart(spark):
    rows = spark.createDataFrame([("a", "Y", 0.0), ("x", "N", 1.5), (None, None, None)], "code string, f string, fee double")
    out = rows.select(
        C.labelled("code", {"a": "Alpha"}).alias("label"), C.yes_flag("f").alias("flag"),
        (F.col("fee") > 0).alias("paid"),
        C.tiered("fee", [(F.col("fee") >= 1, "high")], "rest").alias("tier")).collect()
    assert [tuple(r) for r in out] == [
        ("Alpha", True, False, "rest"), (None, False, True, "high"), (None, None, None, "rest")]


def test_count_where_on_empty_input_is_null(spark):
    empty = spark.createDataFrame([], "x int")
    assert empty.agg(C.count_where(F.col("x") > 0)).first()[0] is None


def test_day_type_and_missing_timestamp(spark):
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (5, 6, 7, 8)] + [(None,)], "d date")
    assert [r[0] for r in days.select(C.day_type("d")).collect()] == [
        "weekday", "weekend", "weekend", "weekday", "weekday"]


def test_half_open_range_and_closed_exclusion(spark):
    at = [datetime(2024, 1, 1), datetime(2024, 1, 31, 23, 59, 59, 999999), datetime(2024, 2, 1)]
    df = spark.createDataFrame([(t,) for t in at], "t timestamp_ntz")
    assert df.where(C.within("t", "2024-01-01", "2024-02-01")).count() == 2
    assert df.where(C.within("t", None, None)).count() == 3
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (9, 10, 11, 12)], "d date")
    assert [r[0].day for r in days.where(C.outside_days("d", "2024-01-10", "2024-01-11")).collect()] == [9, 12]


def test_range_reaches_the_parquet_scan(spark, folder):
    spark.createDataFrame([(datetime(2024, 1, 1), 1)], "t timestamp_ntz, x int").write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t").where(C.within("t", "2024-01-01", "2024-02-01")).select("t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t" in plan and "x" not in plan.split("ReadSchema")[1]


def test_guards_and_row_totals(spark):
    df = spark.createDataFrame([(1, 0, 2.0, None), (1, 4, 2.0, 3.0)], "a int, b int, c double, d double")
    out = df.select(C.percent(F.col("a"), F.col("b")), C.guarded_ratio(F.col("a"), F.col("b")),
                    C.row_total(["c", "d"])).collect()
    assert [tuple(r) for r in out] == [(None, None, None), (25.0, 0.25, 5.0)]


@pytest.mark.parametrize("day, week", [
    ("2025-01-05", 0), ("2025-01-04", -1), ("2025-01-11", 0), ("2025-01-12", 1), ("2024-12-29", -1), ("2024-12-28", -2)])
def test_weeks_are_floored(spark, day, week):
    assert one(spark, w=C.weeks_since(F.lit(day).cast("date"), "2025-01-05")).w == week


def test_distribution_helpers_match_published_tables():
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert dist.t_quantile(0.975, 1) == pytest.approx(12.7062047, abs=1e-6)
    assert dist.t_quantile(0.975, 1e6) == pytest.approx(1.9599664, abs=1e-5)
    assert dist.t_two_sided_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert dist.normal_two_sided_p(1.959963985) == pytest.approx(0.05, abs=1e-9)
