from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import columns as C
from fieldtally.operators import demand


@pytest.fixture(scope="module")
def zones(spark):
    # Two locations share one name.
    return spark.createDataFrame([(1, "Center", "M"), (56, "Corona", "Q"), (57, "Corona", "Q"), (9, "Edge", "S")],
                                 "id int, zone string, borough string")


def test_counts_and_shares_merge_ids_of_one_name_and_keep_unmatched_in_the_total(spark, zones):
    df = spark.createDataFrame([(1,)] * 3 + [(56,)] * 2 + [(57,)] * 2 + [(404,)] * 3, "loc int")
    out = demand.topk_share(df, "loc", zones, "id", {"zone": "zone", "borough": "borough"}, k=2).collect()
    assert sorted(map(tuple, out)) == [("Center", "M", 3, 30.0), ("Corona", "Q", 4, 40.0)]


def test_ties_at_the_cut_go_to_the_first_name(spark, zones):
    df = spark.createDataFrame([(1,), (9,)], "loc int")
    out = demand.topk_share(df, "loc", zones, "id", {"zone": "zone"}, k=1).collect()
    assert [r.zone for r in out] == ["Center"]


def test_top_destinations_with_fewer_than_n_and_ties(spark, zones):
    df = spark.createDataFrame([(1, 1)] * 2 + [(1, 56)] + [(1, 57)] + [(1, 9)] * 2 + [(9, 1)], "a int, b int")
    out = demand.top_destinations(df, "a", "b", zones, "id", "zone", n=2)
    assert sorted(map(tuple, out.collect())) == [
        ("Center", "Center", 2, 1), ("Center", "Corona", 2, 2), ("Edge", "Center", 1, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_funnel_without_requests_has_no_efficiency(spark):
    df = spark.createDataFrame([("a", "Y", "Y"), ("a", "Y", "N"), ("b", "N", "Y"), ("b", None, "N")],
                               "c string, rq string, mt string")
    out = {r.provider_name: r for r in demand.flag_funnel_rates(
        df, F.col("c"), C.yes_flag("rq"), C.yes_flag("mt")).collect()}
    assert (out["a"].request_rate, out["a"].match_rate, out["a"].match_efficiency) == (1.0, 0.5, 0.5)
    assert (out["b"].requested_count, out["b"].matched_count, out["b"].match_efficiency) == (0, 1, None)


def test_distribution_counters_at_their_edges(spark):
    at = datetime(2024, 1, 1)
    rows = [(0, 0), (-1, 0), (4 * 3600, 4 * 3600), (4 * 3600 + 1, 4 * 3600 + 1), (100, 160), (100, 161), (100, 40),
            (None, 10)]
    df = spark.createDataFrame([(d, at, at + timedelta(seconds=s)) for d, s in rows],
                               "d long, a timestamp_ntz, b timestamp_ntz")
    r = demand.distribution_profile(df, "d", "a", "b").first()
    assert r.total_trips == 8 and r.zero_or_negative_trips == 2 and r.over_4_hour_trips == 1
    assert r.trip_time_mismatch_trips == 1  # 61 s apart; 60 is tolerated
    assert (r.min_sec, r.max_sec, r.median_sec, r.median_min, r.max_hours) == (-1, 14401, 100.0, 1.7, 4.0)


def test_ratio_of_sums_with_missing_fee_and_zero_fare(spark):
    t = datetime(2024, 1, 1, 5)
    u = datetime(2024, 1, 1, 6)
    df = spark.createDataFrame([(t, 10.0, 20.0, 1.0), (t, 30.0, 20.0, None), (u, 5.0, 10.0, 0.0), (u, 5.0, -10.0, 0.0)],
                               "t timestamp_ntz, pay double, fare double, fee double")
    five, six = demand.ratio_of_sums_by_hour(df, "t", "pay", "fare", ["fare", "fee"]).orderBy("hour_of_day").collect()
    assert (five.trip_count, five.total_rider_cost, five.driver_share_of_fare_pct) == (2, 21.0, 100.0)
    assert five.naive_driver_share_pct == 190.48  # every row's pay over the one complete cost
    assert (six.total_base_fare, six.driver_share_of_fare_pct) == (0.0, None)


def test_rolling_mean_counts_rows_not_days(spark):
    days = [1, 2, 3, 5, 6, 7, 8, 9]  # the 4th is missing
    df = spark.createDataFrame([(datetime(2024, 1, d, 12),) for d in days for _ in range(d)], "t timestamp_ntz")
    out = demand.rolling_daily_counts(df, "t").orderBy("trip_date").collect()
    assert [r.rolling_7d_avg for r in out] == [1, 2, 2, 3, 3, 4, 5, 6]


def test_weekday_curve_divides_by_days_present(spark):
    # Friday and Monday at 8, Saturday at 8 twice, Sunday at 20.
    at = [(5, 8), (8, 8), (8, 8), (6, 8), (6, 8), (7, 20)]
    df = spark.createDataFrame([(datetime(2024, 1, d, h),) for d, h in at], "t timestamp_ntz")
    out = {r.hour_of_day: r for r in demand.weekday_weekend_curve(df, "t").collect()}
    assert (out[8].avg_weekday_trips, out[8].avg_weekend_trips) == (2.0, 1.0)  # 1.5 rounds up
    assert (out[20].avg_weekday_trips, out[20].avg_weekend_trips) == (0.0, 1.0)
