from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import panel


def test_incidence_at_exactly_the_edges(spark):
    # Fee-paying rows out of 20: 19 = 95 %, 18, 6 = 30 %, 5.
    rows = [(z, 1.5 if i < paid else (0.0 if i % 2 else None)) for z, paid in
            ((1, 19), (2, 18), (3, 6), (4, 5), (5, 20), (6, 20)) for i in range(20)]
    dim = spark.createDataFrame([(1, "Core"), (2, "Core"), (3, "Core"), (4, "Core"), (5, "Ring"), (6, "Away"),
                                 (7, "Core")], "id int, area string")
    out = panel.incidence_classification(
        spark.createDataFrame(rows, "zone int, fee double"), "zone", "fee", dim, "id", area="area",
        core=["Core"], outer=["Ring"]).orderBy("id").collect()
    assert [(r.id, r.pct_fee_charged, r.zone_group) for r in out] == [
        (1, 95.0, "treatment"), (2, 90.0, "border_exclude"), (3, 30.0, "border_exclude"),
        (4, 25.0, "manhattan_north_control"), (5, 100.0, "outer_borough_control"), (6, 100.0, "exclude_other")]


def test_panel_rows_dates_and_unclassified_units(spark):
    at = [datetime(2025, 1, 4, 23, 59), datetime(2025, 1, 5), datetime(2025, 1, 31, 9), datetime(2025, 2, 1),
          datetime(2024, 12, 31), datetime(2025, 1, 1)]
    trips = spark.createDataFrame([(t, z, 2.0, 1.0) for t in at for z in (1, 2, 3)] + [(at[1], 1, None, 5.0)],
                                  "t timestamp_ntz, z int, fare double, pay double")
    classes = spark.createDataFrame([(1, "One", "X", "treatment"), (2, "Two", "X", "border_exclude")],
                                    "id int, zone string, borough string, zone_group string")
    out = panel.did_panel(trips, "t", "z", "fare", "pay", classes, "id", policy="2025-01-05",
                          transition=("2025-01-01", "2025-02-01")).orderBy("trip_date").collect()
    assert [(str(r.trip_date), r.is_post, r.is_transition_month) for r in out] == [
        ("2024-12-31", 0, 0), ("2025-01-01", 0, 1), ("2025-01-04", 0, 1), ("2025-01-05", 1, 1),
        ("2025-01-31", 1, 1), ("2025-02-01", 1, 0)]
    assert {r.location_id for r in out} == {1} and out[3].trip_count == 2
    assert (out[3].total_base_fare, out[3].total_driver_pay) == (2.0, 6.0)


def cells(spark, seen, **more):
    rows = [(z, date(2024, 1, 1) + timedelta(days=d), *more.values()) for z, days in seen.items() for d in days]
    return spark.createDataFrame(rows, "location_id int, trip_date date" + "".join(f", {c} int" for c in more))


def test_presence_at_exactly_seven_tenths(spark):
    df = cells(spark, {1: range(10), 2: range(7), 3: range(6)})
    kept = panel.presence_filter(df, fraction=0.7).select("location_id").distinct().collect()
    assert sorted(r[0] for r in kept) == [1, 2]


def test_presence_uses_the_days_of_each_sample(spark):
    df = panel.with_specs(cells(spark, {1: range(10), 2: range(4)}), {
        "all": F.lit(True), "early": F.col("trip_date") <= "2024-01-04"})
    kept = panel.presence_filter(df, ["spec"], fraction=0.7).select("spec", "location_id").distinct().collect()
    assert sorted(map(tuple, kept)) == [("all", 1), ("early", 1), ("early", 2)]


def test_event_weeks_drop_partial_weeks_on_both_sides(spark):
    # Policy on the 10th day: weeks -2 (two days), -1, 0, 1 (one day).
    df = cells(spark, {1: range(17), 2: [3, 9]})
    out = panel.event_weeks(df, "2024-01-10").groupBy("week_relative").count().orderBy("week_relative").collect()
    assert [tuple(r) for r in out] == [(-1, 8), (0, 8)]


def test_indexed_series_has_base_mean_100_and_full_windows_only(spark):
    first = date(2024, 1, 1)
    rows = [(first + timedelta(days=d), g, float(d + 1) * k) for d in range(9) for g, k in (("a", 1), ("b", 3))]
    series = spark.createDataFrame(rows, "trip_date date, zone_group string, avg_trips_per_zone double")
    out = panel.indexed_series(series, ["a", "b"], "2024-01-01", "2024-01-05").orderBy("trip_date").collect()
    assert out[0].a_index == pytest.approx(100 / 3) and out[8].b_index == pytest.approx(300.0)
    assert [r.a_smooth for r in out] == [None] * 3 + [4.0, 5.0, 6.0] + [None] * 3
    assert sum(r.b_index for r in out[:5]) / 5 == pytest.approx(100.0)
