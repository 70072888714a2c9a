"""Demand, funnel and unit-economics questions over one row per trip or event.

Every operator aggregates the fact on its own keys first and joins dimensions
to the small result, so a fact row is never shuffled just to pick up a name.
Sorting is left to the reader except where it decides which rows are kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions import columns as C
from fieldtally.operators import ordering
from fieldtally.session import cut_lineage


def daily_counts(df: DataFrame, ts: str, *, day: str = "trip_date", weekday: str | None = "day_of_week",
                 count: str = "trip_count") -> DataFrame:
    """Rows per calendar day, with the weekday's full name."""
    counted = df.groupBy(F.to_date(ts).alias(day)).agg(F.count(F.lit(1)).alias(count))
    if weekday is None:
        return counted
    return counted.select(day, C.weekday_name(day).alias(weekday), count)


def category_label_counts(df: DataFrame, code: str, labels: Mapping[str, str], *, label: str = "provider_name",
                          count: str = "provider_count") -> DataFrame:
    """Rows per label; codes without a label are kept together under NULL."""
    return df.groupBy(C.labelled(code, labels).alias(label)).agg(F.count(F.lit(1)).alias(count))


def flag_funnel_rates(df: DataFrame, by: Column, requested: Column, matched: Column, *,
                      label: str = "provider_name") -> DataFrame:
    """Request rate, match rate and match efficiency of a two-step funnel per group."""
    steps = df.groupBy(by.alias(label)).agg(
        C.count_where(requested).alias("requested_count"),
        C.count_where(matched).alias("matched_count"),
        F.count(F.lit(1)).alias("total_trips"),
    )
    asked, met, total = F.col("requested_count"), F.col("matched_count"), F.col("total_trips")
    return steps.select(
        "*",
        C.guarded_ratio(asked, total).alias("request_rate"),
        C.guarded_ratio(met, total).alias("match_rate"),
        C.guarded_ratio(met, asked).alias("match_efficiency"),
    )


def distribution_profile(df: DataFrame, duration: str, start: str, end: str, *, long_after: int = 4 * 3600,
                         tolerance: int = 60) -> DataFrame:
    """Exact quantiles of a duration in seconds with its three quality counters.

    The counters are: not positive, longer than ``long_after``, and further
    than ``tolerance`` from the time between the two timestamps.  One pass over
    the fact reduces it to its distinct durations, which answer everything.
    """
    mismatch = F.abs(F.col(duration) - C.elapsed_seconds(start, end)) > tolerance
    values = ordering.stamped_counts(df, duration, F.count(F.when(mismatch, F.lit(1))).alias("_mismatch"))
    quantiles = ordering.quantiles_of_counts(values, duration, {"median_sec": 0.5, "p90_sec": 0.9, "p99_sec": 0.99})
    found = quantiles.select(F.struct("*").alias("q")).scalar()

    def rows_where(test: Column) -> Column:
        return F.sum(F.when(test, F.col("_n")).otherwise(0))

    counters = values.agg(
        F.sum("_n").alias("total_trips"),
        F.min(duration).alias("min_sec"),
        F.max(duration).alias("max_sec"),
        rows_where(F.col(duration) <= 0).alias("zero_or_negative_trips"),
        rows_where(F.col(duration) > long_after).alias("over_4_hour_trips"),
        F.sum("_mismatch").alias("trip_time_mismatch_trips"),
    ).withColumn("q", found)

    def minutes(name: str) -> Column:
        return F.round(F.col(f"q.{name}_sec") / F.lit(60.0), 1).alias(f"{name}_min")

    return counters.select(
        "total_trips",
        F.col("q.median_sec").alias("median_sec"), minutes("median"),
        F.col("q.p90_sec").alias("p90_sec"), minutes("p90"),
        F.col("q.p99_sec").alias("p99_sec"), minutes("p99"),
        "min_sec", "max_sec",
        F.round(F.col("max_sec") / F.lit(3600.0), 1).alias("max_hours"),
        "zero_or_negative_trips", "over_4_hour_trips", "trip_time_mismatch_trips",
    )


def _rows(weight: str | None) -> Column:
    """Number of rows, or of those that ``weight`` says each row stands for."""
    return (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n")


def _per_key(df: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    return df.groupBy(F.col(key).alias("_key")).agg(_rows(weight))


def _labelled_counts(per_key: DataFrame, dim: DataFrame, dim_key: str, labels: Mapping[str, str],
                     count: str) -> DataFrame:
    """Rows per dimension label.  Several keys may share a label; keys without a match drop out."""
    names = dim.select(F.col(dim_key).alias("_key"), *[F.col(src).alias(out) for src, out in labels.items()])
    return per_key.join(names, "_key").groupBy(*labels.values()).agg(F.sum("_n").alias(count))


def _largest(df: DataFrame, count: str, labels: Mapping[str, str], k: int) -> DataFrame:
    return df.orderBy(F.desc(count), *[F.asc_nulls_last(c) for c in labels.values()]).limit(k)


def topk_share(df: DataFrame, key: str, dim: DataFrame, dim_key: str, labels: Mapping[str, str], *, k: int = 10,
               count: str = "trip_count", share: str = "pct_of_all_trips", digits: int | None = 2,
               weight: str | None = None) -> DataFrame:
    """The k largest labels and their percentage of all rows, matched or not.

    ``weight`` is the number of rows each row stands for, where they were counted before.
    """
    # The join below filters keys, the total does not, so the planner would read
    # the fact for each.  Cut here, it is read once, down to one row per key.
    per_key = cut_lineage(_per_key(df, key, weight))
    total = per_key.agg(F.sum("_n")).scalar()
    top = _largest(_labelled_counts(per_key, dim, dim_key, labels, count), count, labels, k)
    return top.withColumn(share, C.percent(F.col(count), total, digits))


def fee_share(df: DataFrame, fee: str, *, digits: int | None = 2) -> DataFrame:
    """Share of rows paying a positive fee; a missing fee is not a payment."""
    return df.agg(
        F.count(F.lit(1)).alias("total_trips"),
        C.count_where(F.col(fee) > 0).alias("fee_paying_trips"),
    ).withColumn("pct_paying_fee", C.percent(F.col("fee_paying_trips"), F.col("total_trips"), digits))


def fee_top_origins(df: DataFrame, fee: str, key: str, dim: DataFrame, dim_key: str, labels: Mapping[str, str], *,
                    k: int = 10, count: str = "fee_paying_trip_count", weight: str | None = None) -> DataFrame:
    """The k labels where most fee-paying rows start; ``weight`` as in ``topk_share``."""
    paying = _per_key(df.where(F.col(fee) > 0), key, weight)
    return _largest(_labelled_counts(paying, dim, dim_key, labels, count), count, labels, k)


def ratio_of_sums_by_hour(df: DataFrame, ts: str, pay: str, fare: str, rider_cost: Sequence[str], *,
                          digits: int | None = 2) -> DataFrame:
    """Pay as a share of fare and of everything the rider paid, per hour of day.

    Both shares divide sums.  A row with one missing payment column has no
    rider cost but still counts, and its pay and fare still add up.
    """
    sums = df.groupBy(F.hour(ts).cast("bigint").alias("hour_of_day")).agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.sum(pay).alias("_pay"),
        F.sum(fare).alias("_fare"),
        F.sum(C.row_total(rider_cost)).alias("_cost"),
    )

    def shown(c: str) -> Column:
        return F.col(c) if digits is None else F.round(c, digits)

    return sums.select(
        "hour_of_day",
        "trip_count",
        shown("_pay").alias("total_driver_pay"),
        shown("_fare").alias("total_base_fare"),
        shown("_cost").alias("total_rider_cost"),
        C.percent(F.col("_pay"), F.col("_cost"), digits).alias("naive_driver_share_pct"),
        C.percent(F.col("_pay"), F.col("_fare"), digits).alias("driver_share_of_fare_pct"),
    )


def pair_counts(df: DataFrame, origin: str, destination: str, dim: DataFrame, dim_key: str, label: str, *,
                origin_as: str = "pickup_zone", destination_as: str = "dropoff_zone",
                count: str = "trip_count", weight: str | None = None) -> DataFrame:
    """Rows per (origin label, destination label), the dimension playing both roles; ``weight`` as in ``topk_share``."""
    counted = df.groupBy(F.col(origin).alias("_from"), F.col(destination).alias("_to")).agg(_rows(weight))
    start = dim.select(F.col(dim_key).alias("_from"), F.col(label).alias(origin_as))
    finish = dim.select(F.col(dim_key).alias("_to"), F.col(label).alias(destination_as))
    return (
        counted.join(start, "_from").join(finish, "_to")
        .groupBy(origin_as, destination_as)
        .agg(F.sum("_n").alias(count))
    )


def topn_per_group(df: DataFrame, group: str, by: str, tie_break: str, n: int, *, rank: str) -> DataFrame:
    """The n rows of each group with the largest ``by``.

    The planner turns the filter into a per-task limit ahead of the shuffle,
    so a group reaches its task with at most n rows from each map task.
    """
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(by), F.asc_nulls_last(tie_break))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_destinations(df: DataFrame, origin: str, destination: str, dim: DataFrame, dim_key: str, label: str, *,
                     n: int = 3, weight: str | None = None) -> DataFrame:
    """The n most frequent destinations of each origin."""
    pairs = pair_counts(df, origin, destination, dim, dim_key, label, weight=weight)
    return topn_per_group(pairs, "pickup_zone", "trip_count", "dropoff_zone", n, rank="dropoff_rank")


def weekday_weekend_curve(df: DataFrame, ts: str) -> DataFrame:
    """Average rows per weekday and per weekend day, for each hour of day.

    The fact is read once, to one row per day and hour; both day counts and
    the curve come from that small table.
    """
    cells = cut_lineage(df.groupBy(F.to_date(ts).alias("_day"), F.hour(ts).cast("bigint").alias("hour_of_day")).agg(
        F.count(F.lit(1)).alias("_n"))).withColumn("_weekend", C.is_weekend("_day"))
    days = cells.agg(
        F.struct(
            F.countDistinct(F.when(F.coalesce("_weekend", F.lit(False)), F.col("_day"))).alias("weekend"),
            F.countDistinct(F.when(~F.coalesce("_weekend", F.lit(False)), F.col("_day"))).alias("weekday"),
        )
    ).scalar()
    hours = cells.groupBy("hour_of_day").agg(
        F.sum(F.when(~F.col("_weekend"), F.col("_n")).otherwise(0)).alias("_weekday"),
        F.sum(F.when(F.col("_weekend"), F.col("_n")).otherwise(0)).alias("_weekend"),
    ).withColumn("_days", days)
    return hours.select(
        "hour_of_day",
        F.round(C.guarded_ratio(F.col("_weekday"), F.col("_days.weekday"))).alias("avg_weekday_trips"),
        F.round(C.guarded_ratio(F.col("_weekend"), F.col("_days.weekend"))).alias("avg_weekend_trips"),
    )


def rolling_mean(daily: DataFrame, day: str, value: str, *, rows: int = 7, out: str = "rolling_7d_avg",
                 digits: int | None = 0) -> DataFrame:
    """Trailing mean over the last ``rows`` rows; the first rows use what there is.

    Expects one row per day, so the single-task window sees a calendar's
    length, not the fact.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last(day)).rowsBetween(-(rows - 1), 0)
    mean = F.avg(value).over(w)
    return daily.withColumn(out, mean if digits is None else F.round(mean, digits))


def rolling_daily_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows per day with their trailing seven-row mean."""
    return rolling_mean(daily_counts(df, ts, weekday=None), "trip_date", "trip_count")
