"""Unit-by-day panels, group series and the sample filters used before a regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions import columns as C

# Groups of the zone classification.
TREATMENT = "treatment"
BORDER = "border_exclude"
CORE_CONTROL = "manhattan_north_control"
OUTER_CONTROL = "outer_borough_control"
OUTSIDE = "exclude_other"


def incidence_classification(df: DataFrame, key: str, fee: str, dim: DataFrame, dim_key: str, *, area: str,
                             core: Sequence[str], outer: Sequence[str], treat_at: float = 95.0,
                             border_at: float = 30.0, digits: int | None = 1, keep: Sequence[str] = ()) -> DataFrame:
    """Treatment and control units from how often their rows pay a fee.

    In the core areas the incidence decides: treated, border or control.  The
    outer areas are control whatever their incidence, the rest is left out.
    The incidence stays as a column so the grouping can be audited.
    """
    paid = df.groupBy(F.col(key).alias(dim_key)).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(fee) > 0, F.lit(1))).alias("_paid"))
    pct = F.lit(100.0) * F.col("_paid") / F.col("_n")
    in_core = F.col(area).isin(list(core))
    group = (
        F.when(in_core & (pct >= treat_at), TREATMENT)
        .when(in_core & (pct >= border_at), BORDER)
        .when(in_core, CORE_CONTROL)
        .when(F.col(area).isin(list(outer)), OUTER_CONTROL)
        .otherwise(OUTSIDE)
    )
    return paid.join(dim.select(dim_key, area, *keep), dim_key).select(
        dim_key, *keep, area,
        (pct if digits is None else F.round(pct, digits)).alias("pct_fee_charged"),
        group.alias("zone_group"),
    )


def did_panel(df: DataFrame, ts: str, unit: str, fare: str, pay: str, classes: DataFrame, class_key: str, *,
              policy: C.Moment, transition: tuple[C.Moment, C.Moment], zone: str = "zone", area: str = "borough",
              groups: Sequence[str] = (TREATMENT, OUTER_CONTROL, CORE_CONTROL)) -> DataFrame:
    """One row per unit and day that has rows, with group and policy indicators.

    Days without rows have no panel row.  The fact is aggregated before the
    classification is joined, so the join sees the panel's size.
    """
    daily = df.groupBy(F.to_date(ts).alias("trip_date"), F.col(unit).alias("location_id")).agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.sum(fare).alias("total_base_fare"),
        F.sum(pay).alias("total_driver_pay"),
    )
    wanted = classes.where(F.col("zone_group").isin(list(groups))).select(
        F.col(class_key).alias("location_id"), F.col(zone).alias("zone_name"), F.col(area).alias("borough"),
        "zone_group")
    d = F.col("trip_date")
    return daily.join(wanted, "location_id").select(
        "trip_date", "location_id", "zone_name", "borough", "zone_group",
        "trip_count", "total_base_fare", "total_driver_pay",
        C.indicator(F.col("zone_group") == TREATMENT).alias("is_treatment"),
        C.indicator(d >= C.day(policy)).alias("is_post"),
        C.indicator((d >= C.day(transition[0])) & (d < C.day(transition[1]))).alias("is_transition_month"),
    )


def group_daily_series(panel: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group and day: all trips, units seen, and trips per unit seen."""
    return (
        panel.where(F.col("zone_group").isin(list(groups)))
        .groupBy("trip_date", "zone_group")
        .agg(F.sum("trip_count").alias("trip_count"), F.countDistinct("location_id").alias("n_zones"))
        .withColumn("avg_trips_per_zone", F.col("trip_count") / F.col("n_zones"))
    )


def indexed_series(series: DataFrame, groups: Sequence[str], first: C.Moment, last: C.Moment, *,
                   smooth: int = 7) -> DataFrame:
    """One row per day: level and index per group, raw and smoothed.

    The index is 100 at the mean of the group's daily values over the base
    period [first, last].  Smoothing is a centred mean, NULL where the window
    is not full.  Works on one row per day, hence the single-task window.
    """
    level = (
        series.groupBy("trip_date").pivot("zone_group", list(groups)).agg(F.first("avg_trips_per_zone"))
    )
    based = C.as_column("trip_date").between(C.day(first), C.day(last))
    everything = Window.partitionBy(F.lit(0))
    around = everything.orderBy("trip_date").rowsBetween(-(smooth // 2), smooth // 2)

    def smoothed(c: Column) -> Column:
        return F.when(F.count(c).over(around) == smooth, F.avg(c).over(around))

    indexed = level.withColumns({
        f"{g}_index": F.col(g) / F.avg(F.when(based, F.col(g))).over(everything) * 100.0 for g in groups})
    out: list[Column | str] = ["trip_date"]
    for g in groups:
        for name in (g, f"{g}_index"):
            out += [F.col(name), smoothed(F.col(name)).alias(f"{name}_smooth")]
    return indexed.select(*out)


def days_present(panel: DataFrame, by: Sequence[str] = (), *, unit: str = "location_id",
                 day: str = "trip_date") -> DataFrame:
    """Per sample and unit: its days, and the days of the whole sample."""
    by = list(by)
    present = panel.groupBy(*by, unit).agg(F.countDistinct(day).alias("days_present"))
    if not by:
        return present.withColumn("n_days", panel.agg(F.countDistinct(day)).scalar())
    lengths = panel.groupBy(*by).agg(F.countDistinct(day).alias("n_days"))
    # One row per sample.  A shuffle on the sample would put all its units in one task.
    return present.join(F.broadcast(lengths), by)


def presence_filter(panel: DataFrame, by: Sequence[str] = (), *, fraction: float = 0.7, unit: str = "location_id",
                    day: str = "trip_date") -> DataFrame:
    """Rows of units seen on at least ``fraction`` of the sample's days.

    ``by`` names the columns that tell samples apart; each has its own days.
    """
    kept = days_present(panel, by, unit=unit, day=day).where(
        F.col("days_present") >= F.lit(fraction) * F.col("n_days")).select(*by, unit)
    return panel.join(kept, [*by, unit], "left_semi")


def event_weeks(panel: DataFrame, policy: C.Moment, *, day: str = "trip_date", out: str = "week_relative") -> DataFrame:
    """Adds weeks since the policy date and keeps the weeks of which all seven days occur."""
    dated = panel.withColumn(out, C.weeks_since(day, policy))
    full = dated.groupBy(out).agg(F.countDistinct(day).alias("_days")).where(F.col("_days") == 7).select(out)
    # One row per calendar week.  A shuffle on the week would make as many tasks as weeks.
    return dated.join(F.broadcast(full), out, "left_semi")


def with_specs(panel: DataFrame, specs: dict[str, Column], out: str = "spec") -> DataFrame:
    """The panel once per named sample, a row being in every sample whose condition it meets."""
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in specs.items()]))
    return panel.withColumn(out, F.explode(names))
