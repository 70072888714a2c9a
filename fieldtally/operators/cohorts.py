"""Retention, repeat purchase, recency and basket questions over order sequences.

``orders`` has one row per order with the user's running order number and the
days since that user's previous order; ``items`` has one row per ordered
product with that order's user and number attached.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import columns as C
from fieldtally.operators import ordering
from fieldtally.operators.distinct import count_distinct
from fieldtally.session import cut_lineage

# Scope names of the two summary rows.
SCOPE_ALL = "all orders (1st order included -- reorder=0 there by definition)"
SCOPE_REPEAT = "excluding each user's 1st order"

# Recency tiers, lower edge in days to name; the cap itself is tier E.
RECENCY_TIERS = (
    (22, "D: 22-29 days"),
    (15, "C: 15-21 days"),
    (8, "B: 8-14 days"),
)
RECENCY_CENSORED = "E: 30+ days (censored, at-risk)"
RECENCY_RECENT = "A: 0-7 days (very recent)"

# Order numbers at which cumulative volume is reported.
TENURE_CHECKPOINTS = (1, 5, 10, 15, 20, 30, 50, 75, 99)


def recency_tier(days: str | Column, *, cap: int = 30, tiers: Sequence[tuple[int, str]] = RECENCY_TIERS,
                 censored: str = RECENCY_CENSORED, recent: str = RECENCY_RECENT) -> Column:
    """Tier of the gap before the last order.  Gaps are capped, so the cap means "or more".

    A user with a single order has no gap and falls in the recent tier.
    """
    days = C.as_column(days)
    steps = [(days == cap, censored)] + [(days >= edge, name) for edge, name in tiers]
    return C.tiered(days, steps, recent)


def sequence_retention(orders: DataFrame, *, user: str = "user_id", number: str = "order_number",
                       digits: int | None = 2, approximate: float | None = None) -> DataFrame:
    """Users reaching each order number, and their share of all users.

    ``approximate`` counts users within that relative error instead of exactly.
    """
    everyone = orders.agg(count_distinct(user, approximate)).scalar()
    return (
        orders.groupBy(number).agg(count_distinct(user, approximate).alias("n_users_reaching"))
        .withColumn("pct_of_all_users", C.percent(F.col("n_users_reaching"), everyone, digits))
    )


def reorder_rate_summary(items: DataFrame, *, number: str = "order_number", reordered: str = "reordered",
                         digits: int | None = 2) -> DataFrame:
    """Reorder rate over all orders and without first orders, from one pass."""
    bought_again = F.col(reordered).cast("bigint")
    later = F.col(number) > 1
    both = items.agg(
        F.count(F.lit(1)).alias("_n"), F.sum(bought_again).alias("_r"),
        F.count(F.when(later, F.lit(1))).alias("_n2"), F.sum(F.when(later, bought_again)).alias("_r2"),
    )
    rows = F.explode(F.array(
        F.struct(F.lit(SCOPE_ALL).alias("scope"), F.col("_n").alias("n"), F.col("_r").alias("r")),
        F.struct(F.lit(SCOPE_REPEAT).alias("scope"), F.col("_n2").alias("n"), F.col("_r2").alias("r")),
    ))
    return both.select(rows.alias("row")).select(
        F.col("row.scope").alias("scope"),
        F.col("row.n").alias("total_items"),
        F.col("row.r").alias("reordered_items"),
        C.percent(F.col("row.r"), F.col("row.n"), digits).alias("reorder_rate_pct"),
    )


def reorder_rate_by(items: DataFrame, by: str = "order_number", *, reordered: str = "reordered",
                    digits: int | None = 2) -> DataFrame:
    """Items and reorder rate per group (per order number: the tenure curve)."""
    return items.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.sum(F.col(reordered).cast("bigint")).alias("_r"),
    ).select(by, "total_items", C.percent(F.col("_r"), F.col("total_items"), digits).alias("reorder_rate_pct"))


def latest_per_key(df: DataFrame, key: str, number: str, values: Sequence[str], *,
                   latest: str | None = None) -> DataFrame:
    """Values of each key's highest-numbered row, in one aggregation instead of a join to the maximum."""
    last = [F.max_by(v, number).alias(v) for v in values]
    first = [F.max(number).alias(latest)] if latest else []
    return df.groupBy(key).agg(*first, *last)


def recency_frequency(orders: DataFrame, *, user: str = "user_id", number: str = "order_number",
                      gap: str = "days_since_prior_order") -> DataFrame:
    """Orders per user and the gap before the last one."""
    return orders.groupBy(user).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.max_by(gap, number).alias("recency_days"),
    )


def rfm_scores(orders: DataFrame, prior_items: DataFrame, tier: Mapping | None = None, *, user: str = "user_id",
               number: str = "order_number", gap: str = "days_since_prior_order", buckets: int = 5) -> DataFrame:
    """Users who bought something in a prior order, with tier and frequency and volume scores."""
    volume = prior_items.groupBy(user).agg(F.count(F.lit(1)).alias("total_items_prior"))
    base = recency_frequency(orders, user=user, number=number, gap=gap).join(volume, user)
    base = base.withColumn("recency_tier", recency_tier("recency_days", **dict(tier or {})))
    scored = ordering.ntile(base, buckets, [F.col("total_orders").asc(), F.col(user).asc()], "frequency_score")
    return ordering.ntile(scored, buckets, [F.col("total_items_prior").asc(), F.col(user).asc()], "monetary_score")


def rfm_segmentation(orders: DataFrame, prior_items: DataFrame, tier: Mapping | None = None, *,
                     user: str = "user_id", digits: tuple[int, int] | None = (1, 2), **names) -> DataFrame:
    """Size and mean behaviour of each recency tier, as a share of all users with orders."""
    everyone = orders.agg(F.countDistinct(user)).scalar()
    scored = rfm_scores(orders, prior_items, tier, user=user, **names)

    def mean(c: str, n: int) -> Column:
        return F.avg(c) if digits is None else F.round(F.avg(c), digits[n])

    return scored.groupBy("recency_tier").agg(
        F.count(F.lit(1)).alias("n_users"),
        mean("total_orders", 0).alias("avg_orders"),
        mean("frequency_score", 1).alias("avg_frequency_score"),
        mean("total_items_prior", 0).alias("avg_items_prior"),
        mean("monetary_score", 1).alias("avg_monetary_score"),
    ).withColumn("pct_of_users", C.percent(F.col("n_users"), everyone, 2 if digits else None))


def churn_gap_recovery(orders: DataFrame, *, cap: int = 30, user: str = "user_id", number: str = "order_number",
                       gap: str = "days_since_prior_order", total: str = "total_30plus_day_gaps",
                       digits: int | None = 2) -> DataFrame:
    """How many capped gaps were the user's last and how many were followed by another order.

    A user has at most one terminal gap, the one before the last order, so one
    aggregation per user answers both without joining orders to their maximum.
    """
    per_user = orders.groupBy(user).agg(
        F.count(F.when(F.col(gap) == cap, F.lit(1))).alias("_gaps"),
        F.max_by(gap, number).alias("_last"),
    )
    totals = per_user.agg(
        F.coalesce(F.sum("_gaps"), F.lit(0)).alias(total),
        F.count(F.when(F.col("_last") == cap, F.lit(1))).alias("_terminal"),
    )
    some = F.col(total) > 0
    ended, back = F.col("_terminal"), F.col(total) - F.col("_terminal")
    return totals.select(
        total,
        F.when(some, ended).alias("terminal_gaps"),
        F.when(some, back).alias("recovered_gaps"),
        C.percent(back, F.col(total), digits).alias("pct_recovered"),
    )


def cumulative_by_tenure(items: DataFrame, checkpoints: Sequence[int] = TENURE_CHECKPOINTS, *,
                         user: str = "user_id", number: str = "order_number", product: str = "product_id",
                         digits: int | None = 1) -> DataFrame:
    """Mean cumulative items of the users who have an order at each checkpoint.

    With the checkpoints known up front, one conditional sum per checkpoint
    replaces the running sum: nothing has to be sorted, and a user with very
    many rows is still combined before the shuffle.
    """
    sums, marks = [], []
    for i, k in enumerate(checkpoints):
        sums.append(F.count(F.when(F.col(number) <= k, F.col(product))).alias(f"_s{i}"))
        sums.append(F.max(F.when(F.col(number) == k, F.lit(1))).alias(f"_at{i}"))
        marks.append(F.struct(F.lit(k).alias(number), F.col(f"_s{i}").alias("total"), F.col(f"_at{i}").alias("at")))
    reached = (
        items.groupBy(user).agg(*sums)
        .select(F.inline(F.array(*marks)))
        .where(F.col("at") == 1)
        .groupBy(number)
    )
    mean = F.avg("total")
    return reached.agg(
        F.count(F.lit(1)).alias("n_users_at_this_point"),
        (mean if digits is None else F.round(mean, digits)).alias("avg_cumulative_items"),
    )


def mean_running_volume(items: DataFrame, *, user: str = "user_id", number: str = "order_number",
                        out: str = "avg_cumulative_items_prior") -> DataFrame:
    """Mean running item count at every order number (the checkpoint list left open)."""
    per_order = items.groupBy(user, number).agg(F.count(F.lit(1)).alias("_n"))
    return mean_running_count(per_order, "_n", user=user, number=number, out=out)


def mean_running_count(per_order: DataFrame, count: str, *, user: str = "user_id", number: str = "order_number",
                       out: str = "avg_cumulative_items_prior") -> DataFrame:
    """The same from one row per order."""
    running = ordering.sequence_within(per_order, [user], [F.col(number).asc()], running={"_sum": count})
    return running.groupBy(number).agg(F.avg("_sum").alias(out))


def _per_product(items: DataFrame, product: str, reordered: str) -> DataFrame:
    return items.groupBy(product).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(reordered).cast("bigint")).alias("_r"))


def basket_composition(items: DataFrame, products: DataFrame, departments: DataFrame, *, k: int | None = 10,
                       product: str = "product_id", department: str = "department_id", label: str = "department",
                       reordered: str = "reordered", digits: int | None = 2) -> DataFrame:
    """Share of all items and reorder rate per department, optionally only the k largest."""
    counted = cut_lineage(_per_product(items, product, reordered))  # items are read once, for rows and total
    everything = counted.agg(F.sum("_n")).scalar()
    grouped = (
        counted.join(products.select(product, department), product)
        .groupBy(department).agg(F.sum("_n").alias("_n"), F.sum("_r").alias("_r"))
        .join(departments.select(department, label), department)
        .groupBy(label).agg(F.sum("_n").alias("total_items"), F.sum("_r").alias("_r"))
    )
    if k is not None:
        grouped = grouped.orderBy(F.desc("total_items"), F.asc_nulls_last(label)).limit(k)
    return grouped.select(
        label, "total_items",
        C.percent(F.col("total_items"), everything, digits).alias("pct_of_all_items"),
        C.percent(F.col("_r"), F.col("total_items"), digits).alias("reorder_rate_pct"),
    )


def reorder_leaderboard(items: DataFrame, products: DataFrame, *, floor: int = 1000, k: int | None = 10,
                        product: str = "product_id", label: str = "product_name", reordered: str = "reordered",
                        digits: int | None = 2) -> DataFrame:
    """Products bought at least ``floor`` times by reorder rate, optionally only the k highest."""
    ranked = (
        _per_product(items, product, reordered)
        .join(products.select(product, label), product)
        .groupBy(label).agg(F.sum("_n").alias("total_purchases"), F.sum("_r").alias("_r"))
        .where(F.col("total_purchases") >= floor)
        .select(label, "total_purchases",
                C.percent(F.col("_r"), F.col("total_purchases"), digits).alias("reorder_rate_pct"))
    )
    if k is None:
        return ranked
    return ranked.orderBy(F.desc("reorder_rate_pct"), F.asc_nulls_last(label)).limit(k)
