import pytest
from pyspark.sql import functions as F

from fieldtally.operators import cohorts
from fieldtally.plans import marts


@pytest.fixture(scope="module")
def orders(spark):
    # user: gaps of orders 2, 3, ...
    histories = {1: [], 2: [7], 3: [8], 4: [14], 5: [15], 6: [21], 7: [22], 8: [29], 9: [30], 10: [30, 5], 11: [30, 30]}
    rows, order_id = [], 0
    for user, gaps in histories.items():
        for n, gap in enumerate([None, *gaps], start=1):
            order_id += 1
            held = "prior" if n <= len(gaps) else ("train" if user % 2 else "test")
            rows.append((order_id, user, held, n, None if gap is None else float(gap)))
    return spark.createDataFrame(
        rows, "order_id long, user_id long, eval_set string, order_number int, days_since_prior_order double")


@pytest.fixture(scope="module")
def items(orders):
    """Order n holds n items; the last orders count as train."""
    return orders.select(
        "order_id", "user_id", "order_number",
        F.when(F.col("eval_set") == "prior", "prior").otherwise("train").alias("source_eval_set"),
        F.explode(F.sequence(F.lit(1), F.col("order_number"))).alias("product_id")
    ).withColumn("reordered", (F.col("product_id") < F.col("order_number")).cast("int"))


def test_tiers_at_their_edges(orders):
    mart = {r.user_id: r for r in cohorts.recency_frequency(orders).select(
        "*", cohorts.recency_tier("recency_days").alias("t")).collect()}
    assert "".join(mart[u].t[0] for u in range(1, 12)) == "AABBCCDDEAE"
    assert mart[1].recency_days is None and mart[1].total_orders == 1


def test_user_mart_keeps_users_without_prior_items(orders, items):
    mart = {r.user_id: r for r in marts.user_rfm(orders, items).collect()}
    assert len(mart) == 11
    assert mart[1].monetary_proxy_items == 0 and mart[11].monetary_proxy_items == 3


def test_segmentation_drops_users_without_prior_items_but_counts_them_in_the_share(orders, items):
    prior = items.where("source_eval_set = 'prior'")
    out = {r.recency_tier[0]: r for r in cohorts.rfm_segmentation(orders, prior).collect()}
    assert sum(r.n_users for r in out.values()) == 10
    assert out["A"].n_users == 2 and out["A"].pct_of_users == 18.18
    assert out["E"].avg_orders == 2.5


def test_gaps_split_into_terminal_and_recovered(orders):
    r = cohorts.churn_gap_recovery(orders).first()
    assert tuple(r) == (4, 2, 2, 50.0)
    none = cohorts.churn_gap_recovery(orders, cap=99).first()
    assert tuple(none) == (0, None, None, None)


def test_terminal_gaps_are_the_at_risk_tier(orders, items):
    at_risk = marts.user_rfm(orders, items).where("recency_tier like 'E%'").count()
    assert cohorts.churn_gap_recovery(orders).first().terminal_gaps == at_risk


def test_first_orders_never_contain_a_reorder(items):
    rates = {r.order_number: r for r in cohorts.reorder_rate_by(items).collect()}
    assert rates[1].reorder_rate_pct == 0.0
    rows = {r.scope: r for r in cohorts.reorder_rate_summary(items).collect()}
    whole, later = rows[cohorts.SCOPE_ALL], rows[cohorts.SCOPE_REPEAT]
    assert whole.reordered_items == later.reordered_items
    assert whole.total_items - later.total_items == rates[1].total_items


def test_retention_never_rises(orders):
    out = cohorts.sequence_retention(orders).orderBy("order_number").collect()
    assert [r.n_users_reaching for r in out] == [11, 10, 2]
    assert out[0].pct_of_all_users == 100.0


def test_checkpoint_sums_equal_the_running_sum(orders, items):
    want = {r.order_number: r.avg_cumulative_items_prior for r in cohorts.mean_running_volume(items).collect()}
    got = cohorts.cumulative_by_tenure(items, [1, 2, 3, 50], digits=None).collect()
    assert want == {1: 1.0, 2: 3.0, 3: 6.0}
    assert {r.order_number: r.avg_cumulative_items for r in got} == want
    assert {r.order_number: r.n_users_at_this_point for r in got} == {1: 11, 2: 10, 3: 2}


def test_sequence_mart_joins_left(orders, items):
    out = marts.order_sequence_summary(
        orders, items.where("order_number < 3").withColumn("is_reordered", F.col("reordered") == 1))
    last = out.where("order_number = 3").first()
    assert (last.n_users_reaching, last.total_items, last.avg_cumulative_items_prior) == (2, None, None)


def test_leaderboard_floor_is_inclusive_and_ties_are_ordered(spark):
    items = spark.createDataFrame(
        [(1, 1)] * 3 + [(2, 1)] * 3 + [(3, 0)] * 3 + [(4, 1)] * 2, "product_id long, reordered int")
    products = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "d")], "product_id long, product_name string")
    out = cohorts.reorder_leaderboard(items, products, floor=3, k=2).collect()
    assert sorted(map(tuple, out)) == [("a", 3, 100.0), ("b", 3, 100.0)]
    assert cohorts.reorder_leaderboard(items, products, floor=3, k=None).count() == 3


def test_composition_shares_are_of_all_items(spark):
    items = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (9, 0)], "product_id long, reordered int")
    products = spark.createDataFrame([(1, 10), (2, 20)], "product_id long, department_id long")
    departments = spark.createDataFrame([(10, "x"), (20, "y")], "department_id long, department string")
    out = cohorts.basket_composition(items, products, departments).collect()
    assert sorted(map(tuple, out)) == [("x", 2, 50.0, 50.0), ("y", 1, 25.0, 0.0)]
