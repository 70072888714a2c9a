"""Totals that have to agree with each other on the test tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldtally.plans import bindings as B
from fieldtally.plans import queries as Q


def test_trip_totals_agree(spark, sf):
    q = Q.all_queries()
    total = q["daily_counts"](spark, sf).agg(F.sum("trip_count")).first()[0]
    assert total == q["category_label_counts"](spark, sf).agg(F.sum("provider_count")).first()[0]
    assert total == q["ratio_of_sums_by_hour"](spark, sf).agg(F.sum("trip_count")).first()[0]
    assert total == q["fee_share"](spark, sf).first().total_trips
    assert total == q["hourly_demand"](spark, sf).agg(F.sum("trip_count")).first()[0]


def test_order_sequences_are_complete(spark, sf):
    orders = B.orders(B.table(spark, sf, "orders")).cache()
    assert orders.count() == B.table(spark, sf, "orders").count()
    per_user = orders.groupBy("user_id").agg(
        F.count("*").alias("n"), F.max("order_number").alias("top"), F.countDistinct("order_number").alias("d"),
        F.count(F.when(F.col("eval_set") != "prior", 1)).alias("held"),
        F.count("days_since_prior_order").alias("gaps"))
    assert per_user.where("n <> top or n <> d or held <> 1 or gaps <> n - 1").count() == 0
    assert orders.agg(F.max("days_since_prior_order")).first()[0] == B.GAP_CAP
    reached = [r.n_users_reaching for r in Q.sequence_retention(spark, sf).orderBy("order_number").collect()]
    assert reached == sorted(reached, reverse=True)
    orders.unpersist()


def test_sequences_equal_plain_windows(spark, sf):
    raw = B.table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    want = raw.select(F.col("o_orderkey").alias("order_id"), F.row_number().over(w).alias("order_number"),
                      F.lag("o_orderdate").over(w).isNotNull().alias("later"))
    got = B.orders(raw).select("order_id", "order_number", F.col("days_since_prior_order").isNotNull().alias("later"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_terminal_gaps_and_volumes(spark, sf):
    churn = Q.churn_gap_recovery(spark, sf).first()
    assert churn.terminal_gaps + churn.recovered_gaps == churn.total_capped_gaps
    mart = Q.user_rfm(spark, sf)
    assert mart.where("recency_tier like 'E%'").count() == churn.terminal_gaps
    items = Q._items(spark, sf)
    assert items.count() == B.table(spark, sf, "lineitem").count()
    assert mart.agg(F.sum("monetary_proxy_items")).first()[0] == items.where("source_eval_set = 'prior'").count()


def test_no_plan_pairs_rows_without_a_key(spark, sf):
    for name, query in Q.all_queries().items():
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
