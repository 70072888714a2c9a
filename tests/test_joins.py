"""Joins on heavy keys: the same rows as plain joins, and even tasks without adaptive splitting."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import joins
from fieldtally.plans import enriched


@pytest.fixture
def plain(spark):
    """Neither adaptive execution nor automatic broadcasts, and enough partitions to stand out."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def facts(spark, n=30_000):
    """A third of all rows share one key, a tenth has none."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 != 1, F.col("id") % 4001)
    return spark.range(n).select(key.cast("int").alias("k"), F.col("id").alias("v"), F.array("id").alias("more"))


def sizes(df):
    return [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_largest_task_is_near_the_median(plain):
    fact, dim = facts(plain), plain.range(5000).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w"))
    uneven = sizes(fact.join(dim, "k", "left"))
    even = sizes(joins.spread_join(fact, dim, ["k"], "left"))
    assert max(uneven) > 5 * median(uneven) and max(even) < 1.5 * median(even) and sum(even) == 30_000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_rows_equal_plain_ones(plain, how):
    fact = facts(plain, 3000).unionByName(facts(plain, 5))
    dim = plain.range(8000).select((F.col("id") % 3000).cast("int").alias("k"), F.col("id").alias("w")).where("w % 5 > 0")
    want, got = fact.join(dim, "k", how), joins.spread_join(fact, dim, ["k"], how)
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_heavy_keys_are_measured(spark):
    found = {r.k: r._pieces for r in joins.heavy_keys(facts(spark), ["k"], 20).collect()}
    assert set(found) == {7, None} and 6 <= found[7] <= 8
    assert joins.heavy_keys(facts(spark).limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError, match="cannot repeat"):
        joins.spread_join(facts(spark), facts(spark), ["k"], "full")


def test_dimensions_are_broadcast_only_behind_a_count(plain):
    fact, dim = facts(plain, 500), plain.range(50).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("w"))
    small, large = joins.dimension_join(fact, dim, ["k"]), joins.dimension_join(fact, dim, ["k"], limit=49)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (small, large)]
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]
    assert small.exceptAll(large).count() == large.exceptAll(small).count() == 0


def test_enriched_trips_do_not_depend_on_the_way(plain, sf):
    from fieldtally.plans import bindings as B
    from fieldtally.plans import queries, staging

    trips, zones = staging.trips(queries._trips(plain, sf)), staging.zones(queries._zones(plain, sf))
    broadcast = enriched.trips_enriched(trips, zones, *B.SCOPE)
    spread = enriched.trips_enriched(trips, zones, *B.SCOPE, broadcast_rows=10)
    assert "_piece" in spread._jdf.queryExecution().executedPlan().toString()
    assert broadcast.count() == spread.count() > 0 and broadcast.exceptAll(spread).count() == 0
