import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldtally.operators import ordering


@pytest.fixture(scope="module")
def tied(spark):
    """A third of all rows share one value; some values are missing."""
    rng = random.Random(7)
    rows = [(i, 5 if i % 3 == 0 else rng.choice([None, 1, 2, 9, 11, 40])) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, v int").repartition(7)


def test_global_rank_equals_the_one_task_window(tied):
    order = [F.col("v").asc_nulls_last(), F.col("id").asc()]
    want = tied.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    got = ordering.global_rank(tied, order)
    assert got.agg(F.max("total")).first()[0] == 2000
    assert got.drop("total").exceptAll(want).count() == 0


@pytest.mark.parametrize("buckets", [1, 3, 5, 7, 1999, 2000])
def test_ntile_equals_the_built_in(tied, buckets):
    order = [F.col("v").asc_nulls_last(), F.col("id").asc()]
    want = tied.withColumn("b", F.ntile(buckets).over(Window.orderBy(*order)))
    assert ordering.ntile(tied, buckets, order, "b").exceptAll(want).count() == 0


def test_ntile_with_more_buckets_than_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(3)], "id int")
    assert sorted(tuple(r) for r in ordering.ntile(df, 5, [F.col("id")], "b").collect()) == [(0, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [3.0, 1.0, 2.0, 10.0], [5.0] * 50 + [7.0], list(np.random.default_rng(3).normal(size=1001))])
def test_exact_quantiles_interpolate(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    qs = {"lo": 0.0, "q1": 0.1, "med": 0.5, "p99": 0.99, "hi": 1.0}
    got = ordering.exact_quantiles(df, "v", qs).first()
    for name, q in qs.items():
        assert got[name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12)


def test_quantiles_of_nothing_are_null(spark):
    got = ordering.exact_quantiles(spark.createDataFrame([], "v double"), "v", {"m": 0.5}).collect()
    assert [r.m for r in got] == [None]


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_split_keys_give_the_same_sequence(spark, partitions):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        key = rng.choice(["hot", "hot", "hot", None, "a", "b", "c", f"k{i}"])
        rows.append((key, i // 3, i, rng.choice([None, 1, 2, 3])))
    df = spark.createDataFrame(rows, "k string, t int, id int, x int").repartition(6)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select(
        "*", F.row_number().over(w).alias("n"), F.lag("x").over(w).alias("px"), F.lag("t").over(w).alias("pt"),
        F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sx"),
        F.lead("id").over(w).isNull().alias("end"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.sequence_within(
            df, ["k"], [F.col("t").asc(), F.col("id").asc()], number="n", previous={"px": "x", "pt": "t"},
            running={"sx": "x"}, last="end").select(*want.columns)
        assert got.count() == 1500
        assert got.exceptAll(want).count() == 0
        if partitions == 40:  # the hot key, a third of all rows and more, lies in many tasks
            stamped = ordering.stamp_order(df, [F.col("k").asc(), F.col("t").asc(), F.col("id").asc()])
            assert stamped.where("k = 'hot'").select(ordering.SEGMENT).distinct().count() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sequences_of_no_rows_and_of_all_null_values(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 2, None)], "k string, t int, x int")
    for rows in (df, df.limit(0)):
        got = ordering.sequence_within(rows, ["k"], [F.col("t")], number="n", previous={"p": "x"}, running={"s": "x"}, last="e")
        assert [tuple(r) for r in got.orderBy("t").collect()] == [(None, 1, None, 1, None, None, False), (None, 2, None, 2, None, None, True)][:rows.count()]
