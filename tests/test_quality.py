import pytest
from pyspark.sql import functions as F

from fieldtally.operators import quality


def result(df):
    return [(r.failures, r.status) for r in df.collect()]


@pytest.mark.parametrize("bad, status", [(0, "pass"), (1, "warn"), (20, "warn"), (21, "error")])
def test_threshold_levels(spark, bad, status):
    df = spark.createDataFrame([(-1,)] * bad + [(1,), (None,)], "x int")
    assert result(quality.threshold(df, "t", "x", F.col("x") <= 0)) == [(bad, status)]


def test_row_checks_share_one_scan(spark, folder):
    spark.createDataFrame([("Y", 1), ("N", None), (None, 2), ("?", 3)], "f string, n int").write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    out = quality.row_checks(df, "t", not_null=["f", "n"], accepted={"f": ["Y", "N"]},
                             thresholds={"n": (F.col("n") > 1, 0, 1)})
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert [(r.check, r.column_name, r.failures, r.status) for r in out.collect()] == [
        ("not_null", "f", 1, "error"), ("not_null", "n", 1, "error"), ("accepted_values", "f", 1, "error"),
        ("threshold", "n", 2, "error")]


def test_unique_ignores_missing_values_and_combinations_do_not(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (None, 5), (None, 5)], "a int, b int")
    assert result(quality.unique(df, "t", "a")) == [(2, "error")]
    assert result(quality.unique(df.where("a is null"), "t", "a")) == [(0, "pass")]
    assert result(quality.unique_combination(df, "t", ["a", "b"])) == [(2, "error")]


def test_relationships_count_orphan_rows(spark):
    child = spark.createDataFrame([(1,), (7,), (7,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert result(quality.relationships(child, "c", "k", parent, "id")) == [(2, "error")]
    assert result(quality.relationships(child.where("k = 1"), "c", "k", parent, "id")) == [(0, "pass")]


def test_reconcile_and_partition_identity(spark):
    one, two = spark.range(1).selectExpr("1L as n"), spark.range(1).selectExpr("2L as n")
    assert result(quality.reconcile("x", "t", "n", one, one)) == [(0, "pass")]
    assert result(quality.reconcile("x", "t", "n", one, two)) == [(1, "error")]
    orders = spark.createDataFrame([(1, "prior"), (1, "train"), (2, "test"), (3, "prior")], "u int, s string")
    assert result(quality.partition_identity(orders, "o", "u", "s", ["train", "test"])) == [(1, "error")]
    assert result(quality.partition_identity(orders.where("u < 3"), "o", "u", "s", ["train", "test"])) == [(0, "pass")]


def failures(df):
    return {(r.check, r.table_name, r.column_name): (r.failures, r.status) for r in df.collect()}


def test_one_pass_equals_the_single_checks(spark):
    rows = [(1, 1, "Y"), (1, 2, "N"), (2, 1, None), (2, 1, "?"), (None, 5, "Y"), (None, 5, "Y"), (9, None, "N")]
    child = spark.createDataFrame(rows, "a int, b int, f string")
    parent = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    orders = spark.createDataFrame([(1, "prior"), (1, "train"), (2, "test"), (3, "prior"), (None, "test")], "u int, s string")
    q = quality
    got = failures(q.run([
        q.expect_not_null("c", "a"), q.expect_accepted("c", "f", ["Y", "N"]), q.expect_within("c", "b", F.col("b") > 1, 0, 3),
        q.expect_unique("c", "a"), q.expect_unique("p", "id"), q.expect_unique_together("c", ["a", "b"]),
        q.expect_known("c", "a", "p", "id"), q.expect_known("p", "id", "c", "a"), q.expect_one_part("o", "u", "s", ["train", "test"]),
        q.expect_known("absent", "a", "p", "id"),
    ], {"c": child, "p": parent, "o": orders}))
    want = failures(q.report(
        q.not_null(child, "c", ["a"]), q.accepted_values(child, "c", {"f": ["Y", "N"]}),
        q.threshold(child, "c", "b", F.col("b") > 1, error_above=3), q.unique(child, "c", "a"), q.unique(parent, "p", "id"),
        q.unique_combination(child, "c", ["a", "b"]), q.relationships(child, "c", "a", parent, "id"),
        q.relationships(parent, "p", "id", child, "a"), q.partition_identity(orders, "o", "u", "s", ["train", "test"])))
    assert got == want and got["unique", "c", "a"] == (2, "error") and got["threshold", "c", "b"] == (3, "warn")


def test_totals_and_tables_without_rows(spark):
    one, none = spark.range(3).selectExpr("id AS n"), spark.range(0).selectExpr("id AS n")
    every = F.lit(True)
    same = lambda a, b: quality.expect_same_total("total", a, "n", (a, every, F.col("n")), (b, every, None))
    got = failures(quality.run([same("one", "one"), same("none", "one"), quality.expect_unique("none", "n")],
                               {"one": one, "none": none}))
    assert got == {("total", "one", "n"): (0, "pass"), ("total", "none", "n"): (1, "error"), ("unique", "none", "n"): (0, "pass")}
    assert failures(quality.run([same("none", "none")], {"none": none})) == {("total", "none", "n"): (0, "pass")}
    assert quality.run([same("x", "y")], {"one": one}).count() == 0


def test_relationships_read_each_table_once(spark, sf):
    from fieldtally.plans import queries

    scans = queries.dq_relationships(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert scans.count("FileScan") == 5
    for table in ("lineitem", "orders", "part", "customer", "events"):
        assert scans.count(f"/{table}.parquet") == 1
