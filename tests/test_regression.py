from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fieldtally.operators import regression


def make_panel(units=40, days=30, filled=0.85, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for z in range(units):
        for d in range(days):
            if rng.random() < filled:
                treat, post = int(z % 3 == 0), int(d >= days // 2)
                rows.append((z, date(2024, 1, 1) + timedelta(days=d), treat, post, rng.normal(),
                             0.1 * z + 0.05 * d - 0.3 * treat * post + rng.normal()))
    return pd.DataFrame(rows, columns=["z", "d", "treat", "post", "w", "y"]).assign(did=lambda p: p.treat * p.post)


def dense(p, xs, y="y"):
    """Dummy-variable least squares with clustered covariance, all in memory."""
    dummies = [pd.get_dummies(p.z).to_numpy(float), pd.get_dummies(p.d).to_numpy(float)[:, 1:]]
    design = np.column_stack([p[xs].to_numpy(float), *dummies])
    beta = np.linalg.lstsq(design, p[y].to_numpy(), rcond=None)[0]
    e = p[y].to_numpy() - design @ beta
    bread = np.linalg.pinv(design.T @ design)
    meat = sum(np.outer(s, s) for s in (design[i].T @ e[i] for i in p.groupby("z").indices.values()))
    n, k = len(p), len(xs) + p.z.nunique() + p.d.nunique() - 1
    cov = bread @ meat @ bread * n / (n - k)
    return beta[:len(xs)], np.sqrt(np.diag(cov))[:len(xs)], n - k


@pytest.mark.parametrize("xs", [["did"], ["did", "w"]])
def test_unbalanced_panel_equals_dummy_regression(spark, xs):
    p = make_panel()
    got = regression.two_way_fixed_effects(spark.createDataFrame(p), "z", "d", "y", xs).collect()
    beta, se, left = dense(p, xs)
    for row, b, s in zip(got, beta, se):
        assert row.coef == pytest.approx(b, rel=1e-9) and row.std_error == pytest.approx(s, rel=1e-9)
        assert (row.n_obs, row.n_zones, row.n_days) == (len(p), 40, 30) and not row.absorbed
        assert row.ci_high - row.coef == pytest.approx(row.coef - row.ci_low)
        assert (row.ci_high - row.coef) / s == pytest.approx(1.9624, abs=2e-3)


def test_sweeping_gives_the_same_estimates(spark):
    p = make_panel(units=30, days=12).assign(twice=lambda q: q.w * 2)
    df = spark.createDataFrame(p)
    want = regression.two_way_fixed_effects(df, "z", "d", "y", ["did", "treat", "w", "twice"]).collect()
    got = regression.two_way_fixed_effects(df, "z", "d", "y", ["did", "treat", "w", "twice"], method="sweep").collect()
    for a, b in zip(want, got):
        assert (a.term, a.absorbed, a.n_obs, a.n_zones, a.n_days) == (b.term, b.absorbed, b.n_obs, b.n_zones, b.n_days)
        if not a.absorbed:
            assert b.coef == pytest.approx(a.coef, rel=1e-8) and b.std_error == pytest.approx(a.std_error, rel=1e-8)
    with pytest.raises(ValueError, match="more than one row"):
        regression.two_way_fixed_effects(df.union(df.limit(1)), "z", "d", "y", ["did"], method="sweep")


def test_disconnected_days_do_not_break_the_solve(spark):
    p = make_panel(filled=1.0)
    p = p[(p.z < 20) == (p.d < date(2024, 1, 16))].assign(w=lambda q: q.w)
    got = regression.two_way_fixed_effects(spark.createDataFrame(p), "z", "d", "y", ["w"]).first()
    assert got.coef == pytest.approx(dense(p, ["w"])[0][0], rel=1e-9)


def test_absorbed_regressors_are_reported_not_fatal(spark):
    p = make_panel().assign(twice=lambda q: q.w * 2 + q.treat)
    got = {r.term: r for r in regression.two_way_fixed_effects(
        spark.createDataFrame(p), "z", "d", "y", ["treat", "post", "w", "twice"]).collect()}
    assert [t for t, r in got.items() if r.absorbed] == ["treat", "post", "twice"]
    assert got["treat"].coef is None
    assert got["w"].coef == pytest.approx(dense(p, ["w"])[0][0], rel=1e-9)


def test_specifications_are_independent(spark):
    a, b = make_panel(seed=1).assign(s="a"), make_panel(units=17, days=12, seed=2).assign(s="b")
    both = spark.createDataFrame(pd.concat([a, b]))
    got = {r.spec: r for r in regression.two_way_fixed_effects(both, "z", "d", "y", ["did"], by="s").collect()}
    for name, p in (("a", a), ("b", b)):
        beta, se, _ = dense(p, ["did"])
        assert got[name].coef == pytest.approx(beta[0], rel=1e-9)
        assert got[name].std_error == pytest.approx(se[0], rel=1e-9)
        assert got[name].n_days == p.d.nunique()


def test_balanced_panel_is_the_difference_of_mean_changes(spark):
    p = make_panel(filled=1.0, seed=5)
    m = p.groupby(["treat", "post"]).y.mean()
    got = regression.two_way_fixed_effects(spark.createDataFrame(p), "z", "d", "y", ["did"]).first()
    assert got.coef == pytest.approx((m[1, 1] - m[1, 0]) - (m[0, 1] - m[0, 0]), rel=1e-9)


def test_repeated_cells_and_missing_outcomes(spark):
    p = make_panel(units=10, days=8)
    df = spark.createDataFrame(p)
    with pytest.raises(ValueError, match="more than one row"):
        regression.two_way_fixed_effects(df.union(df.limit(1)), "z", "d", "y", ["did"])
    holes = df.withColumn("y", F.when(F.col("w") > 0, F.col("y")))
    got = regression.two_way_fixed_effects(holes, "z", "d", "y", ["did"]).first()
    assert got.n_obs == int((p.w > 0).sum())
    assert got.coef == pytest.approx(dense(p[p.w > 0], ["did"])[0][0], rel=1e-9)


def test_empty_panel_gives_no_rows(spark):
    df = spark.createDataFrame(make_panel(units=3, days=3)).where("z > 99")
    assert regression.two_way_fixed_effects(df, "z", "d", "y", ["did"]).count() == 0


def test_small_blocks_change_nothing(spark, monkeypatch):
    p = make_panel()
    whole = regression.two_way_fixed_effects(spark.createDataFrame(p), "z", "d", "y", ["did"]).first()
    monkeypatch.setattr(regression, "_CELLS_PER_BLOCK", 1)
    cells = spark.createDataFrame(p).groupBy(F.lit("all").alias("spec"), "z").agg(
        F.lit(1).alias("most"), F.collect_list(F.struct(
            F.unix_date("d").cast("long").alias("t"), "y", F.array(F.col("did").cast("double")).alias("x"), F.lit(-1).alias("k")))
        .alias("cells")).select("spec", "most", "cells").toArrow().combine_chunks().to_batches()[0]
    blocks = list(regression._blocks(cells, 1, 0))
    assert len(blocks) == 40 and sum(len(b.t) for b in blocks) == whole.n_obs


def test_many_days_equal_the_dense_solve(spark):
    """4,000 days and few units, gaps and all: the matrix of days by days is solved here only."""
    rng = np.random.default_rng(8)
    units, days = 12, 4000
    z, d = (a.ravel() for a in np.meshgrid(np.arange(units), np.arange(days), indexing="ij"))
    seen = rng.random(len(z)) < 0.7
    z, d = z[seen], d[seen]
    x = rng.normal(size=len(z)) + 0.3 * (z % 3) * np.sin(d / 50)
    y = 0.2 * z + np.cos(d / 9) + 0.5 * x + rng.normal(size=len(z))
    df = spark.createDataFrame(pd.DataFrame({"z": z, "d": d, "x": x, "y": y}))
    got = regression.two_way_fixed_effects(df, "z", "d", "y", ["x"]).first()
    presence = np.zeros((units, days))
    presence[z, d] = 1
    n = presence.sum(axis=1)
    gram = np.diag(presence.sum(axis=0)) - (presence / n[:, None]).T @ presence
    less = lambda v: v - (np.bincount(z, v, units) / n)[z]
    right = np.stack([np.bincount(d, less(v), days) for v in (y, x)], axis=1)
    effects = np.linalg.lstsq(gram, right, rcond=1e-12)[0]
    ey, ex = less(y - effects[d, 0]), less(x - effects[d, 1])
    beta = (ex @ ey) / (ex @ ex)
    scores = np.bincount(z, ex * (ey - beta * ex), units)
    left = len(z) - 1 - units - days + 1
    assert got.converged and got.n_days == days and got.coef == pytest.approx(beta, rel=1e-9)
    assert got.std_error == pytest.approx(np.sqrt((scores**2).sum() * len(z) / left) / (ex @ ex), rel=1e-9)


def test_what_a_task_sends_grows_with_days_not_with_their_square():
    import pyarrow as pa

    def sent(days):
        cells = [{"t": t, "y": float(t % 7), "x": [1.0], "k": t % 3} for t in range(days)]
        kind = pa.list_(pa.struct([("t", pa.int64()), ("y", pa.float64()), ("x", pa.list_(pa.float64())), ("k", pa.int32())]))
        batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 5), pa.array([1] * 5), pa.array([cells] * 5, kind)],
                                           names=["spec", "most", "cells"])
        periods, vectors = {"a": np.arange(days)}, {"a": np.ones((days, 5))}
        return [sum(b.num_rows for b in run(iter([batch]))) for run in (
            regression._moments(1, 3), regression._apply(periods, vectors, 1, 3))]

    few, many = sent(100), sent(1000)
    assert many[1] == 10 * few[1] == 5000 and many[0] - few[0] == 900 * 6


def test_levels_equal_indicator_columns(spark):
    p = make_panel(units=25, days=20).assign(week=lambda q: [int(d.day) // 7 if t else -9 for d, t in zip(q.d, q.treat)])
    df = spark.createDataFrame(p)
    shown = df.withColumns({f"week_{w}": (F.col("week") == w).cast("int") for w in (1, 2)})
    want = regression.two_way_fixed_effects(shown, "z", "d", "y", ["w", "week_1", "week_2"]).collect()
    for method in ("gradients", "sweep"):
        got = regression.two_way_fixed_effects(df, "z", "d", "y", ["w"], levels=("week", [1, 2]), method=method).collect()
        assert [r.term for r in got] == ["w", "week_1", "week_2"] and all(r.converged for r in got)
        for a, b in zip(want, got):
            assert b.coef == pytest.approx(a.coef, rel=1e-8) and b.std_error == pytest.approx(a.std_error, rel=1e-8)


def test_no_indicator_columns_in_the_plan_of_the_event_study(spark, monkeypatch):
    seen = []
    fit = regression._fit_by_gradients
    monkeypatch.setattr(regression, "_fit_by_gradients", lambda panel, *a: (seen.append(panel.columns), fit(panel, *a))[1])
    regression.event_study(did_panel(spark), "2024-03-04", -3)
    assert seen == [["spec", "unit", "t", "y", "x", "k"]]


def test_missing_values_are_counted(spark):
    p = make_panel(units=10, days=8)
    holes = spark.createDataFrame(p).withColumn("w", F.when(F.col("w") > 0, F.col("w")))
    seen = Observation()
    got = regression.two_way_fixed_effects(holes, "z", "d", "y", ["w"], dropped=seen).first()
    assert got.n_obs == int((p.w > 0).sum()) and seen.get["dropped_rows"] == int((p.w <= 0).sum())


def test_methods_reach_the_operators(spark):
    panel = did_panel(spark, units=9)
    keep = F.lit(True)
    for make in (lambda m: regression.did_regression(panel, {"all": keep}, method=m),
                 lambda m: regression.did_outcomes(panel, keep, method=m),
                 lambda m: regression.event_study(panel, "2024-03-04", -3, method=m)):
        for a, b in zip(make("gradients").collect(), make("sweep").collect()):
            assert a[0] == b[0] and b.coef == pytest.approx(a.coef, rel=1e-7)
    with pytest.raises(ValueError, match="unknown method"):
        regression.did_regression(panel, {"all": keep}, method="dense")


def did_panel(spark, weeks=(-3, 3), units=24):
    rng = np.random.default_rng(11)
    policy = date(2024, 3, 4)
    rows = []
    for z in range(units):
        treat = int(z < 8)
        for d in range(weeks[0] * 7, weeks[1] * 7):
            n = int(np.exp(4 + 0.05 * z + 0.1 * (d % 7) - 0.2 * treat * (d >= 0)) + rng.integers(0, 9))
            fare = float(n * (10 + rng.random()))
            rows.append((policy + timedelta(days=d), z, "treatment" if treat else "outer_borough_control", n, fare,
                         fare * (0.7 + 0.05 * rng.random()), treat, int(d >= 0)))
    return spark.createDataFrame(rows, "trip_date date, location_id int, zone_group string, trip_count long,"
                                 " total_base_fare double, total_driver_pay double, is_treatment int, is_post int")


def test_event_study_of_a_balanced_panel_is_the_difference_of_week_means(spark):
    panel = did_panel(spark)
    table = {r.week_relative: r for r in regression.event_study(panel, "2024-03-04", -3).collect()}
    assert sorted(table) == [-3, -2, -1, 0, 1, 2]
    assert tuple(table[-3])[1:] == (0.0, 0.0, 0.0, 0.0)
    p = panel.toPandas()
    p["w"] = [(d - date(2024, 3, 4)).days // 7 for d in p.trip_date]
    p["y"] = np.log(p.trip_count)
    m = p.groupby(["is_treatment", "w"]).y.mean()
    change = p.groupby(["is_treatment", "location_id", "w"]).y.mean().unstack("w")
    n, left = len(p), len(p) - 5 - 24 - 42 + 1
    for w in (-2, -1, 0, 1, 2):
        assert table[w].coef == pytest.approx((m[1, w] - m[1, -3]) - (m[0, w] - m[0, -3]), rel=1e-8)
        delta = change[w] - change[-3]
        spread = sum(((g - g.mean()) ** 2).sum() / len(g) ** 2 for _, g in delta.groupby(level=0))
        assert table[w].se == pytest.approx(np.sqrt(spread * n / left), rel=1e-8)


def test_did_specs_and_percent_effects(spark):
    panel = did_panel(spark)
    out = {r.spec: r for r in regression.did_regression(panel, {
        "all": F.lit(True), "late": F.col("trip_date") >= "2024-02-19"}).collect()}
    assert out["all"].n_days == 42 and out["late"].n_days == 35
    assert out["all"].coef == pytest.approx(-0.2, abs=0.05) and out["all"].p_value < 1e-6
    assert out["all"].pct_effect == pytest.approx(100 * (np.exp(out["all"].coef) - 1))


def test_outcomes_drop_and_count_non_positive_cells(spark):
    panel = did_panel(spark)
    panel = panel.withColumn("total_driver_pay", F.when(
        (F.col("location_id") == 3) & (F.col("trip_date") == "2024-03-05"), -1.0).otherwise(F.col("total_driver_pay")))
    seen = Observation()
    out = {r.spec: r for r in regression.did_outcomes(panel, F.lit(True), dropped=seen).collect()}
    assert seen.get["dropped_rows"] == 1
    assert {r.n_obs for r in out.values()} == {24 * 42 - 1}
    share = out["driver_share_of_fare"]
    assert share.effect == pytest.approx(100 * share.coef) and share.effect_unit == "percentage points"


def test_hc1_equals_the_textbook_formula(spark):
    rng = np.random.default_rng(4)
    x1, x2 = rng.normal(size=60), rng.integers(0, 2, 60).astype(float)
    y = 1 + 2 * x1 - x2 + rng.normal(size=60) * (1 + x2)
    df = spark.createDataFrame([("s", *map(float, r)) for r in zip(y, x1, x2)], "spec string, y double, a double, b double")
    got = {r.term: r for r in regression.ols_hc1(df, "y", ["a", "b"]).collect()}
    design = np.column_stack([np.ones(60), x1, x2])
    bread = np.linalg.inv(design.T @ design)
    beta = bread @ design.T @ y
    e = y - design @ beta
    se = np.sqrt(np.diag(bread @ (design.T * e**2) @ design @ bread) * 60 / 57)
    for i, term in enumerate(("Intercept", "a", "b")):
        assert got[term].coef == pytest.approx(beta[i], rel=1e-9)
        assert got[term].std_error == pytest.approx(se[i], rel=1e-9)
        assert got[term].n_obs == 60


def test_unusable_specifications_leave_the_others_alone(spark):
    rng = np.random.default_rng(4)
    good = [("good", float(x), float(2 * x + e), float(z)) for x, e, z in rng.normal(size=(50, 3))]
    same = [("collinear", float(x), float(x + e), float(2 * x)) for x, e in rng.normal(size=(50, 2))]
    few = [("few", 1.0, 2.0, 3.0), ("few", 2.0, 1.0, 5.0), ("few", 4.0, 4.0, 4.0)]
    df = spark.createDataFrame([*good, *same, *few, ("good", None, 1.0, 1.0)], "spec string, x double, y double, z double")
    rows = {(r.spec, r.term): r for r in regression.ols_hc1(df, "y", ["x", "z"]).collect()}
    assert rows["good", "x"].coef == pytest.approx(2, abs=0.6) and rows["good", "x"].n_obs == 50
    assert rows["collinear", "z"].coef is None and rows["collinear", "x"].std_error > 0
    assert rows["few", "x"].coef is not None and rows["few", "x"].std_error is None and rows["few", "x"].p_value is None
