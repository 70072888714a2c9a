from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from fieldtally.operators.panel import CORE_CONTROL, OUTER_CONTROL, TREATMENT
from fieldtally.plans.study import study


def test_study_finds_a_known_effect(spark):
    rng = np.random.default_rng(7)
    rows, start, policy = [], date(2024, 9, 29), date(2025, 1, 5)
    for zone in range(18):
        group = (TREATMENT, OUTER_CONTROL, CORE_CONTROL)[zone % 3]
        for k in range(168):
            day = start + timedelta(days=k)
            treated, after = int(group == TREATMENT), int(day >= policy)
            n = int(1000 * (1 + zone) * np.exp(0.1 * np.sin(k) - 0.2 * treated * after + rng.normal(0, 0.01)))
            rows.append((day, zone, group, n, 10.0 * n, 7.0 * n, treated, after))
    panel = spark.createDataFrame(pd.DataFrame(rows, columns=[
        "trip_date", "location_id", "zone_group", "trip_count", "total_base_fare", "total_driver_pay",
        "is_treatment", "is_post"]))
    found = study(panel)
    effects = {r.spec: r for r in found["effects"].collect()}
    assert set(effects) == {"primary", "sensitivity", "robustness"}
    assert all(r.coef == pytest.approx(-0.2, abs=0.02) for r in effects.values())
    weeks = {r.week_relative: r.coef for r in found["event_study"].collect()}
    assert weeks[-13] == 0 and weeks[3] == pytest.approx(-0.2, abs=0.03) and weeks[-2] == pytest.approx(0, abs=0.03)
    outcomes = {r.spec: r for r in found["outcomes"].collect()}
    assert outcomes["driver_share_of_fare"].n_obs == effects["primary"].n_obs
    trends = {(r.spec, r.term): r for r in found["pretrends"].collect()}
    assert len(trends) == 16 and abs(trends["outer, full", "is_treatment:days_since_start"].coef) < 10
    index = found["indexed_series"].toPandas().set_index("trip_date")
    assert index[f"{TREATMENT}_index"].loc[date(2024, 10, 1):date(2025, 1, 4)].mean() == pytest.approx(100)
