"""The policy study from one unit-by-day panel: index series, pre-trends, effects, event study, outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import columns as C
from fieldtally.operators import panel as P
from fieldtally.operators import regression
from fieldtally.plans.warehouse import POLICY_START
from fieldtally.session import cut_lineage


@dataclass(frozen=True)
class StudySettings:
    """What the study fixes; the defaults are the published study's dates and limits (fixed values)."""

    policy: str = POLICY_START
    pre_period: tuple[str, str] = ("2024-10-01", "2025-01-04")
    holidays: tuple[str, str] = ("2024-11-20", "2025-01-02")
    reference_week: int = -13
    presence: float = 0.7


def study(panel: DataFrame, settings: StudySettings = StudySettings()) -> dict[str, DataFrame]:
    """All results by name, from a panel as ``operators.panel.did_panel`` makes it.

    The panel is cut loose once, so the fact behind it is aggregated once for all of them.
    """
    data = cut_lineage(panel)
    quiet = C.outside_days("trip_date", *settings.holidays)
    before = F.col("trip_date").between(*[C.day(d) for d in settings.pre_period])

    def against(control: str) -> Column:
        return F.col("zone_group").isin(P.TREATMENT, control)

    series = P.group_daily_series(data, [P.TREATMENT, P.OUTER_CONTROL, P.CORE_CONTROL])
    outer, core = against(P.OUTER_CONTROL), against(P.CORE_CONTROL)
    return {
        "indexed_series": P.indexed_series(series, [P.TREATMENT, P.OUTER_CONTROL], *settings.pre_period),
        "pretrends": regression.pretrend_test(series, {
            "outer, full": outer & before, "outer, no holidays": outer & before & quiet,
            "core, full": core & before, "core, no holidays": core & before & quiet}),
        "effects": regression.did_regression(data, {
            "primary": outer & quiet, "sensitivity": outer, "robustness": core & quiet}, fraction=settings.presence),
        "event_study": regression.event_study(data.where(outer), settings.policy, settings.reference_week,
                                              fraction=settings.presence),
        "outcomes": regression.did_outcomes(data, outer & quiet, fraction=settings.presence),
    }
