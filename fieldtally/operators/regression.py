"""Pre-trend tests and two-way fixed-effects regressions on Spark panels.

Everything that grows with the data is summed inside Spark.  The driver sees
cross-product matrices whose size depends on the number of days and
regressors only, and solves those.

Fixed effects.  With unit means removed, the day effects and regressors are
estimated from

    G = diag(n_t) - sum over units of c c' / n      (c: the unit's days as 0/1)

and the sums by day of the demeaned columns.  G itself is never formed: conjugate
gradients only need G times a vector of days, which is a pass over the units whose
tasks send numbers in proportion to days.  A last pass, knowing the day coefficients,
forms residuals and each unit's score for clustered errors.  No dummy matrix of the
whole panel, and none of days by days, exists at any point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions import columns as C
from fieldtally.functions import distributions as dist
from fieldtally.operators.panel import TREATMENT, event_weeks, presence_filter, with_specs
from fieldtally.session import cut_lineage

_CELLS_PER_BLOCK = 1_000_000

_OLS_RESULT = T.StructType([
    T.StructField("spec", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("coef", T.DoubleType()),
    T.StructField("std_error", T.DoubleType()),
    T.StructField("z_stat", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("n_obs", T.LongType()),
])

_FE_RESULT = T.StructType([
    T.StructField("spec", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("coef", T.DoubleType()),
    T.StructField("std_error", T.DoubleType()),
    T.StructField("t_stat", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("ci_low", T.DoubleType()),
    T.StructField("ci_high", T.DoubleType()),
    T.StructField("n_obs", T.LongType()),
    T.StructField("n_zones", T.LongType()),
    T.StructField("n_days", T.LongType()),
    T.StructField("absorbed", T.BooleanType()),
    T.StructField("converged", T.BooleanType()),
])


# --- ordinary least squares with robust errors -------------------------------------------

def ols_hc1(df: DataFrame, y: str, xs: Sequence[str], by: str = "spec") -> DataFrame:
    """OLS with intercept and HC1 standard errors for every value of ``by`` at once.

    Two aggregations: cross products, then squared-residual-weighted cross
    products.  p-values use the normal distribution.  Rows with a missing value
    are left out.  A term the others explain fully has no estimate, and a
    specification without more rows than terms no errors; both show NULL.
    """
    terms = ["Intercept", *xs]
    x = [F.lit(1.0)] + [F.col(c).cast("double") for c in xs]
    yc = F.col(y).cast("double")
    k = len(terms)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    usable = yc.isNotNull()
    for c in x[1:]:
        usable = usable & c.isNotNull()
    data = cut_lineage(df.where(usable).select(by, y, *xs))  # read twice

    first = data.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}") for i, j in pairs],
        *[F.sum(x[i] * yc).alias(f"xy_{i}") for i in range(k)],
    ).collect()  # one row per specification
    fits = {}
    for row in first:
        gram = _symmetric(row, "xx", k)
        beta, kept, inverse = _estimate(gram, np.array([row[f"xy_{i}"] for i in range(k)]), np.diag(gram))
        full = np.zeros((k, k))  # terms that are not kept have no coefficient and no variance
        full[np.ix_(kept, kept)] = inverse
        fits[row[by]] = (row["n"], full, np.nan_to_num(beta), set(kept))
    if not fits:
        return df.sparkSession.createDataFrame([], _OLS_RESULT)

    betas = df.sparkSession.createDataFrame(
        [(spec, *map(float, beta)) for spec, (_, _, beta, _) in fits.items()],
        T.StructType([df.schema[by]] + [T.StructField(f"_b{i}", T.DoubleType()) for i in range(k)]))
    fitted = sum((x[i] * F.col(f"_b{i}") for i in range(1, k)), F.col("_b0"))
    squared = F.pow(yc - fitted, F.lit(2.0))
    second = data.join(F.broadcast(betas), by).groupBy(by).agg(  # one row per specification
        *[F.sum(squared * x[i] * x[j]).alias(f"m_{i}_{j}") for i, j in pairs]).collect()
    rows = []
    for row in second:
        n, inverse, beta, kept = fits[row[by]]
        left = n - len(kept)
        cov = inverse @ _symmetric(row, "m", k) @ inverse * (n / left if left > 0 else 0.0)
        for i, term in enumerate(terms):
            if i not in kept:
                rows.append((str(row[by]), term, None, None, None, None, n))
                continue
            se = math.sqrt(max(cov[i, i], 0.0)) if left > 0 else None
            z = float(beta[i] / se) if se else None
            rows.append((str(row[by]), term, float(beta[i]), se, z,
                         None if z is None else dist.normal_two_sided_p(z), n))
    return df.sparkSession.createDataFrame(rows, _OLS_RESULT)


def _symmetric(row, prefix: str, k: int) -> np.ndarray:
    return np.array([[row[f"{prefix}_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)


def pretrend_test(series: DataFrame, specs: dict[str, Column], *, treated: str = TREATMENT) -> DataFrame:
    """Did treated and control series drift apart?  ``y ~ treated * days since start`` per specification.

    ``series`` is a group-by-day series; each specification is a condition on
    its rows.  Days count from the first day inside that specification.
    """
    sample = with_specs(series, specs)
    start = sample.groupBy("spec").agg(F.min("trip_date").alias("_first"))
    dated = sample.join(F.broadcast(start), "spec").withColumns({  # one row per specification
        "is_treatment": C.indicator(F.col("zone_group") == treated),
        "days_since_start": F.datediff("trip_date", "_first"),
    }).withColumn("is_treatment:days_since_start", F.col("is_treatment") * F.col("days_since_start"))
    return ols_hc1(dated, "avg_trips_per_zone", ["is_treatment", "days_since_start", "is_treatment:days_since_start"])


# --- two-way fixed effects ---------------------------------------------------------------

@dataclass
class _Fit:
    """One specification's estimates and what its errors need."""

    beta: np.ndarray
    kept: list[int]
    inverse: np.ndarray
    n: int
    units: int
    days: int
    converged: bool
    periods: np.ndarray | None = None  # days, and by day
    effects: np.ndarray | None = None  # the day coefficients of the outcome and of each regressor


def two_way_fixed_effects(df: DataFrame, unit: str, day: str, y: str, xs: Sequence[str], *, by: str | None = None,
                          levels: tuple[str, Sequence[int]] | None = None, debias: bool = True, level: float = 0.95,
                          method: str = "gradients", dropped: Observation | None = None) -> DataFrame:
    """Coefficients of ``xs`` given unit and day effects, errors clustered by unit.

    One result row per specification (value of ``by``) and regressor.  The
    panel may be unbalanced but has one row per unit and day.  A regressor the
    effects explain fully is reported as absorbed, without a coefficient.
    With ``debias`` the covariance is scaled by n / (n - k - units - days + 1),
    and t quantiles use those degrees of freedom.  Rows with a missing value stay
    out; ``dropped`` receives their number.

    ``levels`` names a column of whole numbers and those of its values that are
    regressors too, each an indicator called ``column_value``.  A row carries
    the one number, whatever the number of levels.

    ``method`` chooses the way, whatever the size: "gradients" solves for the day
    effects by conjugate gradients, a pass over the units a step, whose tasks send
    numbers in proportion to days; "sweep" removes both effects by repeated
    demeaning, for panels whose days do not fit the driver.  The estimates are the
    same; ``converged`` tells whether the steps came to an end within the tolerance.
    """
    if method not in ("gradients", "sweep"):
        raise ValueError(f"unknown method {method!r}")
    xs, values = list(xs), list(levels[1]) if levels else []
    terms = xs + [f"{levels[0]}_{v}" for v in values]
    spec = F.col(by).cast("string") if by else F.lit("all")
    period = F.unix_date(day) if isinstance(df.schema[day].dataType, T.DateType) else F.col(day).cast("bigint")
    # Place of the row's level among the levels, from 0; array_position gives 0 for other values.
    place = F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(levels[0])), F.lit(0)) - 1 if values else F.lit(-1)
    rows = df.select(
        spec.alias("spec"), F.col(unit).alias("unit"), period.cast("bigint").alias("t"),
        F.col(y).cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in xs]).cast("array<double>").alias("x"),
        place.cast("int").alias("k"))
    whole = F.coalesce(F.col("unit").isNotNull() & F.col("t").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y")
                       & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)), F.lit(False))
    if dropped is not None:
        rows = rows.observe(dropped, C.count_where(~whole).alias("dropped_rows"))
    fit = _fit_by_sweeping if method == "sweep" else _fit_by_gradients
    fits, meats = fit(rows.where(whole), len(xs), len(values))
    out = [r for s in sorted(fits) for r in _table(s, terms, fits[s], meats[s], debias, level)]
    return df.sparkSession.createDataFrame(out, _FE_RESULT)


_MORE_THAN_ONE = "the panel has more than one row for some unit and day"


def _fit_by_gradients(panel: DataFrame, dense: int, levels: int) -> tuple[dict[str, _Fit], dict[str, np.ndarray]]:
    """One row a unit, stored once; then a pass for the moments, one a step for the day effects, one for the errors."""
    p = dense + levels
    # Both groupings use the one shuffle.  First a row a cell, which bounds a unit's cells by the days.
    cells = panel.repartition("spec", "unit").groupBy("spec", "unit", "t").agg(
        F.count(F.lit(1)).alias("n"), F.first("y").alias("y"), F.first("x").alias("x"), F.first("k").alias("k"))
    units = cut_lineage(cells.groupBy("spec", "unit").agg(
        F.max("n").alias("most"), F.collect_list(F.struct("t", "y", "x", "k")).alias("cells")).select("spec", "most", "cells"))
    moments = _added(units, _moments(dense, levels))
    if not moments:
        return {}, {}
    if any(m["size"][-1, 0] > 1 for m in moments.values()):
        raise ValueError(_MORE_THAN_ONE)
    periods = {s: m["days"] for s, m in moments.items()}
    right = {s: m["day"][:, :p + 1] for s, m in moments.items()}
    scale = {s: m["day"][:, p + 1] for s, m in moments.items()}
    effects, converged = _day_effects(
        right, scale, lambda v: {s: m["day"] for s, m in _added(units, _apply(periods, v, dense, levels)).items()})
    fits = {}
    for s, m in moments.items():
        cross, (n, number) = m["cross"], m["size"][:2, 0]
        left = cross - right[s].T @ effects[s]  # outcome and regressors, beside unit and day effects
        fits[s] = _Fit(*_estimate(left[1:, 1:], left[1:, 0], m["raw"][1:, 0]), int(n), int(number), len(periods[s]),
                       converged[s], periods[s], effects[s])
    scores = _added(units, _scores(fits, dense, levels))
    return fits, {s: m["cross"][1:, 1:] for s, m in scores.items()}


#: What a task sends: numbers of the parts of its sums, added up by Spark; a day's numbers are found by the day itself.
_NUMBERS = "spec string, part string, i bigint, j int, v double"


def _added(units: DataFrame, work) -> dict[str, dict[str, np.ndarray]]:
    """Sums over all tasks of what ``work`` adds up in each: per specification its parts as matrices.

    ``days`` lists the values of ``i`` in the part ``day``, whose rows follow it.
    """
    sums = units.mapInArrow(work, _NUMBERS).groupBy("spec", "part", "i", "j").agg(
        F.sum(F.when(F.col("part") != "most", F.col("v"))).alias("v"), F.max("v").alias("top"))
    table = sums.toArrow()  # some numbers a day and specification
    spec, part = (np.asarray(table.column(c).to_pylist(), dtype=object) for c in ("spec", "part"))
    i, j = np.asarray(table.column("i")), np.asarray(table.column("j"))
    v = np.where(part == "most", np.asarray(table.column("top")), np.asarray(table.column("v")))
    out: dict[str, dict[str, np.ndarray]] = {}
    for s in sorted(set(spec)):
        own = out[s] = {}
        for name in set(part[spec == s]) - {"most"}:
            at = (spec == s) & (part == name)
            rows, place = np.unique(i[at], return_inverse=True) if name == "day" else (np.arange(i[at].max() + 1), i[at])
            own[name] = np.zeros((len(rows), int(j[at].max()) + 1))
            own[name][place, j[at]] = v[at]
            if name == "day":
                own["days"] = rows
        most = v[(spec == s) & (part == "most")]
        if len(most):
            own["size"] = np.vstack([own["size"], [[most[0]]]])
    return out


class _Sums:
    """A task's sums by specification: matrices, and numbers by day."""

    def __init__(self):
        self.parts: dict[tuple[str, str], np.ndarray] = {}
        self.days: dict[str, dict[int, np.ndarray]] = {}

    def add(self, spec: str, part: str, m: np.ndarray) -> None:
        self.parts[spec, part] = self.parts.get((spec, part), 0) + m

    def most(self, spec: str, n: int) -> None:
        self.parts[spec, "most"] = np.maximum(self.parts.get((spec, "most"), 0), np.array([[n]]))

    def by_day(self, spec: str, days: np.ndarray, numbers: np.ndarray) -> None:
        own = self.days.setdefault(spec, {})
        for t, row in zip(days.tolist(), numbers):
            own[t] = own[t] + row if t in own else row

    def batches(self) -> Iterator[pa.RecordBatch]:
        def batch(spec, part, i, m):
            rows, columns = m.shape
            return pa.RecordBatch.from_arrays(
                [pa.array([spec] * m.size), pa.array([part] * m.size), pa.array(np.repeat(i, columns).astype(np.int64)),
                 pa.array(np.tile(np.arange(columns, dtype=np.int32), rows)), pa.array(np.asarray(m, float).reshape(-1))],
                names=["spec", "part", "i", "j", "v"])

        for (spec, part), m in self.parts.items():
            yield batch(spec, part, np.arange(len(m)), m)
        for spec, own in self.days.items():
            if own:
                yield batch(spec, "day", np.array(list(own)), np.stack(list(own.values())))


@dataclass
class _Block:
    """Cells of some units of one specification, unit by unit; columns are the outcome and the regressors."""

    spec: str
    most: int
    starts: np.ndarray
    lengths: np.ndarray
    t: np.ndarray
    values: np.ndarray

    def demeaned(self, values: np.ndarray) -> np.ndarray:
        means = np.add.reduceat(values, self.starts, axis=0) / self.lengths[:, None]
        return values - np.repeat(means, self.lengths, axis=0)

    def summed_by_day(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        days, place = np.unique(self.t, return_inverse=True)
        return days, np.stack([np.bincount(place, c, len(days)) for c in values.T], axis=1)


def _blocks(batch: pa.RecordBatch, dense: int, levels: int) -> Iterator[_Block]:
    """Units of a batch in blocks of at most ``_CELLS_PER_BLOCK`` numbers, a larger unit alone; indicators exist only here."""
    specs = np.asarray(batch.column("spec").to_pylist(), dtype=object)
    most, cells = np.asarray(batch.column("most")), batch.column("cells")
    lengths = np.asarray(cells.value_lengths()).astype(np.int64)
    flat = cells.flatten()
    t, y, k = (np.asarray(flat.field(c)) for c in ("t", "y", "k"))
    x = np.asarray(flat.field("x").flatten()).reshape(len(y), dense)
    ends = np.cumsum(lengths)
    for s in sorted(set(specs)):
        members = np.flatnonzero(specs == s)
        size = np.cumsum(lengths[members]) * (1 + dense + levels)
        at = 0
        while at < len(members):
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _CELLS_PER_BLOCK, side="right")))
            chosen = members[at:stop]
            n = lengths[chosen]
            starts = np.cumsum(n) - n
            source = np.repeat(ends[chosen] - n - starts, n) + np.arange(n.sum())
            values = np.zeros((len(source), 1 + dense + levels))
            values[:, 0] = y[source]
            values[:, 1:1 + dense] = x[source]
            hit = np.flatnonzero(k[source] >= 0)
            values[hit, 1 + dense + k[source][hit]] = 1.0
            yield _Block(s, int(most[chosen].max()), starts, n, t[source], values)
            at = stop


def _each_block(add, dense: int, levels: int):
    """A task: ``add(sums, block)`` for every block, then the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for block in _blocks(batch, dense, levels):
                add(sums, block)
        yield from sums.batches()

    return run


def _moments(dense: int, levels: int):
    """Sums of demeaned columns by day and of their products; by day also the diagonal of the day system."""

    def add(sums: _Sums, b: _Block) -> None:
        centred = b.demeaned(b.values)
        own = 1.0 - 1.0 / np.repeat(b.lengths, b.lengths)
        sums.by_day(b.spec, *b.summed_by_day(np.column_stack([centred, own])))
        sums.add(b.spec, "cross", centred.T @ centred)
        sums.add(b.spec, "raw", np.square(b.values).sum(axis=0)[:, None])
        sums.add(b.spec, "size", np.array([[len(b.t)], [len(b.lengths)]]))
        sums.most(b.spec, b.most)

    return _each_block(add, dense, levels)


def _by_day(periods: np.ndarray, numbers: np.ndarray, t: np.ndarray) -> np.ndarray:
    return numbers[np.searchsorted(periods, t)]


def _apply(periods: dict[str, np.ndarray], vectors: dict[str, np.ndarray], dense: int, levels: int):
    """The day system times day vectors: each day's values less their units' means, summed over units."""

    def add(sums: _Sums, b: _Block) -> None:
        if b.spec in vectors:
            sums.by_day(b.spec, *b.summed_by_day(b.demeaned(_by_day(periods[b.spec], vectors[b.spec], b.t))))

    return _each_block(add, dense, levels)


def _scores(fits: dict[str, _Fit], dense: int, levels: int):
    """Sums over units of score times score; the outcome's row and column are not used."""

    def add(sums: _Sums, b: _Block) -> None:
        fit = fits[b.spec]
        left = b.demeaned(b.values - _by_day(fit.periods, fit.effects, b.t))
        error = left[:, 0] - left[:, 1:] @ fit.beta
        scores = np.add.reduceat(left * error[:, None], b.starts, axis=0)
        sums.add(b.spec, "cross", scores.T @ scores)

    return _each_block(add, dense, levels)


def _day_effects(right: dict[str, np.ndarray], scale: dict[str, np.ndarray], system, tolerance: float = 1e-12,
                 patience: int = 25) -> tuple[dict[str, np.ndarray], dict[str, bool]]:
    """Solutions of the day system for all columns of all specifications at once, by conjugate gradients.

    Days that no unit connects leave the system singular; its right sides lie in
    its range, where the steps stay, and any solution serves.  Steps end within the
    tolerance, or once ``patience`` of them brought no specification nearer.
    """
    names = sorted(right)
    inverse = {s: 1.0 / np.where(scale[s] > 1e-9, scale[s], 1.0)[:, None] for s in names}
    solution = {s: np.zeros_like(right[s]) for s in names}
    left = {s: right[s].copy() for s in names}
    size = {s: np.linalg.norm(right[s], axis=0) for s in names}
    floor = {s: tolerance * np.maximum(size[s], 1e-300) for s in names}
    step = {s: inverse[s] * left[s] for s in names}
    weight = {s: (left[s] * step[s]).sum(axis=0) for s in names}
    closest, stalled = {s: np.full_like(size[s], np.inf) for s in names}, 0
    while True:
        off = {s: np.linalg.norm(left[s], axis=0) for s in names}
        open_ = [s for s in names if (off[s] > floor[s]).any()]
        nearer = any((off[s] < closest[s])[off[s] > floor[s]].any() for s in open_)
        stalled = 0 if nearer else stalled + 1
        if not open_ or stalled > patience:
            break
        closest = {s: np.minimum(closest[s], off[s]) for s in names}
        moved = system({s: step[s] for s in open_})
        for s in open_:
            bend = (step[s] * moved[s]).sum(axis=0)
            go = (off[s] > floor[s]) & (bend > 0)
            length = np.where(go, weight[s] / np.where(go, bend, 1.0), 0.0)
            solution[s] += length * step[s]
            left[s] -= length * moved[s]
            nearby = inverse[s] * left[s]
            new = (left[s] * nearby).sum(axis=0)
            step[s] = nearby + np.where(go & (weight[s] > 0), new / np.where(weight[s] > 0, weight[s], 1.0), 0.0) * step[s]
            weight[s] = new
    # Rounding may keep the residual above the tolerance; a millionfold of it still gives all printed digits.
    return solution, {s: bool((off[s] <= 1e6 * floor[s]).all()) for s in names}


def _one_row_a_cell(panel: DataFrame) -> None:
    """No unit may have two rows for a day."""
    if panel.groupBy("spec", "unit", "t").count().where(F.col("count") > 1).limit(1).count():
        raise ValueError(_MORE_THAN_ONE)


def _estimate(gram: np.ndarray, cross: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Coefficients, the regressors kept, and the inverse of their cross products.

    A regressor stays if, beside the effects and those before it, more than a
    rounding error is left of its raw sum of squares.
    """
    kept: list[int] = []
    for k in range(len(raw)):
        left = gram[k, k]
        if kept:
            left -= gram[k, kept] @ np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, k])
        if left > 1e-9 * max(raw[k], 1e-300):
            kept.append(k)
    inverse = np.linalg.inv(gram[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    beta = np.zeros(len(raw))
    beta[kept] = inverse @ cross[kept]
    return beta, kept, inverse


def _fit_by_sweeping(panel: DataFrame, dense: int, levels: int, tolerance: float = 1e-11) -> tuple[dict[str, _Fit], dict[str, np.ndarray]]:
    """The same estimates for any number of days: demean by unit and by day until neither moves.

    Every step is an aggregation joined back on its own key, and the panel is
    cut loose after each round, so plans do not grow with the rounds.  Rounds end
    within the tolerance, or where rounding lets nothing move closer any more.
    """
    p = dense + levels
    names = [f"v{i}" for i in range(p + 1)]
    data = cut_lineage(panel.select(
        "spec", "unit", "t", F.col("y").alias("v0"), *[F.col("x")[i].alias(f"v{i + 1}") for i in range(dense)],
        *[C.indicator(F.col("k") == i).cast("double").alias(f"v{dense + i + 1}") for i in range(levels)]))
    _one_row_a_cell(data)
    size = {r["spec"]: r for r in data.groupBy("spec").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("unit").alias("units"), F.countDistinct("t").alias("days"),
        *[F.sum(F.col(c) * F.col(c)).alias(c) for c in names]).collect()}  # one row per specification

    def means(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy("spec", key).agg(*[F.avg(c).alias(f"m_{c}") for c in names], F.count(F.lit(1)).alias("_n"))

    def without(df: DataFrame, key: str) -> DataFrame:
        return df.join(means(df, key), ["spec", key]).select(
            "spec", "unit", "t", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names])

    closest, stalled, off = math.inf, 0, {}
    while stalled < 25:
        data = cut_lineage(without(without(data, "unit"), "t"))
        moved = means(data, "unit").groupBy("spec").agg(
            *[F.sum(F.col("_n") * F.pow(f"m_{c}", F.lit(2.0))).alias(c) for c in names]).collect()
        off = {r["spec"]: max(r[c] / max(size[r["spec"]][c], 1e-300) for c in names) for r in moved}
        furthest = max(off.values(), default=0.0)
        if furthest <= tolerance**2:
            break
        stalled = 0 if furthest < closest else stalled + 1
        closest = min(closest, furthest)

    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    fits = {}
    for row in data.groupBy("spec").agg(
            *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"g_{i}_{j}") for i, j in pairs]).collect():
        gram, known = _symmetric(row, "g", p + 1), size[row["spec"]]
        raw = np.array([known[c] for c in names[1:]])
        fits[row["spec"]] = _Fit(*_estimate(gram[1:, 1:], gram[1:, 0], raw), known["n"], known["units"], known["days"],
                                 off[row["spec"]] <= (1e3 * tolerance)**2)

    betas = panel.sparkSession.createDataFrame(
        [(s, [float(b) for b in f.beta]) for s, f in fits.items()], "spec string, _beta array<double>")
    error = F.col("v0") - sum((F.col(f"v{k + 1}") * F.col("_beta")[k] for k in range(p)), F.lit(0.0))
    scores = data.join(F.broadcast(betas), "spec").groupBy("spec", "unit").agg(  # one row per specification
        *[F.sum(F.col(f"v{k + 1}") * error).alias(f"s{k}") for k in range(p)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    meats = {r["spec"]: _symmetric(r, "m", p) for r in scores.groupBy("spec").agg(
        *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m_{i}_{j}") for i, j in pairs]).collect()}
    return fits, meats


def _table(spec: str, xs: list[str], fit: _Fit, meat: np.ndarray, debias: bool, level: float) -> list[tuple]:
    k = len(fit.kept)
    df_left = fit.n - k - (fit.units + fit.days - 1)
    cov = fit.inverse @ meat[np.ix_(fit.kept, fit.kept)] @ fit.inverse
    usable = df_left > 0 or not debias
    if debias and usable:
        cov = cov * (fit.n / df_left)
    reach = float("nan")
    if usable:
        tail = 0.5 + level / 2
        reach = dist.t_quantile(tail, df_left) if debias else dist.normal_quantile(tail)
    rows = []
    for j, term in enumerate(xs):
        if j not in fit.kept:
            rows.append((spec, term, *[None] * 6, fit.n, fit.units, fit.days, True, fit.converged))
            continue
        b = float(fit.beta[j])
        at = fit.kept.index(j)
        se = math.sqrt(max(cov[at, at], 0.0)) if usable else float("nan")
        stat = b / se if se > 0 else float("nan")
        p = dist.t_two_sided_p(stat, df_left) if debias else dist.normal_two_sided_p(stat)
        rows.append((spec, term, b, se, stat, p if se > 0 else float("nan"),
                     b - reach * se, b + reach * se, fit.n, fit.units, fit.days, False, fit.converged))
    return rows


# --- difference in differences -----------------------------------------------------------

def did_regression(panel: DataFrame, specs: dict[str, Column], *, fraction: float = 0.7,
                   method: str = "gradients") -> DataFrame:
    """Effect of the policy on log daily volume, one result row per specification.

    A specification is a condition choosing its panel rows, for example a
    control group without the holiday window.  Sparse units are dropped by the
    days of that specification.
    """
    data = _panel_copy(panel).withColumns({
        "log_trip_count": F.log("trip_count"),
        "did": F.col("is_treatment") * F.col("is_post"),
    })
    sample = presence_filter(with_specs(data, specs), ["spec"], fraction=fraction)
    fit = two_way_fixed_effects(sample, "location_id", "trip_date", "log_trip_count", ["did"], by="spec",
                                method=method)
    return with_percent_effects(fit)


def _panel_copy(panel: DataFrame) -> DataFrame:
    """The panel cut loose from the fact it was built from.

    The sample filters below read it several times; it has one row per unit
    and day, the fact behind it one per trip.
    """
    return cut_lineage(panel.where(F.col("trip_count") > 0))


def with_percent_effects(fit: DataFrame) -> DataFrame:
    return fit.withColumns({
        "pct_effect": C.percent_change(F.col("coef")),
        "pct_low": C.percent_change(F.col("ci_low")),
        "pct_high": C.percent_change(F.col("ci_high")),
    })


def keep_positive(panel: DataFrame, columns: Sequence[str], dropped: Observation | None = None) -> DataFrame:
    """Rows where every column is positive; ``dropped`` receives the number of others when the plan runs."""
    good = F.lit(True)
    for c in columns:
        good = good & (F.col(c) > 0)
    good = F.coalesce(good, F.lit(False))
    if dropped is not None:
        panel = panel.observe(dropped, C.count_where(~good).alias("dropped_rows"))
    return panel.where(good)


def did_outcomes(panel: DataFrame, sample: Column, *, fraction: float = 0.7,
                 dropped: Observation | None = None, method: str = "gradients") -> DataFrame:
    """Effect on log fare per trip, log pay per trip and pay as a share of fare.

    Log outcomes also show percent effects, the share shows percentage points.
    """
    fare, pay, n = F.col("total_base_fare"), F.col("total_driver_pay"), F.col("trip_count")
    outcomes = {
        "log_avg_fare": F.log(fare / n),
        "log_avg_pay": F.log(pay / n),
        "driver_share_of_fare": pay / fare,
    }
    usable = _panel_copy(keep_positive(panel, ["total_base_fare", "total_driver_pay"], dropped))
    kept = presence_filter(usable.where(sample), fraction=fraction)
    long = kept.withColumn("did", F.col("is_treatment") * F.col("is_post")).select(
        "location_id", "trip_date", "did",
        F.inline(F.array(*[F.struct(F.lit(k).alias("spec"), v.alias("y")) for k, v in outcomes.items()])))
    fit = two_way_fixed_effects(long, "location_id", "trip_date", "y", ["did"], by="spec", method=method)
    logged = F.col("spec") != "driver_share_of_fare"

    def effect(c: str) -> Column:
        return F.when(logged, C.percent_change(F.col(c))).otherwise(F.lit(100.0) * F.col(c))

    return fit.withColumns({
        "effect": effect("coef"), "effect_low": effect("ci_low"), "effect_high": effect("ci_high"),
        "effect_unit": F.when(logged, F.lit("percent")).otherwise(F.lit("percentage points")),
    })


def event_study(panel: DataFrame, policy: C.Moment, reference: int, *, fraction: float = 0.7,
                method: str = "gradients") -> DataFrame:
    """Treatment effect in each full week around the policy, relative to a reference week.

    Partial weeks go first, then units sparse in the days that are left.  The
    reference week is listed with a zero coefficient.
    """
    dated = event_weeks(_panel_copy(panel), policy)
    weeks = sorted(r[0] for r in dated.select("week_relative").distinct().collect())  # one per calendar week
    sample = presence_filter(dated, fraction=fraction).withColumns({
        "log_trip_count": F.log("trip_count"), "week": F.when(F.col("is_treatment") == 1, F.col("week_relative"))})
    fit = two_way_fixed_effects(sample, "location_id", "trip_date", "log_trip_count", [],
                                levels=("week", [w for w in weeks if w != reference]), method=method)
    week = F.regexp_replace("term", "week_", "").cast("int").alias("week_relative")
    table = fit.select(week, "coef", F.col("std_error").alias("se"), "ci_low", "ci_high")
    zero = panel.sparkSession.createDataFrame([(reference, 0.0, 0.0, 0.0, 0.0)], table.schema)
    return table.unionByName(zero).orderBy("week_relative")
