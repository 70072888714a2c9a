"""Tail probabilities and quantiles for regression tables.

They run on the driver over one row per coefficient.  The normal
distribution comes from the standard library; Student's t is integrated
numerically, which is exact to about 1e-12 at the degrees of freedom in use.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_STANDARD = NormalDist()


def normal_two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    return _STANDARD.inv_cdf(p)


def _t_density(x, df: float):
    log_scale = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return np.exp(log_scale - (df + 1) / 2 * np.log1p(np.square(x) / df))


def t_two_sided_p(t: float, df: float) -> float:
    """P(|T| > |t|): 1 - 2 * integral of the density over [0, |t|]."""
    t = abs(t)
    if math.isinf(t):
        return 0.0
    # Substituting x = sqrt(df) * tan(u) bounds the integrand for any df.
    u = np.linspace(0.0, math.atan(t / math.sqrt(df)), 4001)
    x = math.sqrt(df) * np.tan(u)
    values = _t_density(x, df) * math.sqrt(df) * (1 + np.square(np.tan(u)))
    h = u[1] - u[0]
    simpson = h / 3 * (values[0] + values[-1] + 4 * values[1:-1:2].sum() + 2 * values[2:-1:2].sum())
    return float(min(1.0, max(0.0, 1.0 - 2.0 * simpson)))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile (p > 0.5) by Newton steps from the normal quantile."""
    x = normal_quantile(p)
    for _ in range(60):
        step = ((1 - t_two_sided_p(x, df) / 2) - p) / float(_t_density(x, df))
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-13:
            break
    return x
