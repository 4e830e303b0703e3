"""Quantile of the chi-square distribution, for outlier thresholds."""

from __future__ import annotations

import math


def _lower_gamma(a: float, x: float) -> float:
    """Regularized lower incomplete gamma function by its power series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    """Value below which a share ``q`` of a chi-square variable with ``k`` degrees lies."""
    if not 0 < q < 1 or k < 1:
        raise ValueError("need 0 < q < 1 and at least one degree of freedom")
    low, high = 0.0, float(k)
    while _lower_gamma(k / 2, high / 2) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if _lower_gamma(k / 2, mid / 2) < q:
            low = mid
        else:
            high = mid
    return (low + high) / 2
