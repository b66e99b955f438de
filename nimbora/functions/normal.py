"""The normal distribution as column expressions (absolute errors below 2e-7 and 2e-9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26.
ERF = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
ERF_P = 0.3275911

#: Acklam's rational approximation of the normal quantile.
A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
LOW = 0.02425


def _poly(x: Column, parts: list[float]) -> Column:
    total = F.lit(parts[0])
    for p in parts[1:]:
        total = total * x + p
    return total


def erf(x: Column) -> Column:
    """The error function."""
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    return F.signum(x) * (1.0 - _poly(t, ERF[::-1]) * t * F.exp(-x * x))


def cdf(x: Column) -> Column:
    """The normal distribution function."""
    return 0.5 * (1.0 + erf(x / F.sqrt(F.lit(2.0))))


def quantile(p: Column) -> Column:
    """The normal quantile of 0 < p < 1."""
    tail = F.sqrt(-2.0 * F.ln(F.least(p, 1.0 - p)))
    outer = _poly(tail, C) / (_poly(tail, D) * tail + 1.0)
    q = p - 0.5
    inner = _poly(q * q, A) * q / (_poly(q * q, B) * q * q + 1.0)
    return F.when(p < LOW, outer).when(p > 1 - LOW, -outer).otherwise(inner)
