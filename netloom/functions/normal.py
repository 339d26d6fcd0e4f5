"""Normal distribution function and quantile as Column expressions (neither engine has them built in)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the error function's approximation 7.1.26 of Abramowitz and Stegun.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
#: Coefficients of Acklam's approximation of the normal quantile.
QA = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QB = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TAIL = 0.02425


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def pnorm(x: Column) -> Column:
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + ERF_P * z)
    upper = 0.5 * t * horner(t, ERF[::-1]) * F.exp(-z * z)
    return F.when(x >= 0, 1.0 - upper).otherwise(upper)


def qnorm(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    q = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    tail = horner(q, QC) / (horner(q, QD) * q + 1.0)
    r = p - 0.5
    s = r * r
    middle = horner(s, QA) * r / (horner(s, QB) * s + 1.0)
    return F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(middle)
