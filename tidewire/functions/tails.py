"""Tail probabilities.

The normal tail is a Column expression (a published rational approximation, double
precision), so every normal-based p-value stays in the JVM. The t and F tails need
the incomplete beta function and run in Arrow batches on already reduced rows.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# Coefficients of the normal tail approximation (West, 2005).
_NUM = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
_DEN = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
_SPLIT = 7.07106781186547


def _horner(x: Column, coefs: list[float]) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_sf(z: Column) -> Column:
    """P(Z > z)."""
    a = F.abs(z)
    density = F.exp(-a * a / 2.0)
    body = density * _horner(a, _NUM) / _horner(a, _DEN)
    far = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
    tail = F.when(a > 37.0, 0.0).when(a < _SPLIT, body).otherwise(density / far / 2.506628274631)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def normal_two_sided(z: Column) -> Column:
    return 2.0 * normal_sf(F.abs(z))


def normal_sf_sql(z: str) -> str:
    """The same expression as text, for the SQL twins."""
    a = f"abs({z})"

    def horner(coefs: list[float]) -> str:
        out = repr(coefs[0]) + "::DOUBLE"
        for c in coefs[1:]:
            out = f"({out}*{a}+{c!r}::DOUBLE)"
        return out

    e = f"exp(-{a}*{a}/2)"
    body = f"({e}*{horner(_NUM)}/{horner(_DEN)})"
    far = f"({a}+1.0/({a}+2.0/({a}+3.0/({a}+4.0/({a}+0.65)))))"
    tail = (f"(CASE WHEN {a}>37 THEN 0.0 WHEN {a}<{_SPLIT} THEN {body} "
            f"ELSE {e}/{far}/2.506628274631 END)")
    return f"(CASE WHEN {z}>=0 THEN {tail} ELSE 1.0-{tail} END)"


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    if not 0.0 < x < 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in count(1):  # terms fall geometrically here, so this ends
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d = 1.0 + coef * d
            c = 1.0 + coef / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            total *= step
        if not math.isfinite(total):
            return float("nan")
        if abs(step - 1.0) < 1e-15:
            break
    return front * total


def f_tail(f: float, q: float, dof: float) -> float:
    """P(F(q, dof) > f)."""
    if not (f is not None and np.isfinite(f) and q > 0 and dof > 0):
        return float("nan")
    return 1.0 if f <= 0 else beta_tail(dof / (dof + q * f), dof / 2.0, q / 2.0)


def t_tail(t: float, dof: float) -> float:
    """Two-sided P(|T(dof)| > |t|)."""
    if not (t is not None and np.isfinite(t) and dof > 0):
        return float("nan")
    return beta_tail(dof / (dof + t * t), dof / 2.0, 0.5)


def f_sf(f: Column, q: Column, dof: Column) -> Column:
    """P(F(q, dof) > f) for a column of reduced rows."""
    @F.pandas_udf("double")
    def tail(fs: pd.Series, qs: pd.Series, dofs: pd.Series) -> pd.Series:
        out = pd.Series([f_tail(*v) for v in zip(fs, qs, dofs)], dtype="float64")
        return out.astype(object).where(out.notna(), None)
    return tail(f, q, dof)


def t_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided t tail for a column of reduced rows."""
    @F.pandas_udf("double")
    def tail(ts: pd.Series, dofs: pd.Series) -> pd.Series:
        out = pd.Series([t_tail(*v) for v in zip(ts, dofs)], dtype="float64")
        return out.astype(object).where(out.notna(), None)
    return tail(t, dof)
