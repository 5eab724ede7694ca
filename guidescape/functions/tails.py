"""Tail probabilities as Spark columns.

Chi-square, normal and t tails reach the numeric library Spark already ships through ``java_method``; call them on
aggregated rows. The hypergeometric tails are sums of varying length, so they run as one vectorised Arrow function over
distinct argument combinations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
# ln(n!) minus Stirling's formula for n = 0..15, where the series below is not yet exact to double precision
SMALL_STIRLING = np.array(
    [0.0] + [math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + HALF_LOG_2PI) for n in range(1, 16)]
)


def _double(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _stirling_error(n: np.ndarray) -> np.ndarray:
    big = np.maximum(n, 16.0)
    n2 = big * big
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / n2) / n2) / n2) / n2) / big
    return np.where(n <= 15, SMALL_STIRLING[np.clip(n, 0, 15).astype(int)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x·ln(x/mean) + mean − x, written so that x close to the mean does not cancel."""
    rel = (x - mean) / mean
    return mean * ((rel + 1) * np.log1p(rel) - rel)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    inner = (
        _stirling_error(n)
        - _stirling_error(x)
        - _stirling_error(n - x)
        - _deviance(x, n * p)
        - _deviance(n - x, n * (1 - p))
        - HALF_LOG_2PI
        - 0.5 * (np.log(x) + np.log1p(-x / n))
    )
    at_ends = np.where(x == 0, n * np.log1p(-p), n * np.log(p))
    return np.where(n == 0, 0.0, np.where((x == 0) | (x == n), at_ends, inner))


def _mass(x: np.ndarray, m: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """P(X = x) by the saddle-point form (Loader 2000), which stays accurate where differences of log-gammas cancel."""
    p = k / (m + n)
    value = _log_binomial(x, m, p) + _log_binomial(k - x, n, p) - _log_binomial(k, m + n, p)
    return np.where((k == 0) | (k == m + n), 1.0, np.exp(value))


def _declining_sum(x: np.ndarray, m: np.ndarray, n: np.ndarray, k: np.ndarray, step: int) -> np.ndarray:
    """1 + r1 + r1·r2 + …: masses relative to the one at ``x``, walking away from the mode until they vanish."""
    total, term, at = np.ones_like(x), np.ones_like(x), x.copy()
    live = np.arange(len(x))
    while len(live):
        a, mm, nn, kk = at[live], m[live], n[live], k[live]
        if step > 0:
            ratio = (mm - a) * (kk - a) / ((a + 1) * (nn - kk + a + 1))
        else:
            ratio = a * (nn - kk + a) / ((mm - a + 1) * (kk - a + 1))
        term[live] *= ratio
        total[live] += term[live]
        at[live] += step
        live = live[term[live] > total[live] * 1e-18]
    return total


def hypergeom_tail_values(
    q: np.ndarray, m: np.ndarray, n: np.ndarray, k: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(P(X ≥ q), P(X ≤ q)) for k draws from m white and n black; NaN when more is drawn than there is.

    Only the declining side of the distribution is summed; the other tail is its complement.
    """
    q, m, n, k = (np.array(v, dtype=float) for v in (q, m, n, k))
    upper, lower = np.full(len(q), np.nan), np.full(len(q), np.nan)
    low, high = np.maximum(0.0, k - n), np.minimum(m, k)
    valid = k <= m + n
    mode = np.floor((k + 1) * (m + 1) / (m + n + 2))
    upper[valid & (q <= low)], upper[valid & (q > high)] = 1.0, 0.0
    lower[valid & (q >= high)], lower[valid & (q < low)] = 1.0, 0.0

    def tail(pick: np.ndarray, start: np.ndarray, step: int) -> np.ndarray:
        args = m[pick], n[pick], k[pick]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.minimum(1.0, _mass(start[pick], *args) * _declining_sum(start[pick], *args, step))

    inside = valid & (q > low) & (q <= high)
    above, below = inside & (q > mode), inside & (q <= mode)
    upper[above] = tail(above, q, 1)
    upper[below] = 1.0 - tail(below, q - 1, -1)
    inside = valid & (q >= low) & (q < high)
    above, below = inside & (q >= mode), inside & (q < mode)
    lower[above] = 1.0 - tail(above, q + 1, 1)
    lower[below] = tail(below, q, -1)
    return upper, lower


TAILS = T.StructType([T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())])


@F.pandas_udf(TAILS)
def _hypergeom_tails(q: pd.Series, m: pd.Series, n: pd.Series, k: pd.Series) -> pd.DataFrame:
    upper, lower = hypergeom_tail_values(q, m, n, k)
    return pd.DataFrame({"upper": upper, "lower": lower})


def hypergeom_tails(q, m, n, k) -> Column:
    """Struct of ``upper`` = P(X ≥ q) and ``lower`` = P(X ≤ q); null when more is drawn than there is."""
    return _hypergeom_tails(*[_double(c) for c in (q, m, n, k)])


def _special(name: str, *args: Column) -> Column:
    """A static method of the bundled numeric library; null arguments stay null instead of failing."""
    ok = args[0].isNotNull()
    for arg in args[1:]:
        ok = ok & arg.isNotNull()
    safe = [F.coalesce(a, F.lit(1.0)) for a in args]
    owner, method = name.split(".")
    call = F.call_function(
        "java_method", F.lit(f"org.apache.commons.math3.special.{owner}"), F.lit(method), *safe
    )
    return F.when(ok, call.cast("double"))


def chi2_upper(stat, df) -> Column:
    """P(χ²(df) ≥ stat)."""
    stat, df = _double(stat), _double(df)
    return F.when(stat <= 0, 1.0).otherwise(_special("Gamma.regularizedGammaQ", df / 2, stat / 2))


def normal_upper(z) -> Column:
    """P(Z ≥ z), Z standard normal."""
    return 0.5 * _special("Erf.erfc", _double(z) / math.sqrt(2))


def student_two_sided(t, df) -> Column:
    """P(|T| ≥ |t|), T with df degrees of freedom."""
    t, df = _double(t), _double(df)
    return _special("Beta.regularizedBeta", df / (df + t * t), df / 2, F.lit(0.5))
