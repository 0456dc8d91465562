"""The Nemenman-Shafee-Bialek estimator: two integrals over a prior weight, from a histogram's profile."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.special import digamma_value, trigamma_value


def _log_weight(beta: float, profile: list[tuple[float, float]], n: float, k: float) -> float:
    out = math.lgamma(n + k * beta) - math.lgamma(k * beta)
    low = math.lgamma(beta)
    return out - sum(m * c * (math.lgamma(c + beta) - low) for c, m in profile)


def nsb_value(profile: list[tuple[float, float]], k: int | None = None) -> float:
    """Entropy in nats; NaN without a coincidence, with one symbol or none.

    ``profile`` pairs counts with their numbers of symbols. The likelihood weighs each symbol's term by its count, so over many
    samples its peak is narrow, and often at the end of the range. The range is narrowed to where the integrand, smooth in the logarithm of the weight, is
    not negligible, and Gauss-Legendre panels there converge fast.
    """
    n = sum(c * m for c, m in profile)
    seen = sum(m for _, m in profile)
    kinds = float(k) if k is not None else seen
    if not n or not kinds or n == kinds or kinds <= 1 or math.log(kinds) <= 1e-8:
        return math.nan

    def weighed(u: np.ndarray) -> np.ndarray:
        """Logarithm of the likelihood times the prior's slope."""
        out = []
        for beta in np.exp(u).tolist():
            slope = kinds * trigamma_value(1 + kinds * beta) - trigamma_value(1 + beta)
            out.append(-_log_weight(beta, profile, n, kinds) + math.log(beta * slope) if slope > 0 else -math.inf)
        return np.array(out)

    low, high = math.log(1e-8), math.log(math.log(kinds))
    for _ in range(80):
        grid = np.linspace(low, high, 33)
        logs = weighed(grid)
        if not np.isfinite(logs.max()):
            return math.nan
        some = np.flatnonzero(logs > logs.max() - 60)
        a, b = float(grid[max(some[0] - 1, 0)]), float(grid[min(some[-1] + 1, 32)])
        if b - a > 0.5 * (high - low):
            break
        low, high = a, b
    points, weights = np.polynomial.legendre.leggauss(24)
    edges = np.linspace(low, high, 33)
    half = (edges[1:] - edges[:-1])[:, None] / 2
    u = (edges[:-1, None] + half + half * points).ravel()
    logs = weighed(u)
    rho = np.exp(logs - logs.max()) * (half * weights).ravel()
    values = []
    for beta in np.exp(u).tolist():
        total = n + seen * beta
        values.append(digamma_value(total + 1) - sum(m * (c + beta) * digamma_value(c + beta + 1) for c, m in profile) / total)
    below = float(rho.sum())
    return float((rho * np.array(values)).sum() / below) if below and math.isfinite(below) else math.nan


def nsb_entropy(profile: str, k: int | None) -> Column:
    """The estimate as a column over a profile column; one call a histogram, not a row of data."""

    @F.pandas_udf("double")
    def estimate(rows: pd.Series) -> pd.Series:
        return pd.Series([nsb_value([(x["c"], x["m"]) for x in r], k) for r in rows], dtype="float64")

    return estimate(F.col(profile))
