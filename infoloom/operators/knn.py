"""Nearest-neighbour estimators: Kozachenko-Leonenko, Rényi and Tsallis entropies, and KSG information."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.validate import Variable, at_least, positive, unit, variable
from ..functions.special import digamma, digamma_value, unit_ball_volume
from ..plans.series import checkpointed
from .neighbors import every_row, kth_distance, points, range_counts, total

METRICS = {"chebyshev": math.inf, "euclidean": 2.0, "manhattan": 1.0}


def norm(metric: str | float) -> float:
    """The Minkowski power of a metric's name or number."""
    if isinstance(metric, str):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}; there are {', '.join(METRICS)}")
        return METRICS[metric]
    if not metric > 0:
        raise ValueError("a metric's power must be positive")
    return float(metric)


def noisy(df: DataFrame, columns: Sequence[str], noise: float, seed: int) -> DataFrame:
    """Columns with normal noise of standard deviation ``noise``; none at 0. It is drawn once, so that all terms of a measure see the same."""
    if noise <= 0:
        return df
    return checkpointed(df.select(*[(F.col(c) + noise * F.randn(seed + i)).alias(c) if c in columns else F.col(c) for i, c in enumerate(df.columns)]))


def _radii(df: DataFrame, cols: Sequence[str], k: int, p: float, other: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct points with their radii ``_rho`` and numbers of rows ``_w``, and the points that were searched."""
    at_least("k", k, 1)
    mine = points(df, cols)
    data = mine if other is None else points(other, cols)
    return kth_distance(mine, data, k, p, other is None), data


def _rows() -> Column:
    return F.coalesce(F.sum("_w"), F.lit(0).cast("long"))


def _mean_log(factor: float = 1.0) -> Column:
    """Mean over rows of the log of positive radii times a factor; 0 if there is none."""
    some = F.col("_rho") > 0
    return F.coalesce(F.sum(F.when(some, F.col("_w") * F.log(factor * F.col("_rho")))) / F.sum(F.when(some, F.col("_w"))), F.lit(0.0))


def kl_entropy(
    df: DataFrame, x: Variable, k: int = 4, variant: int = 1, metric: str | float = "chebyshev", base: float = math.e, noise: float = 0.0, seed: int = 0
) -> DataFrame:
    """Kozachenko-Leonenko entropy: ``value, n``. Zero radii are left out of the mean; a single point or none gives 0."""
    cols, p = variable(x), norm(metric)
    df = noisy(df.select(*dict.fromkeys(cols)), cols, noise, seed)
    if df.limit(2).count() < 2:
        return df.agg(F.lit(0.0).alias("value"), F.count(F.lit(1)).alias("n"))
    d = len(cols)
    found, _ = _radii(df, cols, k, p)
    n = _rows()
    fixed = -digamma_value(k) + (1 / k if variant == 2 else 0.0) + math.log(unit_ball_volume(d, p, 0.5))
    value = digamma(n) + fixed + d * _mean_log(2.0)
    return found.agg((value / unit(base)).alias("value"), n.alias("n"))


def kl_local_entropy(df: DataFrame, x: Variable, k: int = 4, variant: int = 1, metric: str | float = "chebyshev", base: float = math.e) -> DataFrame:
    """Per-point terms, ``local_value``; a point with a zero radius keeps the constant alone."""
    cols, p = variable(x), norm(metric)
    found, data = _radii(df.select(*dict.fromkeys(cols)), cols, k, p)
    n = total(data)
    fixed = digamma_value(n) - digamma_value(k) + (1 / k if variant == 2 else 0.0) + math.log(unit_ball_volume(len(cols), p, 0.5))
    term = fixed + len(cols) * F.when(F.col("_rho") > 0, F.log(2 * F.col("_rho"))).otherwise(0.0)
    return every_row(found.select("_w", (term / unit(base)).alias("local_value"))).select("local_value")


def kl_cross_entropy(p: DataFrame, q: DataFrame, x: Variable, k: int = 4, variant: int = 1, metric: str | float = "chebyshev", base: float = math.e) -> DataFrame:
    """``H_Q(P)`` from distances of P's points to their k-th nearest of Q."""
    cols, power = variable(x), norm(metric)
    found, data = _radii(p, cols, k, power, q)
    m = total(data)
    d = len(cols)
    fixed = -digamma_value(k) + (1 / k if variant == 2 else 0.0) + digamma_value(m) + math.log(unit_ball_volume(d, power, 0.5)) + d * math.log(2)
    return found.agg(((fixed + d * _mean_log()) / unit(base)).alias("value"), _rows().alias("n"))


def _order_value(found: DataFrame, d: int, k: int, order: float, kind: str, base: float) -> DataFrame:
    """Rényi or Tsallis entropy from radii; the number of radii stands for the number of samples."""
    n, ln = _rows().cast("double"), unit(base)
    rho, w, volume = F.col("_rho"), F.col("_w"), unit_ball_volume(d, 2.0, 1.0)
    if abs(order - 1) < 1e-12:
        total = F.coalesce(F.sum(F.when(rho > 0, w * F.log(rho))), F.lit(0.0))
        value: Column = (d * total + n * F.log((n - 1) * (math.exp(-digamma_value(k)) * volume))) / (n * ln)
    elif abs(order - (k + 1)) < 1e-12:
        value = F.lit(0.0)
    else:
        c = (math.gamma(k) / math.gamma(k + 1 - order)) ** (1 / (1 - order)) if math.gamma(k + 1 - order) > 0 else math.nan
        total = F.coalesce(F.sum(F.when(rho > 0, w * F.pow(rho, F.lit(d * (1 - order))))), F.lit(0.0))
        integral = F.pow((n - 1) * (c * volume), F.lit(1 - order)) * total / n
        if kind == "renyi":
            value = F.when(integral > 0, F.log(integral) / ((1 - order) * ln)).otherwise(0.0)
        else:
            value = (integral - 1) / (1 - order)
    return found.agg(value.alias("value"), _rows().alias("n"))


def renyi_entropy(df: DataFrame, x: Variable, alpha: float, k: int = 4, base: float = math.e, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Rényi entropy of order ``alpha`` from Euclidean neighbour distances: ``value, n``."""
    positive("alpha", alpha)
    cols = variable(x)
    df = noisy(df.select(*dict.fromkeys(cols)), cols, noise, seed)
    return _order_value(_radii(df, cols, k, 2.0)[0], len(cols), k, alpha, "renyi", base)


def tsallis_entropy(df: DataFrame, x: Variable, q: float, k: int = 4, base: float = math.e, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Tsallis entropy of order ``q``; the base matters at order 1 alone: ``value, n``."""
    positive("q", q)
    cols = variable(x)
    df = noisy(df.select(*dict.fromkeys(cols)), cols, noise, seed)
    return _order_value(_radii(df, cols, k, 2.0)[0], len(cols), k, q, "tsallis", base)


def renyi_cross_entropy(p: DataFrame, q: DataFrame, x: Variable, alpha: float, k: int = 4, base: float = math.e) -> DataFrame:
    """Rényi cross-entropy; the sample count is P's."""
    positive("alpha", alpha)
    cols = variable(x)
    return _order_value(_radii(p, cols, k, 2.0, q)[0], len(cols), k, alpha, "renyi", base)


def tsallis_cross_entropy(p: DataFrame, other: DataFrame, x: Variable, q: float, k: int = 4, base: float = math.e) -> DataFrame:
    """Tsallis cross-entropy; the sample count is P's."""
    positive("q", q)
    cols = variable(x)
    return _order_value(_radii(p, cols, k, 2.0, other)[0], len(cols), k, q, "tsallis", base)


def signed_sum(df: DataFrame, terms: dict[tuple[str, ...], float], approach: str, noise: float = 0.0, seed: int = 0, **params) -> DataFrame:
    """``sum of weight * H(columns)`` for the kl, renyi and tsallis entropies; noise is added once, before."""
    one = {"kl": kl_entropy, "renyi": renyi_entropy, "tsallis": tsallis_entropy}[approach]
    cols = list(dict.fromkeys(c for t in terms for c in t))
    df = noisy(df.select(*cols).dropna(), cols, noise, seed)
    out = None
    for t, w in terms.items():
        if not w:
            continue
        part = one(df, t, **params).select((F.col("value") * w).alias("v"), F.col("n").alias("m"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.agg(F.lit(0.0).alias("value"), F.count(F.lit(1)).alias("n"))
    return out.agg(F.sum("v").alias("value"), F.max("m").alias("n"))


def _ksg_terms(
    df: DataFrame,
    variables: Sequence[Variable],
    given: Variable | None = None,
    k: int = 4,
    variant: int = 1,
    metric: str | float = "chebyshev",
    base: float = math.e,
    noise: float = 0.0,
    seed: int = 0,
) -> DataFrame:
    if variant not in (1, 2):
        raise ValueError("variant must be 1 or 2")
    if given is not None and len(variables) != 2:
        raise ValueError("conditional information takes two variables")
    p = norm(metric)
    cols: list[str] = []
    where: list[list[int]] = []
    for v in [*variables, *([given] if given is not None else [])]:
        where.append(list(range(len(cols), len(cols) + len(variable(v)))))
        cols += variable(v)
    df = noisy(df.select(*[F.col(c).alias(f"_v{i}") for i, c in enumerate(cols)]), [f"_v{i}" for i in range(len(cols))], noise, seed)
    data = points(df, [f"_v{i}" for i in range(len(cols))])
    near = kth_distance(data, data, k, p, True)
    if given is None:
        spaces = {f"_n{i}": w for i, w in enumerate(where)}
    else:
        spaces = {"_n0": where[0] + where[2], "_n1": where[1] + where[2], "_nz": where[2]}
    found = range_counts(near, data, spaces, p, strict=variant == 1)

    def psi(c: str) -> Column:
        count = F.col(c)
        if variant == 1:  # without the point itself, which a zero radius does not reach
            count = F.greatest(count - 1, F.lit(0)) + 1
        return digamma(count)

    fixed = digamma_value(k) - (1 / k if variant == 2 else 0.0)
    if given is None:
        n = total(data)
        term = F.lit(fixed + (len(variables) - 1) * digamma_value(n)) - sum((psi(s) for s in spaces), F.lit(0.0))
    else:
        term = F.lit(fixed) + psi("_nz") - psi("_n0") - psi("_n1")
    return found.select("_w", (term / unit(base)).alias("local_value"))


def ksg_local(df: DataFrame, variables: Sequence[Variable], given: Variable | None = None, **params) -> DataFrame:
    """KSG terms of each row, ``local_value``, for (conditional) mutual information.

    Parameters are ``k``, ``variant``, ``metric``, ``base``, ``noise`` and ``seed``. Variant 1 counts rows strictly nearer than
    the k-th joint neighbour, the row itself not; variant 2 those at most as far, itself included.
    """
    return every_row(_ksg_terms(df, variables, given, **params)).select("local_value")


def ksg(df: DataFrame, variables: Sequence[Variable], given: Variable | None = None, **params) -> DataFrame:
    """Mean of :func:`ksg_local`: ``value, n``."""
    terms = _ksg_terms(df, variables, given, **params)
    return terms.agg((F.sum(F.col("_w") * F.col("local_value")) / F.sum("_w")).alias("value"), _rows().alias("n"))
