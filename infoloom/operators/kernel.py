"""Kernel density measures: box and Gaussian kernels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.validate import Variable, positive, unit, variable
from .neighbors import Kernel, every_row, gaussian, kernel_sums, points, rank_counts

KERNELS = ("box", "gaussian")
EDGE = 1e-15


def _checked(kernel: str, bandwidth: float) -> None:
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}; there are {', '.join(KERNELS)}")
    positive("bandwidth", bandwidth)


def _moments(data: DataFrame, dim: int, spread: bool) -> tuple[int, np.ndarray]:
    """Number of rows behind the points and, with ``spread``, their sample covariance, by two aggregations."""
    w = F.col("_w")
    mean = data.agg(F.coalesce(F.sum(w), F.lit(0)).alias("n"), *[(F.sum(w * F.col("_x")[i]) / F.sum(w)).alias(f"m{i}") for i in range(dim)]).first()
    cov = np.full((dim, dim), np.nan)
    if spread and mean.n > 1:
        off = [F.col("_x")[i] - mean[f"m{i}"] for i in range(dim)]
        r = data.agg(*[F.sum(w * off[i] * off[j]).alias(f"c{i}_{j}") for i in range(dim) for j in range(i, dim)]).first()
        for i in range(dim):
            for j in range(i, dim):
                cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] / (mean.n - 1)
    return mean.n, cov


def densities(queries: DataFrame, data: DataFrame, dim: int, subspaces: dict[str, Sequence[int]], kernel: str, bandwidth: float) -> DataFrame:
    """Density of the data at each query in each subspace: ``_id, _x, _w`` and a column each.

    A Gaussian kernel is taken in coordinates in which a subspace's scaled covariance is the identity. All pairs count, however far apart
    and however many points there are.
    """
    n, cov = _moments(data, dim, kernel == "gaussian")
    radius = bandwidth / 2 + EDGE
    if kernel == "box":
        if dim == 1 and len(subspaces) == 1:
            (name,) = subspaces
            return rank_counts(data, radius, None if queries is data else queries).select("_id", "_x", "_w", (F.col("_cnt") / (n * bandwidth)).alias(name))
        kernels = {s: Kernel(dims, math.inf, radius) for s, dims in subspaces.items()}
        scales = {s: n * bandwidth ** len(dims) for s, dims in subspaces.items()}
    else:
        kernels, scales = {}, {}
        for s, dims in subspaces.items():
            lower = np.linalg.cholesky(cov[np.ix_(dims, dims)] * bandwidth**2)
            kernels[s] = gaussian(dims, np.linalg.inv(lower))
            scales[s] = n * (2 * math.pi) ** (len(dims) / 2) * float(np.prod(np.diag(lower)))
    found = kernel_sums(queries, data, kernels)
    return found.select("_id", "_x", "_w", *[(F.col(s) / c).alias(s) for s, c in scales.items()])


def _ln(c: str) -> Column:
    return F.when(F.col(c) > 0, F.log(F.col(c))).otherwise(0.0)


def _entropy_terms(df: DataFrame, x: Variable, kernel: str, bandwidth: float, base: float) -> DataFrame:
    _checked(kernel, bandwidth)
    cols = variable(x)
    data = points(df, cols)
    found = densities(data, data, len(cols), {"d": range(len(cols))}, kernel, bandwidth)
    return found.select("_w", (-_ln("d") / unit(base)).alias("local_value"))


def local_entropy(df: DataFrame, x: Variable, kernel: str = "box", bandwidth: float = 1.0, base: float = math.e) -> DataFrame:
    """``-ln`` of the density at each point (0 where it is 0): ``local_value``, a row for each complete row."""
    return _rows(_entropy_terms(df, x, kernel, bandwidth, base))


def entropy(df: DataFrame, x: Variable, kernel: str = "box", bandwidth: float = 1.0, base: float = math.e) -> DataFrame:
    """Mean of the local values: ``value, n``."""
    return _mean(_entropy_terms(df, x, kernel, bandwidth, base))


def _rows(terms: DataFrame) -> DataFrame:
    return every_row(terms).select("local_value")


def _mean(terms: DataFrame) -> DataFrame:
    n = F.coalesce(F.sum("_w"), F.lit(0).cast("long"))
    return terms.agg(F.coalesce(F.sum(F.col("_w") * F.col("local_value")) / F.sum("_w"), F.lit(0.0)).alias("value"), n.alias("n"))


def cross_entropy(p: DataFrame, q: DataFrame, x: Variable, kernel: str = "box", bandwidth: float = 1.0, base: float = math.e) -> DataFrame:
    """``-mean ln`` of Q's density at P's points; points of zero density add 0 and count. Covariance is Q's."""
    _checked(kernel, bandwidth)
    cols = variable(x)
    a, b = points(p, cols), points(q, cols)
    found = densities(a, b, len(cols), {"d": range(len(cols))}, kernel, bandwidth)
    return _mean(found.select("_w", (-_ln("d") / unit(base)).alias("local_value")))


def _layout(parts: Sequence[Variable]) -> tuple[list[str], list[list[int]]]:
    cols, where = [], []
    for v in parts:
        where.append(list(range(len(cols), len(cols) + len(variable(v)))))
        cols += variable(v)
    return cols, where


def _information_terms(df: DataFrame, variables: Sequence[Variable], kernel: str, bandwidth: float, base: float) -> DataFrame:
    _checked(kernel, bandwidth)
    cols, where = _layout(variables)
    spaces = {"joint": list(range(len(cols)))} | {f"m{i}": w for i, w in enumerate(where)}
    data = points(df, cols)
    found = densities(data, data, len(cols), spaces, kernel, bandwidth)
    value = _ln("joint") - sum((_ln(f"m{i}") for i in range(len(where))), F.lit(0.0))
    return found.select("_w", (F.when(F.col("joint") > 0, value).otherwise(0.0) / unit(base)).alias("local_value"))


def local_mutual_information(df: DataFrame, variables: Sequence[Variable], kernel: str = "box", bandwidth: float = 1.0, base: float = math.e) -> DataFrame:
    """``ln`` of the joint density over the product of the marginal ones; zero marginals are passed over, a zero joint gives 0."""
    return _rows(_information_terms(df, variables, kernel, bandwidth, base))


def mutual_information(df: DataFrame, variables: Sequence[Variable], kernel: str = "box", bandwidth: float = 1.0, base: float = math.e) -> DataFrame:
    return _mean(_information_terms(df, variables, kernel, bandwidth, base))


def _conditional_terms(df: DataFrame, x: Variable, y: Variable, given: Variable, kernel: str, bandwidth: float, base: float) -> DataFrame:
    _checked(kernel, bandwidth)
    cols, (wx, wy, wz) = _layout([x, y, given])
    data = points(df, cols)
    spaces = {"xyz": list(range(len(cols))), "z": wz, "xz": wx + wz, "yz": wy + wz}
    found = densities(data, data, len(cols), spaces, kernel, bandwidth)
    ok = (F.col("xyz") > 0) & (F.col("z") > 0) & (F.col("xz") > 0) & (F.col("yz") > 0)
    return found.select("_w", (F.when(ok, _ln("xyz") + _ln("z") - _ln("xz") - _ln("yz")).otherwise(0.0) / unit(base)).alias("local_value"))


def local_conditional_mutual_information(
    df: DataFrame, x: Variable, y: Variable, given: Variable, kernel: str = "box", bandwidth: float = 1.0, base: float = math.e
) -> DataFrame:
    """``ln( d(x,y,z) d(z) / (d(x,z) d(y,z)) )``, 0 where any density is 0."""
    return _rows(_conditional_terms(df, x, y, given, kernel, bandwidth, base))


def conditional_mutual_information(df: DataFrame, x: Variable, y: Variable, given: Variable, kernel: str = "box", bandwidth: float = 1.0, base: float = math.e) -> DataFrame:
    return _mean(_conditional_terms(df, x, y, given, kernel, bandwidth, base))
