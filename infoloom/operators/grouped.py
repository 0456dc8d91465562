"""Continuous entropies of many independent datasets at once: one for each group.

Groups of up to ``GROUP_POINTS`` points are solved whole, one task after the other, in plain arrays. Larger ones go to the
block operators all at once: their number is one more coordinate, so far apart that no point of another group is near.
In one dimension nearest neighbours stand beside each other in order, so groups of any size cost a sort and stay out of Python.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.validate import Variable, complete, positive, unit, variable
from ..functions.special import digamma_value, unit_ball_volume
from . import kernel, knn
from ..plans.series import Ordered, checkpointed, global_row_number
from .neighbors import CELLS, Kernel, distances, gaussian, kernel_sums, kth_distance, points

GROUP_POINTS = 20_000


def _rows(n: int, dim: int) -> int:
    return max(1, CELLS // max(1, n * dim))


def _radii(x: np.ndarray, k: int, p: float) -> np.ndarray:
    if k >= len(x):
        raise ValueError(f"k = {k} needs more points than {len(x)}")
    step = _rows(*x.shape)
    return np.concatenate([np.partition(distances(x[a : a + step], x, p), k, axis=1)[:, k] for a in range(0, len(x), step)])


def _sums(x: np.ndarray, rho: np.ndarray, powers: float) -> tuple[int, int, int, float, float]:
    """What the nearest-neighbour estimators need of a group's radii."""
    some = rho[rho > 0]
    return len(x), x.shape[1], len(some), float(np.log(some).sum()), float((some**powers).sum())


def _kl_value(n: int, d: int, some: int, logs: float, k: int, p: float, variant: int, base: float) -> float:
    if n < 2:
        return 0.0
    mean = math.log(2) + logs / some if some else 0.0
    value = digamma_value(n) - digamma_value(k) + (1 / k if variant == 2 else 0.0) + math.log(unit_ball_volume(d, p, 0.5)) + d * mean
    return value / unit(base)


def _kl(x: np.ndarray, k: int = 4, variant: int = 1, metric: str | float = "chebyshev", base: float = math.e) -> float:
    p = knn.norm(metric)
    return _kl_value(*_sums(x, _radii(x, k, p), 1.0)[:4], k, p, variant, base) if len(x) > 1 else 0.0


def _order_value(n: int, d: int, logs: float, powers: float, kind: str, order: float, k: int, base: float) -> float:
    """``powers`` is the sum of radii to the power of ``d * (1 - order)``."""
    volume, ln = unit_ball_volume(d, 2.0, 1.0), unit(base)
    if abs(order - 1) < 1e-12:
        return (d * logs + n * math.log((n - 1) * math.exp(-digamma_value(k)) * volume)) / (n * ln)
    if abs(order - (k + 1)) < 1e-12:
        return 0.0
    c = (math.gamma(k) / math.gamma(k + 1 - order)) ** (1 / (1 - order)) if math.gamma(k + 1 - order) > 0 else math.nan
    integral = ((n - 1) * c * volume) ** (1 - order) * powers / n
    if kind == "tsallis":
        return (integral - 1) / (1 - order)
    return math.log(integral) / ((1 - order) * ln) if integral > 0 else 0.0


def _order(x: np.ndarray, kind: str, order: float, k: int = 4, base: float = math.e) -> float:
    positive("order", order)
    n, d, _, logs, powers = _sums(x, _radii(x, k, 2.0), x.shape[1] * (1 - order))
    return _order_value(n, d, logs, powers, kind, order, k, base)


def _density(x: np.ndarray, kernel: str = "box", bandwidth: float = 1.0, base: float = math.e) -> float:
    n, d = x.shape
    step = _rows(n, d)
    if kernel == "gaussian":
        lower = np.linalg.cholesky(np.atleast_2d(np.cov(x.T)) * bandwidth**2)
        x = x @ np.linalg.inv(lower).T
        scale = 1.0 / (n * (2 * math.pi) ** (d / 2) * float(np.prod(np.diag(lower))))
    total = 0.0
    for a in range(0, n, step):
        if kernel == "box":
            near = (distances(x[a : a + step], x, math.inf) <= bandwidth / 2 + 1e-15).sum(axis=1) / (n * bandwidth**d)
        else:
            q = distances(x[a : a + step], x, 2.0) ** 2
            near = np.exp(-0.5 * q).sum(axis=1) * scale
        total -= float(np.log(near[near > 0]).sum())
    return total / n / unit(base)


def grouped_entropy(df: DataFrame, x: Variable, group_by: Sequence[str], approach: str, **params) -> DataFrame:
    """Entropy of each group with approach ``kernel``, ``kl``, ``renyi`` or ``tsallis``: ``group_by`` columns, ``value``, ``n``."""
    cols = variable(x)
    if approach not in ("kernel", "kl", "renyi", "tsallis"):
        raise NotImplementedError(f"no grouped entropy with approach {approach!r}")
    if approach == "kernel":
        kernel._checked(params.get("kernel", "box"), params.get("bandwidth", 1.0))
    solve: dict[str, Callable[[np.ndarray], float]] = {
        "kernel": lambda v: _density(v, **params),
        "kl": lambda v: _kl(v, **params),
        "renyi": lambda v: _order(v, "renyi", params["alpha"], **{k: p for k, p in params.items() if k != "alpha"}),
        "tsallis": lambda v: _order(v, "tsallis", params["q"], **{k: p for k, p in params.items() if k != "q"}),
    }
    one = solve[approach]
    groups = [f"_g{i}" for i in range(len(group_by))]
    slim = df.select(*[F.col(g).alias(n) for g, n in zip(group_by, groups, strict=True)], *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    slim = complete(slim, [f"_v{i}" for i in range(len(cols))])
    for i in range(len(cols)):
        slim = slim.where(~F.isnan(f"_v{i}"))
    if approach != "kernel" and len(cols) == 1:
        out = _in_order(slim, groups, approach, params)
        return out.select(*[F.col(n).alias(g) for g, n in zip(group_by, groups, strict=True)], "value", "n")
    large = slim.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > GROUP_POINTS)
    large = checkpointed(global_row_number(large, groups, "_no"))

    def same(left: DataFrame, right: DataFrame) -> Column:
        return functools.reduce(Column.__and__, [left[g].eqNullSafe(right[g]) for g in groups])

    def run(table: pa.Table) -> pa.Table:
        v = np.column_stack([table.column(f"_v{i}").to_numpy() for i in range(len(cols))])
        head = {g: table.column(g).slice(0, 1) for g in groups}
        return pa.table({**head, "value": pa.array([one(v)]), "n": pa.array([len(v)], pa.int64())})

    schema = ", ".join(f"{g} {slim.schema[g].dataType.simpleString()}" for g in groups)
    some = large.limit(1).count() > 0
    small = slim.join(large, same(slim, large), "left_anti") if some else slim
    out = small.groupBy(*groups).applyInArrow(run, f"{schema}, value double, n long")
    if some:
        inside = slim.join(large, same(slim, large)).select(F.col("_no").cast("double").alias("_g"), *[f"_v{i}" for i in range(len(cols))])
        done = _many(checkpointed(inside), len(cols), approach, params)
        out = out.unionByName(large.join(done, large["_no"] == F.col("_g")).select(*[large[g] for g in groups], "value", "n"))
    return out.select(*[F.col(n).alias(g) for g, n in zip(group_by, groups, strict=True)], "value", "n")


def _many(points_: DataFrame, dim: int, approach: str, params: dict) -> DataFrame:
    """Entropies of all groups of ``(_g, _v0, ...)`` at once: ``_g, value, n``. Groups lie further apart than any two points of one."""
    axes = [f"_v{i}" for i in range(dim)]
    base = params.get("base", math.e)
    if approach == "kernel" and params.get("kernel", "box") == "gaussian":
        points_, scales = _whitened(points_, axes, params.get("bandwidth", 1.0))
    reach = points_.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    apart = 4.0 * (1.0 + sum(reach[a] or 0.0 for a in axes)) + 64.0
    data = points(points_.withColumn("_far", F.col("_g") * apart), ["_far", *axes])
    group = F.round(F.col("_x")[0] / apart).alias("_g")
    rows = F.sum("_w").alias("n")
    if approach == "kernel":
        bandwidth, space = params.get("bandwidth", 1.0), list(range(dim + 1))
        if params.get("kernel", "box") == "box":
            found = kernel_sums(data, data, {"near": Kernel(space, math.inf, bandwidth / 2 + 1e-15)})
            sums = found.select(group, "_w", "near", F.lit(float(bandwidth) ** dim).alias("_volume"))
        else:
            found = kernel_sums(data, data, {"near": gaussian(space)})
            sums = found.select(group, "_w", "near").join(scales, "_g")
        total_ = sums.groupBy("_g").agg(rows)
        met = sums.join(total_, "_g").withColumn("_density", F.col("near") / (F.col("n") * F.col("_volume")))
        part = F.sum(F.when(F.col("_density") > 0, -F.col("_w") * F.log("_density")).otherwise(0.0))
        return met.groupBy("_g").agg((part / F.first("n") / unit(base)).alias("value"), F.first("n").alias("n"))
    p = knn.norm(params.get("metric", "chebyshev")) if approach == "kl" else 2.0
    return _from_radii(kth_distance(data, data, params.get("k", 4), p, True).select(group, "_w", "_rho"), ["_g"], dim, approach, params)


def _in_order(slim: DataFrame, groups: Sequence[str], approach: str, params: dict) -> DataFrame:
    """Nearest-neighbour entropies of groups of ``_v0``: a row's k nearest are a run of the k rows around it in order."""
    k = params.get("k", 4)
    ordered = Ordered(slim.select(*groups, "_v0"), ["_v0"], groups, k)
    below = [ordered.past("_v0", i) for i in range(k + 1)]
    above = [ordered.ahead("_v0", i) for i in range(k + 1)]
    runs = [
        F.when(below[i].isNotNull() & above[k - i].isNotNull(), F.greatest(F.col("_v0") - below[i], above[k - i] - F.col("_v0"))) for i in range(k + 1)
    ]  # i rows below and k - i above; null where the group ends before
    home = ["_home", "_block", "_rn"] if ordered.blocked else []
    found = ordered.done(ordered.frame.select(*groups, *home, F.array_min(F.array(*runs)).alias("_rho")))
    return _from_radii(found.withColumn("_w", F.lit(1).cast("long")), groups, 1, approach, params)


def _from_radii(found: DataFrame, groups: Sequence[str], dim: int, approach: str, params: dict) -> DataFrame:
    """Entropies from rows of ``groups``, ``_rho`` and ``_w``: ``groups, value, n``. A group with too few points for its k is an error."""
    k, base = params.get("k", 4), params.get("base", math.e)
    p = knn.norm(params.get("metric", "chebyshev")) if approach == "kl" else 2.0
    order = params.get("alpha", params.get("q", 1.0))
    if approach != "kl":
        positive("order", order)
    positive_ = F.col("_rho") > 0
    sums = found.groupBy(*groups).agg(
        F.sum("_w").alias("n"),
        F.max(F.col("_rho").isNull()).alias("short"),
        F.sum(F.when(positive_, F.col("_w")).otherwise(0)).alias("some"),
        F.sum(F.when(positive_, F.col("_w") * F.log("_rho")).otherwise(0.0)).alias("logs"),
        F.sum(F.when(positive_, F.col("_w") * F.pow("_rho", F.lit(dim * (1.0 - order)))).otherwise(0.0)).alias("powers"),
    )
    variant = params.get("variant", 1)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # one row a group
            rows_ = batch.to_pylist()
            for r in rows_:
                if r["short"] and not (approach == "kl" and r["n"] < 2):
                    raise ValueError(f"k = {k} needs more points than {r['n']}")
            if approach == "kl":
                value = [_kl_value(r["n"], dim, r["some"], r["logs"], k, p, variant, base) for r in rows_]
            else:
                value = [_order_value(r["n"], dim, r["logs"], r["powers"], approach, order, k, base) for r in rows_]
            kept = [batch.column(g) for g in groups]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(value, pa.float64()), batch.column("n")], names=[*groups, "value", "n"])

    schema = ", ".join(f"{g} {found.schema[g].dataType.simpleString()}" for g in groups)
    return sums.mapInArrow(solve, f"{schema}, value double, n long")


def _whitened(points_: DataFrame, axes: Sequence[str], bandwidth: float) -> tuple[DataFrame, DataFrame]:
    """Points mapped so that each group's kernel is the standard normal one, and the volume by which its sums are divided: ``_g, _volume``."""
    d = len(axes)
    means = [F.avg(a).alias(f"_m{i}") for i, a in enumerate(axes)]
    pairs = [F.covar_samp(axes[i], axes[j]).alias(f"_c{i}_{j}") for i in range(d) for j in range(i + 1)]
    names = ["_g", *[f"_i{i}_{j}" for i in range(d) for j in range(i + 1)], *[f"_m{i}" for i in range(d)], "_volume"]

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():  # one row a group
                cov = np.array([[r[f"_c{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)])
                lower = np.linalg.cholesky(cov * bandwidth**2)
                turn = np.linalg.inv(lower)
                volume = (2 * math.pi) ** (d / 2) * float(np.prod(np.diag(lower)))
                rows.append([r["_g"], *[float(turn[i, j]) for i in range(d) for j in range(i + 1)], *[r[f"_m{i}"] for i in range(d)], volume])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)], names=names)

    maps = checkpointed(points_.groupBy("_g").agg(*means, *pairs).mapInArrow(factor, ", ".join(f"{n} double" for n in names)))
    centred = [F.col(a) - F.col(f"_m{i}") for i, a in enumerate(axes)]
    turned = [functools.reduce(Column.__add__, [F.col(f"_i{i}_{j}") * centred[j] for j in range(i + 1)]).alias(a) for i, a in enumerate(axes)]
    return checkpointed(points_.join(maps, "_g").select("_g", *turned)), maps.select("_g", "_volume")
