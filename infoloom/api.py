"""The measures by name: one function each, whatever the approach.

Approaches are ``discrete``, ``ordinal``, ``kernel``, ``kl``, ``renyi``, ``tsallis`` and, for information, ``ksg``.
Further keywords go to the approach's operators. Results are frames: one row (a group) with ``value`` and ``n``, or
for the ``local_`` functions a row for each sample with ``local_value``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

from .core.validate import Variable, variable
from .operators import discrete, kernel, knn
from .operators.grouped import grouped_entropy
from .operators.ordinal import symbolize
from .plans.series import embedded

SIGNED = ("kl", "renyi", "tsallis")


def _unknown(approach: str, measure: str) -> NotImplementedError:
    return NotImplementedError(f"{measure} has no approach {approach!r}")


def _patterns(df: DataFrame, variables: Sequence[Variable], params: dict, keep: Sequence[str] = ()) -> tuple[DataFrame, list[tuple[str, ...]], dict]:
    """The frame with ordinal patterns in place of series, and the parameters that remain."""
    own = {k: params.pop(k) for k in ("order", "order_by", "series_by", "delay", "tie_mode", "blocked") if k in params}
    cols = list(dict.fromkeys(c for v in variables for c in variable(v)))
    frame = symbolize(df, cols, own.pop("order", 3), own.pop("order_by"), keep=keep, **own)
    return frame, [tuple(f"{c}_pattern" for c in variable(v)) for v in variables], params


def entropy(df: DataFrame, x: Variable, approach: str = "discrete", **params) -> DataFrame:
    """Entropy of a variable; of several columns, their joint entropy."""
    if approach == "discrete":
        return discrete.entropy(df, x, **params)
    if approach == "ordinal":
        frame, (p,), rest = _patterns(df, [x], params, params.get("group_by", ()))
        return discrete.entropy(frame, p, **rest)
    if params.get("group_by"):
        return grouped_entropy(df, x, params.pop("group_by"), approach, **params)
    if approach == "kernel":
        return kernel.entropy(df, x, **params)
    if approach in SIGNED:
        return {"kl": knn.kl_entropy, "renyi": knn.renyi_entropy, "tsallis": knn.tsallis_entropy}[approach](df, x, **params)
    raise _unknown(approach, "entropy")


joint_entropy = entropy


def local_entropy(df: DataFrame, x: Variable, approach: str = "discrete", **params) -> DataFrame:
    if approach == "discrete":
        return discrete.local_terms(df, {variable(x): 1.0}, **params)
    if approach == "ordinal":
        frame, (p,), rest = _patterns(df, [x], params, params.get("group_by", ()))
        return discrete.local_terms(frame, {p: 1.0}, **rest)
    if approach == "kernel":
        return kernel.local_entropy(df, x, **params)
    if approach == "kl":
        return knn.kl_local_entropy(df, x, **params)
    raise _unknown(approach, "local entropy")


def conditional_entropy(df: DataFrame, x: Variable, given: Variable, approach: str = "discrete", **params) -> DataFrame:
    """``H(X, Y) - H(Y)``."""
    if approach == "discrete":
        return discrete.conditional_entropy(df, x, given, **params)
    if approach == "ordinal":
        frame, (p, q), rest = _patterns(df, [x, given], params, params.get("group_by", ()))
        return discrete.conditional_entropy(frame, p, q, **rest)
    if approach in SIGNED:
        return knn.signed_sum(df, {variable(x) + variable(given): 1.0, variable(given): -1.0}, approach, **params)
    if approach == "kernel":
        both, own = kernel.entropy(df, variable(x) + variable(given), **params), kernel.entropy(df, given, **params)
        return both.crossJoin(own.selectExpr("value as _v")).selectExpr("value - _v as value", "n")  # one row each
    raise _unknown(approach, "conditional entropy")


def cross_entropy(p: DataFrame, other: DataFrame, x: Variable, approach: str = "discrete", **params) -> DataFrame:
    """Entropy of P's sample under the distribution estimated from the other one."""
    if approach == "discrete":
        return discrete.cross_entropy(p, other, x, **params)
    if approach == "ordinal":
        a, (pattern,), rest = _patterns(p, [x], dict(params))
        b, _, _ = _patterns(other, [x], dict(params))
        return discrete.cross_entropy(a, b, pattern, **rest)
    if approach == "kernel":
        return kernel.cross_entropy(p, other, x, **params)
    if approach == "kl":
        return knn.kl_cross_entropy(p, other, x, **params)
    if approach == "renyi":
        return knn.renyi_cross_entropy(p, other, x, **params)
    if approach == "tsallis":
        return knn.tsallis_cross_entropy(p, other, x, **params)
    raise _unknown(approach, "cross-entropy")


def kl_divergence(p: DataFrame, other: DataFrame, x: Variable, approach: str = "discrete", **params) -> DataFrame:
    """``H_Q(P) - H(P)``."""
    if approach == "discrete":
        return discrete.kl_divergence(p, other, x, **params)
    cross, own = cross_entropy(p, other, x, approach, **dict(params)), entropy(p, x, approach, **dict(params))
    return cross.select("value").crossJoin(own.selectExpr("value as _v")).selectExpr("value - _v as value")  # one row each


def js_divergence(samples: Sequence[DataFrame], x: Variable, approach: str = "discrete", **params) -> DataFrame:
    """Entropy of the equal-weight mixture less the samples' mean entropy."""
    if approach == "discrete":
        return discrete.js_divergence(samples, x, **params)
    if approach == "ordinal":
        made = [_patterns(d, [x], dict(params)) for d in samples]
        return discrete.js_divergence([m[0] for m in made], made[0][1][0], **made[0][2])
    raise _unknown(approach, "Jensen-Shannon divergence")


def mutual_information(df: DataFrame, variables: Sequence[Variable], approach: str = "discrete", **params) -> DataFrame:
    if approach == "discrete":
        return discrete.mutual_information(df, variables, **params)
    if approach == "ordinal":
        frame, patterns, rest = _patterns(df, variables, params, params.get("group_by", ()))
        return discrete.mutual_information(frame, patterns, **rest)
    if approach == "kernel":
        return kernel.mutual_information(df, variables, **params)
    if approach == "ksg":
        return knn.ksg(df, variables, **params)
    if approach in SIGNED:
        return knn.signed_sum(df, discrete.mi_terms(variables), approach, **params)
    raise _unknown(approach, "mutual information")


def local_mutual_information(df: DataFrame, variables: Sequence[Variable], approach: str = "discrete", **params) -> DataFrame:
    if approach == "discrete":
        return discrete.local_terms(df, discrete.mi_terms(variables), **params)
    if approach == "ordinal":
        frame, patterns, rest = _patterns(df, variables, params, params.get("group_by", ()))
        return discrete.local_terms(frame, discrete.mi_terms(patterns), **rest)
    if approach == "kernel":
        return kernel.local_mutual_information(df, variables, **params)
    if approach == "ksg":
        return knn.ksg_local(df, variables, **params)
    raise _unknown(approach, "local mutual information")


def conditional_mutual_information(df: DataFrame, variables: Sequence[Variable], given: Variable, approach: str = "discrete", local: bool = False, **params) -> DataFrame:
    """Mutual information of variables given another; with ``local``, its terms for each sample."""
    if approach == "ordinal":
        frame, patterns, params = _patterns(df, [*variables, given], params, params.get("group_by", ()))
        return conditional_mutual_information(frame, patterns[:-1], patterns[-1], "discrete", local, **params)
    if approach == "discrete":
        if local:
            return discrete.local_terms(df, discrete.cmi_terms(variables, given), **params)
        return discrete.conditional_mutual_information(df, variables, given, **params)
    if approach == "kernel":
        x, y = variables
        return (kernel.local_conditional_mutual_information if local else kernel.conditional_mutual_information)(df, x, y, given, **params)
    if approach == "ksg":
        return (knn.ksg_local if local else knn.ksg)(df, variables, given, **params)
    if approach in SIGNED and not local:
        return knn.signed_sum(df, discrete.cmi_terms(variables, given), approach, **params)
    raise _unknown(approach, "conditional mutual information")


def transfer_entropy(
    df: DataFrame,
    source: Variable,
    dest: Variable,
    order_by: Sequence[str],
    series_by: Sequence[str] = (),
    src_hist: int = 1,
    dest_hist: int = 1,
    step: int = 1,
    approach: str = "discrete",
    local: bool = False,
    blocked: bool | None = None,
    cond: Variable | None = None,
    cond_hist: int = 1,
    **params,
) -> DataFrame:
    """What the source's past tells of the destination's future beyond the destination's own past (and, with ``cond``, that of a third).

    Pasts are ``step`` rows apart and so are the futures. With the ordinal approach, ``order`` and ``delay``
    (``step`` by default) make the patterns first. Several series (``series_by``) are pooled; with ``group_by`` each group has its own value.
    """
    if approach == "ordinal":
        own = {"order": params.pop("order", 3), "delay": params.pop("delay", step), "tie_mode": params.pop("tie_mode", "stable")}
        parts = [source, dest, *([cond] if cond is not None else [])]
        cols = list(dict.fromkeys(c for v in parts for c in variable(v)))
        df = symbolize(df, cols, own["order"], order_by, series_by, own["delay"], own["tie_mode"], blocked, params.get("group_by", ()))
        source, dest, cond = (None if v is None else tuple(f"{c}_pattern" for c in variable(v)) for v in (source, dest, cond))
        approach = "discrete"
    noise = params.pop("noise", 0.0) if approach in SIGNED else 0.0
    if noise:
        df = knn.noisy(df, list(dict.fromkeys([*variable(source), *variable(dest), *(variable(cond) if cond is not None else ())])), noise, params.get("seed", 0))
    wanted: dict[str, tuple[Variable, int]] = {"src": (source, src_hist), "dst": (dest, dest_hist)}
    if cond is not None:
        wanted["cond"] = (cond, cond_hist)
    frame, names = embedded(df, wanted, dest, order_by, series_by, step, blocked, params.get("group_by", ()))
    given = names["dst"] + names.get("cond", ())
    return conditional_mutual_information(frame, [names["src"], names["future"]], given, approach, local, **params)


def conditional_transfer_entropy(df: DataFrame, source: Variable, dest: Variable, cond: Variable, order_by: Sequence[str], **params) -> DataFrame:
    """:func:`transfer_entropy` given the past of a third variable too."""
    return transfer_entropy(df, source, dest, order_by, cond=cond, **params)


def in_bits(df: DataFrame) -> DataFrame:
    """A result in nats as bits."""
    return df.withColumn("value", df["value"] / math.log(2))
