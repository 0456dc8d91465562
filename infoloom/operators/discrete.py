"""Discrete measures: entropies of count histograms with eleven estimators, and signed sums of them.

Every measure is a sum of entropies of column sets with signs. One pass counts the joint symbols, grouping sets roll the
counts up to the sets, and each histogram is reduced to its profile, how many symbols occur how often. A profile
has at most about ``sqrt(2 N)`` entries however many symbols there are, so what a closed formula still needs of single counts
fits in one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.validate import Variable, complete, narrowed, renamed, unit, variable
from ..functions.special import EULER, digamma
from . import nsb as _nsb

ESTIMATORS = ("mle", "miller_madow", "shrink", "grassberger", "zhang", "bayes", "bonachela", "chao_shen", "chao_wang_jost", "nsb", "ansb")
LOCAL = ("mle", "miller_madow", "shrink", "grassberger", "zhang")
CROSS = ("mle", "miller_madow", "bayes")
PRIORS = ("jeffrey", "laplace", "sch_grass", "min_max")

#: Estimators that callers have added: name to entropy in nats from the rows' number, the symbols' number and a sum over symbols.
ADDED: dict[str, Callable[[Column, Column, Callable[[Callable[[Column], Column]], Column]], Column]] = {}


def register_entropy(name: str, build: Callable[[Column, Column, Callable[[Callable[[Column], Column]], Column]], Column]) -> None:
    """Add an estimator for all discrete measures: ``build(n, k, total)`` gives an entropy in nats.

    ``n`` is the number of rows and ``k`` that of symbols; ``total(f)`` sums ``f(count)`` over the symbols. All are columns of doubles, so
    the estimator stays an expression of the plan. A name that is taken is an error.
    """
    if name in ESTIMATORS or name in ADDED:
        raise ValueError(f"there is an estimator {name!r} already")
    ADDED[name] = build


@dataclass(frozen=True)
class Estimator:
    """An estimator and its parameters.

    ``alpha`` is a prior weight or the name of a rule (``bayes``); ``k`` overrides the number of symbols
    (``bayes``, ``nsb``, ``ansb``).
    """

    name: str = "mle"
    alpha: float | str = "jeffrey"
    k: int | None = None

    def __post_init__(self) -> None:
        if self.name not in ESTIMATORS and self.name not in ADDED:
            raise ValueError(f"unknown estimator {self.name!r}; there are {', '.join([*ESTIMATORS, *ADDED])}")
        if isinstance(self.alpha, str) and self.alpha not in PRIORS:
            raise ValueError(f"unknown prior {self.alpha!r}; there are {', '.join(PRIORS)}")

    def kinds(self) -> Column:
        return F.lit(float(self.k)) if self.k is not None else F.col("_k").cast("double")

    def prior(self, kinds: Column, n: Column) -> Column:
        rules = {"jeffrey": F.lit(0.5), "laplace": F.lit(1.0), "sch_grass": 1.0 / kinds, "min_max": F.sqrt(n) / kinds}
        return rules[self.alpha] if isinstance(self.alpha, str) else F.lit(float(self.alpha))


def as_estimator(estimator: str | Estimator, alpha: float | str = "jeffrey", k: int | None = None) -> Estimator:
    return estimator if isinstance(estimator, Estimator) else Estimator(estimator, alpha, k)


def set_counts(df: DataFrame, groups: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Symbol counts of several column sets in one scan: groups, ``_set`` (its index) and ``_c``.

    The joint symbols are counted first, with partial sums, so a frequent symbol shrinks to one row a task before
    the shuffle and the sets are rolled up from counts.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    joint = df.groupBy(*groups, *columns).agg(F.count(F.lit(1)).alias("_c"))
    if len(sets) == 1 and len(sets[0]) == len(columns):
        return joint.select(*groups, F.lit(0).alias("_set"), "_c")
    keyed = [[*groups, *s] for s in sets]
    ids = {sum(1 << (len(groups) + len(columns) - 1 - i) for i, c in enumerate([*groups, *columns]) if c not in k): n for n, k in enumerate(keyed)}
    rolled = joint.groupingSets([[F.col(c) for c in k] for k in keyed], *groups, *columns).agg(F.sum("_c").alias("_c"), F.grouping_id().alias("_id"))
    number = F.coalesce(*[F.when(F.col("_id") == i, F.lit(n)) for i, n in ids.items()])
    return rolled.select(*groups, number.alias("_set"), "_c")


def profiles(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histograms reduced to totals: ``_n``, ``_k``, ``_f1``, ``_f2``, sums the estimators need, and the profile."""
    by_count = counts.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_m"))
    c, m = F.col("_c").cast("double"), F.col("_m").cast("double")
    sign = F.when(F.col("_c") % 2 == 0, 1.0).otherwise(-1.0)
    return by_count.groupBy(*keys).agg(
        F.sum(F.col("_c") * F.col("_m")).alias("_n"),
        F.sum("_m").alias("_k"),
        F.coalesce(F.sum(F.when(F.col("_c") == 1, F.col("_m"))), F.lit(0)).alias("_f1"),
        F.coalesce(F.sum(F.when(F.col("_c") == 2, F.col("_m"))), F.lit(0)).alias("_f2"),
        F.sum(m * c * F.log(c)).alias("_clogc"),
        F.sum(m * c * digamma(c)).alias("_cpsi"),
        F.sum(m * c * sign / (c + 1)).alias("_csign"),
        F.sum(m * (c + 1) * digamma(c + 2)).alias("_bona"),
        F.array_sort(F.collect_list(F.struct(c.alias("c"), m.alias("m")))).alias("_profile"),
    )


def _over(f) -> Column:
    """The sum over a profile of the multiplicity times ``f(count)``."""
    return F.aggregate("_profile", F.lit(0.0), lambda a, x: a + x["m"] * f(x["c"]))


def _neg_plogp(p: Column) -> Column:
    return F.when(p > 0, -p * F.log(p)).otherwise(0.0)


def _shrunk(n: Column, k: Column) -> Column:
    """The James-Stein weight of the uniform target."""
    spread = _over(lambda c: (c / n - 1.0 / k) * (c / n - 1.0 / k))
    varied = _over(lambda c: c / n * (1.0 - c / n)) / (n - 1)
    return F.when((n <= 1) | (spread == 0), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), varied / spread)))


def _unseen_tail(a: Column, n: Column) -> Column:
    """``sum over j >= 0 of (1 - a)**(1 + j) / (n + j)``, the stable form of the coverage correction.

    It is an integral over a half-line; after two substitutions the integrand falls off on either side so fast that
    the trapezoidal rule is exact to rounding, at one cost for any ``n`` and ``a``.
    """
    h, low, high = 0.1, -900, 45
    points = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: i * h)

    def term(x: Column) -> Column:
        v = F.exp(x)
        return F.exp(x - v) / (a - (1.0 - a) * F.expm1(-v / n))

    return (1.0 - a) / n * h * F.aggregate(points, F.lit(0.0), lambda s, x: s + term(x))


def entropy_column(est: Estimator) -> Column:
    """Entropy in nats from the columns of :func:`profiles`."""
    n, k = F.col("_n").cast("double"), F.col("_k").cast("double")
    if est.name in ADDED:
        return ADDED[est.name](n, k, _over)
    mle = F.log(n) - F.col("_clogc") / n
    zhang = digamma(n) - F.col("_cpsi") / n
    if est.name == "mle":
        return mle
    if est.name == "miller_madow":
        return mle + (k - 1) / (2 * n)
    if est.name == "shrink":
        weight = F.col("_shrunk")
        return _over(lambda c: _neg_plogp(weight / k + (1.0 - weight) * c / n))
    if est.name == "grassberger":
        return F.log(n) - (F.col("_cpsi") + F.col("_csign")) / n
    if est.name == "zhang":
        return zhang
    if est.name == "bayes":
        kinds = est.kinds()
        alpha = est.prior(kinds, n)
        return _over(lambda c: _neg_plogp((c + alpha) / (n + kinds * alpha)))
    if est.name == "bonachela":
        return (digamma(n + 3) * (n + k) - F.col("_bona")) / (n + 2)
    if est.name == "chao_shen":
        f1 = F.when(F.col("_f1") == F.col("_n"), n - 1).otherwise(F.col("_f1").cast("double"))
        cover = 1.0 - f1 / n

        def term(c: Column) -> Column:
            pa = cover * c / n
            la = 1.0 - F.pow(1.0 - pa, n)
            return F.when((pa > 0) & (la > 0), -pa * F.log(pa) / la).otherwise(0.0)

        return _over(term)
    if est.name == "chao_wang_jost":
        f1, f2 = F.col("_f1").cast("double"), F.col("_f2").cast("double")
        a = F.when(f2 > 0, 2 * f2 / ((n - 1) * f1 + 2 * f2)).when(f1 > 0, 2.0 / ((n - 1) * (f1 - 1) + 2)).otherwise(1.0)
        return zhang + F.when((a != 1.0) & (f1 > 0), f1 / n * _unseen_tail(a, n)).otherwise(0.0)
    if est.name == "ansb":
        free = n - est.kinds()
        return F.when(free > 0, (EULER - math.log(2)) + 2 * F.log(n) - digamma(F.greatest(free, F.lit(1e-300)))).otherwise(F.lit(float("nan")))
    return _nsb.nsb_entropy("_profile", est.k)


def _entropies(df: DataFrame, groups: Sequence[str], sets: Sequence[Sequence[str]], est: Estimator) -> DataFrame:
    """Entropy of each set: groups, ``_set``, ``_h``, ``_n``, ``_k``."""
    rows = profiles(set_counts(df, groups, sets), [*groups, "_set"])
    if est.name == "shrink":
        rows = rows.withColumn("_shrunk", _shrunk(F.col("_n").cast("double"), F.col("_k").cast("double")))
    return rows.select(*groups, "_set", entropy_column(est).alias("_h"), "_n", "_k")


def _empty_value(est: Estimator) -> float:
    return float("nan") if est.name in ("miller_madow", "nsb", "ansb") else 0.0


def signed_entropy(
    df: DataFrame, terms: Mapping[tuple[str, ...], float], group_by: Sequence[str] = (), estimator: str | Estimator = "mle", base: float = math.e
) -> DataFrame:
    """``sum of weight * H(columns)`` per group: ``group_by`` columns, ``value``, ``n``.

    Rows with a null in a column of the measure are left out; an ungrouped empty input gives one row.
    """
    est, ln = as_estimator(estimator), unit(base)
    weights: dict[frozenset[str], float] = {}
    for cols, w in terms.items():
        weights[frozenset(cols)] = weights.get(frozenset(cols), 0.0) + w
    slim, groups, names = narrowed(df, group_by, [c for cols in terms for c in cols])
    sets = [sorted(names[c] for c in s) for s in weights]
    rows = _entropies(slim, groups, sets, est)
    value = F.sum(F.element_at(F.array(*[F.lit(float(w)) for w in weights.values()]), F.col("_set") + 1) * F.col("_h"))
    out = rows.groupBy(*groups).agg(value.alias("value"), F.max("_n").alias("n"))
    if not groups:
        out = out.select(F.when(F.col("n").isNull(), F.lit(_empty_value(est))).otherwise(F.col("value")).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))
    return renamed(out, group_by, groups, (F.col("value") / ln).alias("value"), F.col("n").cast("long").alias("n"))


def entropy(df: DataFrame, x: Variable, group_by: Sequence[str] = (), estimator: str | Estimator = "mle", base: float = math.e) -> DataFrame:
    """Entropy of a variable; of several columns, their joint entropy."""
    return signed_entropy(df, {variable(x): 1.0}, group_by, estimator, base)


def conditional_entropy(df: DataFrame, x: Variable, given: Variable, group_by: Sequence[str] = (), estimator: str | Estimator = "mle", base: float = math.e) -> DataFrame:
    """``H(X | Y) = H(X, Y) - H(Y)``."""
    x, given = variable(x), variable(given)
    return signed_entropy(df, _added([(x + given, 1.0), (given, -1.0)]), group_by, estimator, base)


def _added(pairs: Sequence[tuple[tuple[str, ...], float]]) -> dict[tuple[str, ...], float]:
    out: dict[tuple[str, ...], float] = {}
    for cols, w in pairs:
        key = tuple(sorted(set(cols)))
        out[key] = out.get(key, 0.0) + w
    return out


def mi_terms(variables: Sequence[Variable]) -> dict[tuple[str, ...], float]:
    """``sum of H(X_i) - H(X_1 .. X_n)``."""
    vs = [variable(v) for v in variables]
    return _added([(v, 1.0) for v in vs] + [(sum(vs, ()), -1.0)])


def cmi_terms(variables: Sequence[Variable], given: Variable) -> dict[tuple[str, ...], float]:
    """``sum of H(X_i, Z) - H(X_1 .. X_n, Z) - (n - 1) H(Z)``."""
    vs, z = [variable(v) for v in variables], variable(given)
    return _added([(v + z, 1.0) for v in vs] + [(sum(vs, ()) + z, -1.0), (z, -(len(vs) - 1.0))])


def mutual_information(df: DataFrame, variables: Sequence[Variable], group_by: Sequence[str] = (), estimator: str | Estimator = "mle", base: float = math.e) -> DataFrame:
    """Mutual information of one or more variables; not clamped, so corrected estimates may be negative."""
    return signed_entropy(df, mi_terms(variables), group_by, estimator, base)


def conditional_mutual_information(
    df: DataFrame, variables: Sequence[Variable], given: Variable, group_by: Sequence[str] = (), estimator: str | Estimator = "mle", base: float = math.e
) -> DataFrame:
    """Mutual information of the variables given another."""
    return signed_entropy(df, cmi_terms(variables, given), group_by, estimator, base)


def local_terms(
    df: DataFrame, terms: Mapping[tuple[str, ...], float], group_by: Sequence[str] = (), estimator: str | Estimator = "mle", base: float = math.e, out: str = "local_value"
) -> DataFrame:
    """Per-row values of a signed sum of entropies: the rows of ``df`` that take part, with column ``out``.

    Each set's symbols are counted and weighed once and joined back by symbol, a join that
    Spark can broadcast or split. Rows with a null in a column of the measure are left out.
    """
    est, ln = as_estimator(estimator), unit(base)
    if est.name not in LOCAL:
        raise NotImplementedError(f"{est.name} has no local values")
    columns = list(dict.fromkeys(c for cols in terms for c in cols))
    rows = complete(df, columns)
    rows = rows.select("*", *[F.col(c).alias(f"_s{i}") for i, c in enumerate(columns)], *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_by)])
    rows = rows.withColumn("_local", F.lit(0.0))
    names = {c: f"_s{i}" for i, c in enumerate(columns)}
    groups = [f"_g{i}" for i in range(len(group_by))]
    for cols, w in terms.items():
        if not w:
            continue
        keys = sorted({names[c] for c in cols})
        counts = rows.groupBy(*groups, *keys).agg(F.count(F.lit(1)).alias("_c"))
        whole = profiles(counts, groups)
        if est.name == "shrink":
            whole = whole.withColumn("_shrunk", _shrunk(F.col("_n").cast("double"), F.col("_k").cast("double")))
        whole = whole.drop("_profile", "_clogc", "_cpsi", "_csign", "_bona", "_f1", "_f2")
        met = counts.join(_matchable(whole, groups), _same(counts, groups, "_m_")) if groups else counts.join(F.broadcast(whole))  # one row
        n, k, c = F.col("_n").cast("double"), F.col("_k").cast("double"), F.col("_c").cast("double")
        h = {
            "mle": lambda: -F.log(c / n),
            "miller_madow": lambda: -F.log(c / n) + (k - 1) / (2 * n),
            "shrink": lambda: -F.log(F.col("_shrunk") / k + (1.0 - F.col("_shrunk")) * c / n),
            "grassberger": lambda: F.log(n) - digamma(c) - F.when(F.col("_c") % 2 == 0, 1.0).otherwise(-1.0) / (c + 1),
            "zhang": lambda: digamma(n) - digamma(c),
        }[est.name]()
        term = met.select(*[F.col(g).alias(f"_t_{g}") for g in groups], *[F.col(s).alias(f"_t_{s}") for s in keys], (h * w).alias("_t"))
        rows = rows.join(term, _same(rows, [*groups, *keys], "_t_")).withColumn("_local", F.col("_local") + F.col("_t"))
        rows = rows.drop("_t", *[f"_t_{x}" for x in [*groups, *keys]])
    return rows.withColumn(out, F.col("_local") / ln).drop("_local", *names.values(), *groups)


def _matchable(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({g: f"_m_{g}" for g in groups})


def _same(left: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        match = left[k].eqNullSafe(F.col(prefix + k)) if k.startswith("_g") else left[k] == F.col(prefix + k)
        out = match if k == keys[0] else out & match
    return out


def _distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    slim, _, names = narrowed(df, (), cols)
    return slim.groupBy(*names.values()).agg(F.count(F.lit(1)).alias("_c"))


def cross_entropy(p: DataFrame, q: DataFrame, x: Variable, estimator: str | Estimator = "mle", base: float = math.e) -> DataFrame:
    """``H_Q(P)`` over the symbols that both samples have; disjoint ones give 0, never infinity. One row: ``value``."""
    est, ln = as_estimator(estimator), unit(base)
    if est.name not in CROSS:
        raise NotImplementedError(f"{est.name} has no cross-entropy")
    cols = variable(x)
    a, b = _distribution(p, cols), _distribution(q, cols)
    totals = [d.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("double").alias(f"_n{t}"), F.count(F.lit(1)).cast("double").alias(f"_k{t}")) for t, d in (("p", a), ("q", b))]
    both = a.withColumnRenamed("_c", "_cp").join(b.withColumnRenamed("_c", "_cq"), [f"_s{i}" for i in range(len(dict.fromkeys(cols)))])
    both = both.join(F.broadcast(totals[0])).join(F.broadcast(totals[1]))  # one row each
    if est.name == "bayes":

        def prob(c: str, t: str) -> Column:
            kinds = F.lit(float(est.k)) if est.k is not None else F.col(f"_k{t}")
            alpha = est.prior(kinds, F.col(f"_n{t}"))
            return (F.col(c) + alpha) / (F.col(f"_n{t}") + kinds * alpha)

        pp, pq = prob("_cp", "p"), prob("_cq", "q")
    else:
        pp, pq = F.col("_cp") / F.col("_np"), F.col("_cq") / F.col("_nq")
    fix = ((F.first("_kp") + F.first("_kq")) / 2 - 1) / (F.first("_np") + F.first("_nq")) if est.name == "miller_madow" else F.lit(0.0)
    return both.agg((F.coalesce(F.sum(-pp * F.log(pq)) + fix, F.lit(0.0)) / ln).alias("value"))


def kl_divergence(p: DataFrame, q: DataFrame, x: Variable, estimator: str | Estimator = "mle", base: float = math.e) -> DataFrame:
    """``H_Q(P) - H(P)``, as one row ``value``."""
    h = entropy(p, x, (), estimator, base).select(F.col("value").alias("_h"))
    return cross_entropy(p, q, x, estimator, base).join(F.broadcast(h)).select((F.col("value") - F.col("_h")).alias("value"))


def js_divergence(samples: Sequence[DataFrame], x: Variable, estimator: str | Estimator = "mle", base: float = math.e) -> DataFrame:
    """Entropy of the equal-weight mixture less the mean of the samples' entropies, as one row ``value``.

    The mixture weighs samples alike whatever their sizes, so it is formed from probabilities and uses plug-in entropy; the
    samples' own entropies use the estimator.
    """
    cols, ln = variable(x), unit(base)
    if not samples:
        raise ValueError("a divergence needs samples")
    parts = []
    for d in samples:
        counts = _distribution(d, cols)
        n = counts.agg(F.sum("_c").cast("double").alias("_n"))
        parts.append(counts.join(F.broadcast(n)).withColumn("_p", F.col("_c") / F.col("_n") / len(samples)).drop("_c", "_n"))
    mixed = parts[0]
    for part in parts[1:]:
        mixed = mixed.unionByName(part)
    whole = mixed.groupBy(*[c for c in mixed.columns if c != "_p"]).agg(F.sum("_p").alias("_p"))
    out = whole.agg((F.sum(_neg_plogp(F.col("_p"))) / ln).alias("value"))
    for i, d in enumerate(samples):
        h = entropy(d, x, (), estimator, base).select((F.col("value") / len(samples)).alias(f"_h{i}"))
        out = out.join(F.broadcast(h)).select((F.col("value") - F.col(f"_h{i}")).alias("value"))
    return out
