"""Effective transfer entropy and permutation tests: the measure on embedded rows with shuffled source pasts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.validate import Variable, at_least
from .series import checkpointed, embedded, shuffled_pasts


def surrogate_values(
    df: DataFrame, source: Variable, dest: Variable, order_by: Sequence[str], series_by: Sequence[str] = (), rounds: int = 20, seed: int = 0,
    src_hist: int = 1, dest_hist: int = 1, step: int = 1, approach: str = "discrete", key: Sequence[str] | None = None, **params,
) -> tuple[DataFrame, DataFrame]:
    """The transfer entropy as observed, and one for each of ``rounds`` shuffles of whole source pasts: ``round, value``.

    ``key`` names the columns of ``order_by`` (all by default) that tell rows apart and so settle their places in a shuffle. With the discrete approach all rounds
    are one frame and one measure with a group a round.
    """
    from ..api import conditional_mutual_information

    at_least("rounds", rounds, 1)
    frame, names = embedded(df, {"src": (source, src_hist), "dst": (dest, dest_hist)}, dest, order_by, series_by, step)
    frame = checkpointed(frame)
    seen = conditional_mutual_information(frame, [names["src"], names["future"]], names["dst"], approach, **params)
    dealt = shuffled_pasts(frame, names["src"], order_by, series_by, rounds, seed, key or order_by)
    if approach == "discrete":
        return seen, conditional_mutual_information(dealt, [names["src"], names["future"]], names["dst"], approach, group_by=["round"], **params).select("round", "value")
    dealt = checkpointed(dealt)
    out = None
    for r in range(rounds):  # a parameter, not a property of the data
        one = conditional_mutual_information(dealt.where(F.col("round") == r), [names["src"], names["future"]], names["dst"], approach, **params)
        one = one.select(F.lit(r).alias("round"), "value")
        out = one if out is None else out.unionByName(one)
    return seen, out


def effective_transfer_entropy(df: DataFrame, source: Variable, dest: Variable, order_by: Sequence[str], digits: int | None = None, **params) -> DataFrame:
    """The transfer entropy less its mean over shuffles, with the shuffles' spread and a one-sided p-value, rounded to ``digits`` if given."""
    seen, surrogate = surrogate_values(df, source, dest, order_by, **params)
    mixed = surrogate.crossJoin(seen.select(F.col("value").alias("_seen"), "n"))  # one row against one for each round
    out = mixed.agg(
        (F.first("_seen") - F.avg("value")).alias("value"),
        F.first("_seen").alias("observed"),
        F.avg("value").alias("surrogate_mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(math.nan)).alias("surrogate_sd"),
        ((F.sum(F.when(F.col("value") >= F.col("_seen"), 1).otherwise(0)) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
        F.first("n").alias("n"),
    )
    if digits is None:
        return out
    return out.select(*[(F.round(c, digits) + 0.0).alias(c) for c in out.columns if c != "n"], "n")
