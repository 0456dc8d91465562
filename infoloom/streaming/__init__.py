"""Measures over streams: counts are mergeable, and embeddings need only the last few values of a series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.discrete import Estimator, as_estimator, entropy_column


def windowed_entropy(stream: DataFrame, x: str, time_col: str, window: str, late: str, estimator: str | Estimator = "mle", group_by: Sequence[str] = ()) -> DataFrame:
    """Entropy of a column in each time window once the watermark has passed it: ``window``, groups, ``value``, ``n``.

    Two chained aggregations in append mode: symbol counts, then the histogram's sums. Estimators that
    need single counts beside the totals (shrink, bayes, chao_shen, nsb) are left to batch.
    """
    est = as_estimator(estimator)
    if est.name in ("shrink", "bayes", "chao_shen", "nsb"):
        raise NotImplementedError(f"{est.name} is not a sum over counts")
    from ..functions.special import digamma

    rows = stream.withWatermark(time_col, late).where(F.col(x).isNotNull())
    counts = rows.groupBy(F.window(time_col, window), *group_by, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    c = F.col("_c").cast("double")
    sign = F.when(F.col("_c") % 2 == 0, 1.0).otherwise(-1.0)
    sums = counts.groupBy("window", *group_by).agg(
        F.sum("_c").alias("_n"),
        F.count(F.lit(1)).alias("_k"),
        F.sum(F.when(F.col("_c") == 1, 1).otherwise(0)).alias("_f1"),
        F.sum(F.when(F.col("_c") == 2, 1).otherwise(0)).alias("_f2"),
        F.sum(c * F.log(c)).alias("_clogc"),
        F.sum(c * digamma(c)).alias("_cpsi"),
        F.sum(c * sign / (c + 1)).alias("_csign"),
        F.sum((c + 1) * digamma(c + 2)).alias("_bona"),
    )
    return sums.select("window", *group_by, entropy_column(est).alias("value"), F.col("_n").alias("n"))


def embed_stream(stream: DataFrame, series_col: str, value_col: str, time_col: str, delay: int) -> DataFrame:
    """For each value of a series, the one ``delay`` values before it: ``series, value, past``.

    The state of a series is its last ``delay`` values. Rows are taken in order of time within each micro-batch.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (series_col, value_col)}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(time_col, kind="stable")
        held = list(state.get[0]) if state.exists else []
        values = held + rows[value_col].tolist()
        made = [(key[0], values[i], values[i - delay]) for i in range(max(len(held), delay), len(values))]
        state.update((values[-delay:],))
        yield pd.DataFrame(made, columns=["series", "value", "past"])

    return stream.groupBy(series_col).applyInPandasWithState(
        step,
        f"series {kinds[series_col]}, value {kinds[value_col]}, past {kinds[value_col]}",
        f"held array<{kinds[value_col]}>",
        "append",
        "NoTimeout",
    )
