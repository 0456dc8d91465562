"""Ordinal patterns: windows of a series reduced to the order of their values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.validate import at_least, complete
from ..plans.series import Ordered


def lehmer_code(perm: Column, order: int) -> Column:
    """Rank of a permutation array among all of its length."""
    code = F.lit(0).cast("long")
    for i in range(order - 1):
        larger = sum((F.when(perm[i] > perm[j], 1).otherwise(0) for j in range(i + 1, order)), F.lit(0))
        code = code + larger.cast("long") * math.factorial(order - 1 - i)
    return code


def argsort(values: Sequence[Column]) -> Column:
    """Positions of values in rising order; equal values keep theirs, NaN comes last."""
    pairs = F.array(*[F.struct(v.cast("double").alias("v"), F.lit(i).alias("i")) for i, v in enumerate(values)])
    return F.transform(F.array_sort(pairs), lambda x: x["i"])


def _strict3(a: Column, b: Column, c: Column) -> Column:
    """Order-3 patterns by strict comparisons, by which a tie counts as a fall."""
    up1, up2, up3 = a < b, b < c, a < c
    return (
        F.when(up1 & up2, F.lit(0))
        .when(up1 & up3, F.lit(1))
        .when(up1, F.lit(3))
        .when(up2 & up3, F.lit(2))
        .when(up2, F.lit(4))
        .otherwise(F.lit(5))
        .cast("long")
    )


def symbolize(
    df: DataFrame,
    columns: Sequence[str],
    order: int,
    order_by: Sequence[str],
    series_by: Sequence[str] = (),
    delay: int = 1,
    tie_mode: str = "stable",
    blocked: bool | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Series and order columns and, for each column, ``<column>_pattern``: the pattern of the window that starts at the row.

    A window is ``order`` values, ``delay`` rows apart. Rows with a null go before windows are
    formed; rows too near the end of their series have no window and are left out. ``tie_mode`` "strict3" compares strictly at order 3 and delay 1.
    """
    at_least("order", order, 1)
    at_least("delay", delay, 1)
    if order > 20:
        raise ValueError("order must be 20 at most: larger codes overflow")
    if tie_mode not in ("stable", "strict3"):
        raise ValueError(f"unknown tie_mode {tie_mode!r}")
    reach = (order - 1) * delay
    own = list(dict.fromkeys([*series_by, *order_by, *keep]))
    rows = Ordered(complete(df.select(*dict.fromkeys([*own, *columns])), columns), order_by, series_by, reach, blocked)
    leads = [rows.ahead(c, j * delay).alias(f"_w{i}_{j}") for i, c in enumerate(columns) for j in range(order)]
    last = rows.ahead("_t", reach).alias("_last")
    home = ["_home", "_block", "_rn"] if rows.blocked else []
    wide = rows.done(rows.frame.select(*own, *home, last, *leads)).where(F.col("_last").isNotNull())
    codes = []
    for i, c in enumerate(columns):
        values = [F.col(f"_w{i}_{j}") for j in range(order)]
        if tie_mode == "strict3" and order == 3 and delay == 1:
            codes.append(_strict3(*values).alias(f"{c}_pattern"))
        else:
            wide = wide.withColumn(f"_p{i}", argsort(values))
            codes.append(lehmer_code(F.col(f"_p{i}"), order).alias(f"{c}_pattern"))
    return wide.select(*own, *codes)
