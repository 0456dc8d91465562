"""Argument checks and the shared conventions for columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Variable = str | Sequence[str]


def variable(v: Variable) -> tuple[str, ...]:
    """A variable as the columns that make it up."""
    cols = (v,) if isinstance(v, str) else tuple(v)
    if not cols:
        raise ValueError("a variable needs a column")
    return cols


def positive(name: str, value: float) -> None:
    if not value > 0:
        raise ValueError(f"{name} must be positive, not {value!r}")


def at_least(name: str, value: int, least: int) -> None:
    if int(value) != value or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}, not {value!r}")


def unit(base: float) -> float:
    """The natural logarithm of the base that results are given in."""
    positive("base", base)
    if base == 1:
        raise ValueError("base must not be 1")
    return math.log(base)


def narrowed(df: DataFrame, group_by: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The group and variable columns under internal names, without rows that lack a variable.

    Internal names keep columns of the caller with any name from clashing with those of the plans.
    """
    groups = [f"_g{i}" for i in range(len(group_by))]
    names = {c: f"_s{i}" for i, c in enumerate(dict.fromkeys(columns))}
    out = df.select(*[F.col(_quoted(g)).alias(n) for g, n in zip(group_by, groups, strict=True)], *[F.col(_quoted(c)).alias(n) for c, n in names.items()])
    return complete(out, list(names.values())), groups, names


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in the columns; NaN is a value like any other here."""
    for c in columns:
        df = df.where(F.col(_quoted(c)).isNotNull())
    return df


def _quoted(name: str) -> str:
    return name if "." in name or name.startswith("`") else f"`{name}`"


def renamed(df: DataFrame, group_by: Sequence[str], groups: Sequence[str], *rest: Column | str) -> DataFrame:
    return df.select(*[F.col(n).alias(g) for g, n in zip(group_by, groups, strict=True)], *rest)
