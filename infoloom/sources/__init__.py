"""Ways into and out of sample frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, kind: str = "parquet", columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    """Samples in any format that Spark reads; only the named columns are scanned."""
    df = spark.read.options(**options).format(kind).load(path)
    return df.select(*columns) if columns else df


def from_arrays(spark: SparkSession, **series: Sequence) -> DataFrame:
    """Series of equal length as columns, with their index ``t``."""
    lengths = {len(s) for s in series.values()}
    if len(lengths) > 1:
        raise ValueError("series must have equal lengths")
    rows = [(t, *(v.item() if hasattr(v, "item") else v for v in values)) for t, values in enumerate(zip(*series.values(), strict=True))]
    if not rows:
        raise ValueError("series are empty; give a frame with a schema instead")
    return spark.createDataFrame(rows, ["t", *series])


def from_rows(df: DataFrame, array_col: str, key: str = "batch", value: str = "x") -> DataFrame:
    """A column of arrays, each a dataset of its own, as a long table: ``key``, ``t``, ``value``."""
    return df.withColumn(key, F.monotonically_increasing_id()).select(key, F.posexplode(array_col).alias("t", value))


def from_vectors(df: DataFrame, vector_col: str, dims: int, prefix: str = "x") -> DataFrame:
    """The first components of a column of vectors as double columns."""
    return df.select("*", *[F.col(vector_col)[i].cast("double").alias(f"{prefix}{i}") for i in range(dims)])


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", options: Mapping[str, str] | None = None) -> None:
    """A result in any format that Spark writes."""
    df.write.options(**(options or {})).format(kind).mode(mode).save(path)
