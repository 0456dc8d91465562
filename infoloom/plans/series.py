"""Time-series embedding: past and future columns of ordered rows."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core.validate import Variable, at_least, variable

#: Rows of one series that a task embeds at most, when series are cut into blocks.
BLOCK_ROWS = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that ``spark.checkpoint.dir`` names; one of our own only in one process, where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="infoloom-ckpt-"))
    return df.checkpoint(eager=True)


def global_row_number(df: DataFrame, order_by: Sequence[str], out: str = "_rn") -> DataFrame:
    """A 0-based row number in global order, without bringing the rows into one task."""
    return global_prefix_sum(df, order_by, None, out)


def global_prefix_sum(df: DataFrame, order_by: Sequence[str], weight: str | None, out: str) -> DataFrame:
    """The sum of ``weight`` (of ones if None) over the rows before each row in global order.

    Rows are range-partitioned; offsets come from one sum for each partition.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    placed = checkpointed(
        df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *order_by, "_tie").withColumn("_part", F.spark_partition_id())
    )
    counts = placed.groupBy("_part").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_cnt"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_part").orderBy(*order_by, "_tie")
    if weight is None:
        ranked = placed.withColumn("_in", F.row_number().over(inside) - 1)
    else:
        ranked = placed.withColumn("_in", F.coalesce(F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # one row a partition on the broadcast side
    return ranked.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_off") + F.col("_in")).drop("_part", "_tie", "_off", "_in", "_cnt")


def longest(df: DataFrame, series_by: Sequence[str]) -> int:
    """Rows of the longest series, from partial counts."""
    sizes = df.groupBy(*series_by).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.agg(F.coalesce(F.max("_rows"), F.lit(0))).first()[0]


class Ordered:
    """Rows of series in order, from which columns can look back or ahead by a number of rows.

    With ``series_by``, each series is a window of its own. Without, with ``blocked``, or where the longest series has more than ``BLOCK_ROWS``
    rows (they are counted, unless ``blocked`` says), series of any length
    are cut into blocks of rows that carry copies of their neighbours' edges, so that one series takes many tasks.
    ``reach`` is how far the columns look.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str], series_by: Sequence[str], reach: int, blocked: bool | None = None) -> None:
        self.series, self.order, self.reach = list(series_by), list(order_by), reach
        if not order_by:
            raise ValueError("a series needs order_by")
        if blocked is None:
            blocked = not series_by or longest(df, self.series) > BLOCK_ROWS
        self.blocked = blocked
        if not blocked:
            self.window = W.partitionBy(*self.series).orderBy(*self.order)
            self.frame = df.withColumn("_t", F.row_number().over(self.window) - 1)
            return
        numbered = global_row_number(df, [*self.series, *self.order], "_rn")
        if self.series:
            numbered = checkpointed(numbered)
            first = numbered.groupBy(*self.series).agg(F.min("_rn").alias("_first"))
            first = first.withColumnsRenamed({s: f"_f_{s}" for s in self.series})
            same = F.lit(True)
            for s in self.series:
                same = same & numbered[s].eqNullSafe(F.col(f"_f_{s}"))
            numbered = numbered.join(first, same).withColumn("_t", F.col("_rn") - F.col("_first")).drop("_first", *[f"_f_{s}" for s in self.series])
        else:
            numbered = numbered.withColumn("_t", F.col("_rn"))
        block = F.floor(F.col("_rn") / BLOCK_ROWS)
        near = F.sequence(F.floor((F.col("_rn") - reach) / BLOCK_ROWS), F.floor((F.col("_rn") + reach) / BLOCK_ROWS))
        spread = numbered.withColumn("_home", block).withColumn("_block", F.explode(near))
        self.window = W.partitionBy(*self.series, "_block").orderBy("_rn")
        self.frame = spread

    def past(self, col: str, by: int) -> Column:
        return F.lag(col, by).over(self.window) if by else F.col(col)

    def ahead(self, col: str, by: int) -> Column:
        return F.lead(col, by).over(self.window) if by else F.col(col)

    def done(self, df: DataFrame) -> DataFrame:
        """Without the copies of other blocks' rows."""
        if not self.blocked:
            return df
        return df.where(F.col("_home") == F.col("_block")).drop("_home", "_block", "_rn")


def embedded(
    df: DataFrame,
    parts: dict[str, tuple[Variable, int]],
    future: Variable,
    order_by: Sequence[str],
    series_by: Sequence[str] = (),
    step: int = 1,
    blocked: bool | None = None,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, dict[str, tuple[str, ...]]]:
    """Future and past columns for transfer entropies.

    ``parts`` maps a name to a variable and the number of past values wanted of it. Rows are those from which all pasts
    exist, a stride of ``step`` apart in each series; a past is ``step`` rows apart too, oldest first. Series that are not longer than
    the longest past give no rows. Returns the frame and the columns of each part, ``future`` among them.
    """
    at_least("step", step, 1)
    for name, (_, hist) in parts.items():
        at_least(f"history of {name}", hist, 1)
    delay = max(h for _, h in parts.values()) * step
    used = list(dict.fromkeys([*series_by, *order_by, *keep, *variable(future), *(c for v, _ in parts.values() for c in variable(v))]))
    rows = Ordered(df.select(*used), order_by, series_by, delay, blocked)
    names: dict[str, tuple[str, ...]] = {"future": tuple(f"_future_{i}" for i in range(len(variable(future))))}
    cols = [F.col(c).alias(n) for c, n in zip(variable(future), names["future"], strict=True)]
    for name, (v, hist) in parts.items():
        made = []
        for j in range(hist, 0, -1):
            for i, c in enumerate(variable(v)):
                made.append(f"_{name}_{hist - j}_{i}")
                cols.append(rows.past(c, j * step).alias(made[-1]))
        names[name] = tuple(made)
    home = ["_home", "_block", "_rn"] if rows.blocked else []
    out = rows.frame.select(*dict.fromkeys([*series_by, *order_by, *keep]), "_t", *home, *cols)
    out = rows.done(out).where((F.col("_t") >= delay) & ((F.col("_t") - delay) % step == 0))
    return out.drop("_t"), names


def shuffled_pasts(
    frame: DataFrame, columns: Sequence[str], order_by: Sequence[str], series_by: Sequence[str], rounds: int, seed: int, key: Sequence[str]
) -> DataFrame:
    """Whole rows of the given columns dealt anew within each series, once a round: the frame with a ``round``, the rest left in place.

    Rows and dealt rows are numbered alike, round by round and series by series, over range partitions, so no series is
    one task. A row's place in a round is the MD5 of its key and the round plus ``seed``, whatever the partitions.
    """
    many = frame.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    place = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], (F.col("round") + seed).cast("string")))
    dealt = many.select("round", *series_by, *order_by, place.alias("_place"), *columns)
    a = global_row_number(many.drop(*columns), ["round", *series_by, *order_by], "_rn")
    b = global_row_number(dealt, ["round", *series_by, "_place", *order_by], "_rn").select("_rn", *columns)
    # both are as long as all rounds; packed, they look small enough to broadcast, but unpacked they fill the driver
    return a.join(b.hint("merge"), "_rn").drop("_rn")
