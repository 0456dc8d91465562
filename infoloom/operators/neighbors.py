"""Neighbour queries in any number of dimensions: nearest distances, range counts and kernel sums.

Equal points are one point with a weight, so a value that a third of all rows share costs one row. Up to ``ALL_PAIRS`` distinct
points, queries and data are dealt into blocks and each pair of blocks is one task of plain array arithmetic. Beyond that the data
are cut into boxes at medians, and a query visits only the boxes within its reach, so work follows the number of
neighbours and not the square of the points. Boxes come in two levels where there are too many for the driver: the outer ones are
known to it, the inner ones to the tasks that search an outer one. A task holds two bounded blocks whatever the number of points. In one
dimension, range counts need no pairs at all: they are differences of global prefix sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.series import checkpointed, global_prefix_sum

#: Distinct points up to which every pair is looked at.
ALL_PAIRS = 12_000
#: Data points in a block at most, on average; a few queries' distances to them are taken at a time.
BLOCK_POINTS = 8_192
#: Data points in a box at most, on average, as far as ``MAX_BOXES`` goes.
BOX_POINTS = 2_048
#: Queries that meet a block in one task, on average.
BLOCK_QUERIES = 65_536
CELLS = 4_000_000
#: Boxes at most whose corners and sizes go through the driver. Beyond, each of these is cut into boxes of its own by a task.
MAX_BOXES = 4_096
#: Points that decide where boxes are cut; results do not depend on the cuts.
SAMPLE = 50_000
#: Standard deviations from which on a Gaussian kernel is 0 in double precision.
FAR = 39.0
#: Distance of grid nodes, in standard deviations: a sum over them equals its integral to 1e-13.
STEP = 0.4
#: How far nodes go beyond what lies between two points: ``exp(-2 * MARGIN**2)`` is 1e-14.
MARGIN = 4.0
#: Nodes of a grid at most; 8 bytes each go through the driver and to every task.
NODES = 4_000_000
#: A grid is taken where it has fewer nodes times points than this many times the pairs; results are the same.
GRID_PAYS = 150
#: Points of a block whose sets of near points are bits.
BIT_POINTS = 4_096
#: Queries that meet such blocks in one task, and blocks that one task gets, at most.
BIT_QUERIES = 524_288
BIT_BLOCKS = 256
#: Nodes whose sums travel as one row.
SLICE = 65_536

Compute = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct points: ``_id``, ``_x`` (array of doubles) and ``_w``, the number of rows there.

    Rows with a null or NaN coordinate are left out. Counts have partial sums before their shuffle.
    """
    x = [F.col(c).cast("double") for c in columns]
    kept = df.select(F.array(*x).alias("_x")).where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    return checkpointed(_numbered(kept.groupBy("_x").agg(F.count(F.lit(1)).alias("_w"))))


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("_id", F.monotonically_increasing_id()).select("_id", "_x", "_w")


def total(data: DataFrame) -> int:
    """Rows behind distinct points."""
    return data.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]


def every_row(df: DataFrame) -> DataFrame:
    """A row for each of the rows that stand behind a distinct point; long runs are unfolded in steps."""
    step = 1000
    runs = df.withColumn("_run", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_w") / step))))
    rest = F.least(F.lit(step), F.col("_w") - (F.col("_run") - 1) * step).cast("int")
    return runs.withColumn("_one", F.explode(F.array_repeat(F.lit(0), rest))).drop("_run", "_one")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _solver(compute: Compute, schema: str, extra: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A pair of blocks: ``compute`` gets query points, their extra columns, data points and weights, a few queries at a time."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    names = {f.split()[0]: kinds[f.split()[1]] for f in schema.split(", ")}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"_id": []}
        if left.num_rows and right.num_rows:
            x, y = _matrix(left.column("_x")), _matrix(right.column("_y"))
            more = np.column_stack([left.column(c).to_numpy() for c in extra]) if extra else np.zeros((len(x), 0))
            ids, weights = left.column("_id").to_numpy(), right.column("_w").to_numpy()
            rows = max(1, CELLS // (len(y) * max(1, x.shape[1])))
            for a in range(0, len(x), rows):
                got = compute(x[a : a + rows], more[a : a + rows], y, weights)
                out["_id"].append(ids[a : a + rows])
                for k, v in got.items():
                    out.setdefault(k, []).append(v)
        return _as_table(out, names)

    return run


def _as_table(out: dict[str, list], names: dict[str, pa.DataType]) -> pa.Table:
    columns = {"_id": pa.array(np.concatenate(out["_id"]) if out["_id"] else [], pa.int64())}
    for n, kind in names.items():
        parts = out.get(n)
        if not parts:
            columns[n] = pa.nulls(0, kind)
        elif parts[0].ndim == 2:
            columns[n] = _lists(np.concatenate(parts))
        else:
            columns[n] = pa.array(np.concatenate(parts), kind)
    return pa.table(columns)


def _sides(n: int, workers: int) -> int:
    return max(math.ceil(n / BLOCK_POINTS), math.isqrt(max(1, workers - 1)) + 1 if n > 256 else 1)


def all_pairs(queries: DataFrame, data: DataFrame, sizes: tuple[int, int], compute: Compute, schema: str, extra: Sequence[str] = ()) -> DataFrame:
    """Partial results of every query against every block of data: ``_id`` and the columns of ``schema``."""
    workers = queries.sparkSession.sparkContext.defaultParallelism
    gq, gd = (_sides(n, workers) for n in sizes)
    q = queries.select("_id", "_x", *extra).withColumn("_i", F.pmod(F.xxhash64("_id"), F.lit(gq)).cast("long")).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(gd - 1).cast("long"))))
    d = data.select(F.col("_x").alias("_y"), "_w", F.col("_id").alias("_yid")).withColumn("_j", F.pmod(F.xxhash64("_yid", F.lit(1)), F.lit(gd)).cast("long"))
    d = d.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(gq - 1).cast("long"))))
    return q.groupBy("_i", "_j").cogroup(d.groupBy("_i", "_j")).applyInArrow(_solver(compute, schema, extra), f"_id long, {schema}")


class Cuts:
    """A balanced tree of cuts, each at the median of the widest side of a sample."""

    def __init__(self, sample: np.ndarray, boxes: int) -> None:
        self.depth = max(0, math.ceil(math.log2(max(1, boxes))))
        inner = 2**self.depth - 1
        self.axis, self.cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        parts = [sample]
        for node in range(inner):  # level by level: the children of a node are 2 * node + 1 and 2 * node + 2
            part = parts[node]
            if len(part) > 1:
                side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                values = part[:, side]
                if values.max() > values.min():
                    middle = np.partition(values, len(values) // 2)[len(values) // 2]
                    self.axis[node] = side
                    self.cut[node] = middle if middle < values.max() else values[values < middle].max()
            right = part[:, self.axis[node]] > self.cut[node]
            parts += [part[~right], part[right]]

    def of(self, x: np.ndarray) -> np.ndarray:
        """The box of each point."""
        node = np.zeros(len(x), np.int64)
        row = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.axis[node]] > self.cut[node])
        return node - (2**self.depth - 1)


def _dealt(ids: np.ndarray, into: np.ndarray) -> np.ndarray:
    """One of ``into`` numbers for each id, by a hash."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % into.astype(np.uint64)).astype(np.int64)


def _gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray, p: float) -> np.ndarray:
    """Distances of points to boxes with the given corners; 0 within."""
    gap = np.zeros((len(x), len(low)))
    for k in range(x.shape[1]):
        side = np.maximum(0.0, np.maximum(low[None, :, k] - x[:, None, k], x[:, None, k] - high[None, :, k]))
        gap = np.maximum(gap, side) if math.isinf(p) else gap + side**p
    return gap if math.isinf(p) else gap ** (1 / p)


def boxed(data: DataFrame, n: int, dim: int) -> Boxes:
    """Boxes of ``n`` data points in ``dim`` dimensions, in one level or two."""
    return Nested(data, n, dim) if n > MAX_BOXES * BOX_POINTS else Boxes(data, n, dim)


class Boxes:
    """Data points in boxes: their corners and sizes (``MAX_BOXES`` rows at most) are known to the driver."""

    def __init__(self, data: DataFrame, n: int, dim: int) -> None:
        self.data, self.dim = data, dim
        share = min(1.0, SAMPLE / max(1, n))
        sample = data.select("_x").sample(share, seed=11).limit(2 * SAMPLE).toArrow().column("_x")
        self.cuts = cuts = Cuts(_matrix(sample) if len(sample) else np.zeros((0, dim)), min(MAX_BOXES, math.ceil(n / BOX_POINTS)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cuts.of(_matrix(batch.column(0))))], names=["_x", "_j"])

        placed = data.select("_x").mapInArrow(place, "_x array<double>, _j long")
        corner = [f(F.col("_x")[k]).alias(f"{f.__name__}{k}") for k in range(dim) for f in (F.min, F.max)]
        rows = placed.groupBy("_j").agg(F.count(F.lit(1)).alias("n"), *corner).orderBy("_j").collect()
        self.box = np.array([r["_j"] for r in rows], np.int64)
        self.low = np.array([[r[f"min{k}"] for k in range(dim)] for r in rows]).reshape(-1, dim)
        self.high = np.array([[r[f"max{k}"] for k in range(dim)] for r in rows]).reshape(-1, dim)
        self.blocks = np.array([math.ceil(r.n / BLOCK_POINTS) for r in rows], np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "data"}  # tasks get corners and sizes, not the frame

    def visits(self, x: np.ndarray, reach: np.ndarray | None, p: float) -> tuple[np.ndarray, np.ndarray]:
        """Which points visit which boxes (by place in the list): those within reach, or without reach the point's own."""
        if reach is None:
            own = np.searchsorted(self.box, here := self.cuts.of(x))
            known = np.flatnonzero(self.box[np.minimum(own, len(self.box) - 1)] == here)
            return known, own[known]
        who, where = [], []
        step = max(1, CELLS // max(1, len(self.box)))
        for a in range(0, len(x), step):
            gap = _gaps(x[a : a + step], self.low, self.high, p)
            i, j = np.nonzero(gap <= reach[a : a + step, None] * (1 + 1e-9))  # rounding may add a box, never lose one
            who.append(i + a)
            where.append(j)
        return np.concatenate(who or [np.zeros(0, np.int64)]), np.concatenate(where or [np.zeros(0, np.int64)])

    def partials(self, queries: DataFrame, compute: Compute, schema: str, p: float, reach: str | float | None, extra: Sequence[str] = ()) -> DataFrame:
        """Partial results of the queries against the boxes that they visit: ``_id`` and the columns of ``schema``.

        ``reach`` is a number, a column or, for the own box, None. Visits are counted first, so that boxes with many visitors or points are
        split into pairs of bounded blocks.
        """
        more = [*extra, *([reach] if isinstance(reach, str) and reach not in extra else [])]
        slim = queries.select("_id", "_x", *more)

        def visited(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            x = _matrix(batch.column(1))
            at = batch.column(2 + more.index(reach)).to_numpy() if isinstance(reach, str) else None if reach is None else np.full(len(x), float(reach))
            return self.visits(x, at, p)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(self.box), np.int64)
            for batch in batches:
                if batch.num_rows:
                    seen += np.bincount(visited(batch)[1], minlength=len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], names=["_j", "n"])

        visitors = np.zeros(len(self.box), np.int64)
        for r in slim.mapInArrow(count, "_j long, n long").groupBy("_j").agg(F.sum("n").alias("n")).collect():
            visitors[r["_j"]] = r.n
        groups = np.maximum(1, -(-visitors // BLOCK_QUERIES))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                i, j = visited(batch)
                times = self.blocks[j]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                i, j = np.repeat(i, times), np.repeat(j, times)
                group = _dealt(batch.column(0).to_numpy()[i], groups[j])
                took = batch.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(j), pa.array(group), pa.array(part)], names=["_id", "_x", *more, "_j", "_i", "_s"])

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                y = _matrix(batch.column(1))
                j = np.searchsorted(self.box, self.cuts.of(y))
                part = _dealt(batch.column(0).to_numpy(), self.blocks[j])
                times = groups[j]
                i = np.repeat(np.arange(len(y)), times)
                group = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([_lists(y[i]), batch.column(2).take(pa.array(i)), pa.array(j[i]), pa.array(group), pa.array(part[i])], names=["_y", "_w", "_j", "_i", "_s"])

        kinds = "".join(f", {c} double" for c in more)
        q = slim.mapInArrow(send, f"_id long, _x array<double>{kinds}, _j long, _i long, _s long")
        d = self.data.select("_id", "_x", "_w").mapInArrow(store, "_y array<double>, _w long, _j long, _i long, _s long")
        keys = ["_j", "_i", "_s"]
        return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(_solver(compute, schema, extra), f"_id long, {schema}")


class Nested(Boxes):
    """Boxes in two levels. What a query visits is found twice: outer boxes from their corners on the driver, then
    the inner boxes of each by a task that has their corners and a bounded number of queries.
    """

    def __init__(self, data: DataFrame, n: int, dim: int) -> None:
        super().__init__(data, n, dim)
        cuts, size = self.cuts, BOX_POINTS

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts.of(_matrix(batch.column(0))))], names=["_y", "_w", "_o"])

        def cut(table: pa.Table) -> pa.Table:
            y = _matrix(table.column("_y"))
            return table.append_column("_s", pa.array(Cuts(y, math.ceil(len(y) / size)).of(y)))

        placed = data.select(F.col("_x").alias("_y"), "_w").mapInArrow(place, "_y array<double>, _w long, _o long")
        self.inner = checkpointed(placed.groupBy("_o").applyInArrow(cut, "_y array<double>, _w long, _o long, _s long"))
        corner = [F.array(*[f(F.col("_y")[k]) for k in range(dim)]).alias(n) for f, n in ((F.min, "_low"), (F.max, "_high"))]
        self.corners = checkpointed(self.inner.groupBy("_o", "_s").agg(*corner))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("data", "inner", "corners")}

    def partials(self, queries: DataFrame, compute: Compute, schema: str, p: float, reach: str | float | None, extra: Sequence[str] = ()) -> DataFrame:
        """As with one level; without reach a query visits the inner box that is nearest, in its own outer one."""
        more = [*extra, *([reach] if isinstance(reach, str) and reach not in extra else [])]
        slim = queries.select("_id", "_x", *more)
        kinds = "".join(f", {c} double" for c in more)

        def limits(x: np.ndarray, columns: Callable[[str], pa.Array]) -> np.ndarray | None:
            return columns(reach).to_numpy() if isinstance(reach, str) else None if reach is None else np.full(len(x), float(reach))

        def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(1))
                    i, j = self.visits(x, limits(x, lambda c, b=batch: b.column(2 + more.index(c))), p)
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(i)).columns, pa.array(self.box[j])], names=["_id", "_x", *more, "_o"])

        def inner(left: pa.Table, right: pa.Table) -> pa.Table:
            who, where = [], []
            if left.num_rows and right.num_rows:
                x, low, high = _matrix(left.column("_x")), _matrix(right.column("_low")), _matrix(right.column("_high"))
                at = limits(x, left.column)
                step = max(1, CELLS // len(low))
                for a in range(0, len(x), step):
                    gap = _gaps(x[a : a + step], low, high, p)
                    i, j = (np.arange(len(gap)), gap.argmin(axis=1)) if at is None else np.nonzero(gap <= at[a : a + step, None] * (1 + 1e-9))
                    who.append(i + a)
                    where.append(j)
            i, j = (np.concatenate(z or [np.zeros(0, np.int64)]) for z in (who, where))
            took = left.take(pa.array(i))
            columns = {c: took.column(c) for c in ("_id", "_x", *more, "_o")}
            return pa.table({**columns, "_s": right.column("_s").take(pa.array(j))})

        deal = F.xxhash64("_id", F.lit(1))
        visits = checkpointed(slim.mapInArrow(outer, f"_id long, _x array<double>{kinds}, _o long"))
        groups = checkpointed(visits.groupBy("_o").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("_groups")))
        asked = visits.join(groups, "_o").withColumn("_i", F.pmod(deal, F.col("_groups"))).drop("_groups")
        known = self.corners.join(groups, "_o").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1))).drop("_groups")
        within = checkpointed(asked.groupBy("_o", "_i").cogroup(known.groupBy("_o", "_i")).applyInArrow(inner, f"_id long, _x array<double>{kinds}, _o long, _s long"))
        groups = checkpointed(within.groupBy("_o", "_s").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("_groups")))
        asked = within.join(groups, ["_o", "_s"]).withColumn("_i", F.pmod(deal, F.col("_groups"))).drop("_groups")
        stored = self.inner.join(groups, ["_o", "_s"]).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1))).drop("_groups")
        keys = ["_o", "_s", "_i"]
        return asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(_solver(compute, schema, extra), f"_id long, {schema}")


def distances(x: np.ndarray, y: np.ndarray, p: float) -> np.ndarray:
    """Distances between two sets of points under a Minkowski norm."""
    out = np.abs(x[:, None, 0] - y[None, :, 0])
    if math.isinf(p):
        for k in range(1, x.shape[1]):
            np.maximum(out, np.abs(x[:, None, k] - y[None, :, k]), out=out)
        return out
    if x.shape[1] == 1:
        return out
    out **= p
    for k in range(1, x.shape[1]):
        out += np.abs(x[:, None, k] - y[None, :, k]) ** p
    return np.sqrt(out) if p == 2 else out ** (1 / p)


def weighed(near: np.ndarray, weight: np.ndarray, want: int) -> np.ndarray:
    """The first ``want`` of sorted distances that each count as often as their weight; infinity where there are fewer."""
    upto = np.cumsum(np.minimum(weight, want), axis=1)
    place = (upto[:, None, :] <= np.arange(want)[None, :, None]).sum(axis=2)
    return np.take_along_axis(np.concatenate([near, np.full((len(near), 1), np.inf)], axis=1), place, axis=1)


def kth_distance(queries: DataFrame, data: DataFrame, k: int, p: float, exclude_self: bool) -> DataFrame:
    """``_rho`` in addition to the queries: the distance of each to its k-th nearest point of the data.

    With ``exclude_self`` queries and data are the same points, and a point is no neighbour of its own, whereas another at the
    same place is. Fewer than k neighbours are an error. Beyond ``ALL_PAIRS`` points, the distance within a
    query's own box bounds which others it visits.
    """
    want = k + 1 if exclude_self else k
    if total(data) < want:
        raise ValueError(f"k = {k} needs more points")

    def compute(x: np.ndarray, _: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
        d = distances(x, y, p)
        m = min(want, d.shape[1])
        at = np.argpartition(d, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(d, at, axis=1)
        order = np.argsort(near, axis=1)
        return {"_near": weighed(np.take_along_axis(near, order, axis=1), w[np.take_along_axis(at, order, axis=1)], want)}

    def best(parts: DataFrame, name: str) -> DataFrame:
        return parts.groupBy("_id").agg(F.get(F.array_sort(F.flatten(F.collect_list("_near"))), F.lit(want - 1)).alias(name))

    nq, nd = queries.count(), data.count()
    if max(nq, nd) <= ALL_PAIRS:
        return queries.join(best(all_pairs(queries, data, (nq, nd), compute, "_near array<double>"), "_rho"), "_id")
    boxes = boxed(data, nd, _dim(data))
    own = best(boxes.partials(queries, compute, "_near array<double>", p, None), "_reach")
    bounded = checkpointed(matched(queries, own, "_id", "left").withColumn("_reach", F.coalesce("_reach", F.lit(math.inf))))
    return matched(queries, best(boxes.partials(bounded, compute, "_near array<double>", p, "_reach"), "_rho"), "_id")


def matched(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two tables as long as the points, by sorting. Packed columns look small enough to broadcast, but unpacked they fill the driver."""
    return left.join(right.hint("merge"), on, how)


def _dim(data: DataFrame) -> int:
    first = data.select(F.size("_x").alias("d")).first()
    return first.d if first else 1


def _projected(df: DataFrame, dims: Sequence[int], turn: np.ndarray | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Points in a subspace, as ``_y``, with what they came from; ``turn`` is a linear map applied there."""
    axes = list(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(_matrix(batch.column(1))[:, axes] @ turn.T)], names=[*batch.schema.names, "_y"])

    slim = df.select("_id", "_x", "_w", *keep)
    if turn is None:
        return slim.withColumn("_y", F.array(*[F.col("_x")[k] for k in axes]))
    kinds = "".join(f", {c} double" for c in keep)
    return slim.mapInArrow(run, f"_id long, _x array<double>, _w long{kinds}, _y array<double>")


def _distinct(projected: DataFrame) -> DataFrame:
    return checkpointed(_numbered(projected.select(F.col("_y").alias("_x"), "_w").groupBy("_x").agg(F.sum("_w").alias("_w"))))


def range_counts(queries: DataFrame, data: DataFrame, subspaces: dict[str, Sequence[int]], p: float, strict: bool) -> DataFrame:
    """Data points within ``_rho`` of each query in each subspace, the point itself counted: a column each beside the queries'."""

    def within(x: np.ndarray, more: np.ndarray, y: np.ndarray, w: np.ndarray, dims: Sequence[int]) -> np.ndarray:
        d = distances(x[:, list(dims)], y[:, list(dims)], p)
        return ((d < more[:, :1]) if strict else (d <= more[:, :1])) @ w

    nq, nd = queries.count(), data.count()
    if max(nq, nd) <= ALL_PAIRS:
        parts = all_pairs(queries, data, (nq, nd), lambda x, more, y, w: {n: within(x, more, y, w, dims) for n, dims in subspaces.items()}, ", ".join(f"{n} long" for n in subspaces), ["_rho"])
        return queries.join(parts.groupBy("_id").agg(*[F.sum(n).alias(n) for n in subspaces]), "_id")
    out = queries
    for name, dims in subspaces.items():
        asked = _projected(queries, dims, keep=["_rho"]).select("_id", F.col("_y").alias("_x"), "_rho")
        stored = _distinct(_projected(data, dims))
        boxes, every = boxed(stored, stored.count(), len(dims)), range(len(dims))
        parts = boxes.partials(asked, lambda x, more, y, w, n=name, e=every: {n: within(x, more, y, w, e)}, f"{name} long", p, "_rho", ["_rho"])
        out = matched(out, parts.groupBy("_id").agg(F.sum(name).alias(name)), "_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


class Kernel:
    """A kernel of a subspace: its value (1 if None) at distances that are taken after a linear map, up to a reach."""

    def __init__(self, dims: Sequence[int], p: float, reach: float, value: Callable[[np.ndarray], np.ndarray] | None = None, turn: np.ndarray | None = None) -> None:
        self.dims, self.p, self.reach, self.value, self.turn = list(dims), p, reach, value, turn
        self.normal = False

    def sums(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        d = distances(x, y, self.p)
        near = d <= self.reach
        return (near if self.value is None else np.where(near, self.value(d), 0.0)) @ w.astype(np.float64)

    def whole(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        a, b = x[:, self.dims], y[:, self.dims]
        return self.sums(a, b, w) if self.turn is None else self.sums(a @ self.turn.T, b @ self.turn.T, w)


def gaussian(dims: Sequence[int], turn: np.ndarray | None = None) -> Kernel:
    """The standard normal kernel ``exp(-d**2 / 2)``, not cut anywhere."""
    kernel = Kernel(dims, 2.0, FAR, lambda d: np.exp(-0.5 * d * d), turn)
    kernel.normal = True
    return kernel


class Grid:
    """Sums of a Gaussian kernel by way of the nodes of a grid, at one cost for each point.

    ``exp(-(x-y)**2 / 2)`` is, up to a factor, the sum over nodes g of ``exp(-(x-g)**2) * exp(-(y-g)**2)``: the trapezoidal rule of a
    Gaussian around the middle of x and y, exact to 1e-13 of each pair's value at this step. So data are summed up at the nodes, and
    queries read them there. Everything is positive, so nothing cancels. Nodes stand wherever the middle of two points nearer than ``FAR`` can be.
    """

    def __init__(self, kernel: Kernel, bins: Sequence[np.ndarray]) -> None:
        """``bins`` are the unit intervals of each axis in which points lie."""
        self.dims, self.turn, self.axes = kernel.dims, kernel.turn, []
        for b in bins:
            b = np.unique(b)
            first, last = np.floor((b[0] - MARGIN) / STEP), np.ceil((b[-1] + 1 + MARGIN) / STEP)
            low, high = np.floor((b - FAR / 2 - MARGIN) / STEP), np.ceil((b + 1 + FAR / 2 + MARGIN) / STEP)
            low, high = np.maximum(low, first), np.minimum(high, last)
            start = np.concatenate([low[:1], np.maximum(low[1:], np.maximum.accumulate(high)[:-1] + 1)])
            self.axes.append(np.concatenate([np.arange(a, z + 1) for a, z in zip(start, high, strict=True)]) * STEP)
        sizes = [len(a) for a in self.axes]
        self.nodes = math.prod(sizes)
        self.half = min(range(len(sizes) + 1), key=lambda i: abs(math.log(math.prod(sizes[:i])) - math.log(math.prod(sizes[i:]))))
        self.left, self.right = math.prod(sizes[: self.half]), math.prod(sizes[self.half :])
        self.factor = (STEP * math.sqrt(2 / math.pi)) ** len(sizes)
        self.sums = np.zeros((0, 0))

    @staticmethod
    def within(kernel: Kernel, x: np.ndarray) -> np.ndarray:
        y = x[:, kernel.dims]
        return y if kernel.turn is None else y @ kernel.turn.T

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x[:, self.dims] if self.turn is None else x[:, self.dims] @ self.turn.T
        both = []
        for some in (range(self.half), range(self.half, len(self.axes))):
            out = np.ones((len(y), 1))
            for k in some:
                near = np.exp(-((y[:, k, None] - self.axes[k][None]) ** 2))
                out = (out[:, :, None] * near[:, None, :]).reshape(len(y), -1)
            both.append(out)
        return both[0], both[1]

    def chunks(self, n: int) -> Iterator[slice]:
        step = max(1, CELLS // (2 * max(self.left, self.right)))
        return (slice(a, min(n, a + step)) for a in range(0, n, step))

    def add(self, x: np.ndarray, w: np.ndarray, into: np.ndarray) -> None:
        for c in self.chunks(len(x)):
            a, b = self._halves(x[c])
            into += a.T @ (b * w[c, None])

    def read(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for c in self.chunks(len(x)):
            a, b = self._halves(x[c])
            out[c] = np.einsum("ij,ij->i", a @ self.sums, b)
        return out * self.factor


def grids(frames: Sequence[DataFrame], kernels: dict[str, Kernel]) -> dict[str, Grid]:
    """Grids of those Gaussian kernels that need no more than ``NODES``."""
    normal = {n: k for n, k in kernels.items() if k.normal}
    if not normal:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                rows = [(i, a, b) for i, k in enumerate(normal.values()) for a, col in enumerate(Grid.within(k, x).T) for b in np.unique(np.floor(col))]
                yield pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows]), pa.array([int(r[1]) for r in rows]), pa.array([float(r[2]) for r in rows])], names=["k", "a", "b"])

    seen = [f.select("_x").mapInArrow(run, "k long, a long, b double") for f in frames]
    found = (seen[0] if len(seen) == 1 else seen[0].union(seen[1])).distinct()
    held: dict[tuple[int, int], list[float]] = {}
    limit = NODES // 8  # an axis alone would have too many nodes beyond that
    rows = found.limit(limit + 1).collect()
    if len(rows) > limit:
        return {}
    for r in rows:
        held.setdefault((r.k, r.a), []).append(r.b)
    made = {n: Grid(k, [np.array(held[i, a]) for a in range(len(k.dims))]) for i, (n, k) in enumerate(normal.items())} if rows else {}
    return {n: g for n, g in made.items() if g.nodes <= NODES}


def grid_sums(queries: DataFrame, data: DataFrame, made: dict[str, Grid]) -> DataFrame:
    """Sums of Gaussian kernels over the data at each query by their grids: a column each beside the queries'."""
    every = list(made.values())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((g.left, g.right)) for g in every]
        for batch in batches:
            if batch.num_rows:
                x, w = _matrix(batch.column(0)), batch.column(1).to_numpy().astype(np.float64)
                for g, into in zip(every, sums, strict=True):
                    g.add(x, w, into)
        for i, into in enumerate(sums):
            flat = into.ravel()
            for s, a in enumerate(range(0, len(flat), SLICE)):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([s]), pa.array([flat[a : a + SLICE].tobytes()], pa.binary())], names=["k", "s", "v"])

    def added(table: pa.Table) -> pa.Table:
        total_ = sum(np.frombuffer(v.as_buffer()) for v in table.column("v"))
        return pa.table({"k": table.column("k").slice(0, 1), "s": table.column("s").slice(0, 1), "v": pa.array([np.asarray(total_).tobytes()], pa.binary())})

    tasks = max(1, queries.sparkSession.sparkContext.defaultParallelism)
    parts = data.select("_x", "_w").coalesce(tasks).mapInArrow(spread, "k long, s long, v binary")
    flat = [np.zeros(g.nodes) for g in every]
    for r in parts.groupBy("k", "s").applyInArrow(added, "k long, s long, v binary").collect():
        got = np.frombuffer(r.v)
        flat[r.k][r.s * SLICE : r.s * SLICE + len(got)] = got
    for g, f in zip(every, flat, strict=True):
        g.sums = f.reshape(g.left, g.right)
    names = list(made)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(g.read(x)) for g in every]], names=["_id", "_x", "_w", *names])

    return queries.select("_id", "_x", "_w").mapInArrow(read, "_id long, _x array<double>, _w long, " + ", ".join(f"{n} double" for n in names))


class Bits:
    """A block of weighted points that counts those within a reach of queries along every axis.

    Along an axis the points below each of its values are a set of bits, so the points of an interval are the difference of two sets, those of a
    box the intersection over axes, and their weight is the number of bits in it, a binary digit of the weights at a time.
    """

    def __init__(self, y: np.ndarray, w: np.ndarray) -> None:
        self.words, place = -(-len(y) // 64), np.arange(len(y))
        bit = np.uint64(1) << (place % 64).astype(np.uint64)
        self.y, self.axes, self.digits = y, {}, []
        self.place, self.bit = place // 64, bit
        for b in range(int(w.max()).bit_length()):
            digit = np.zeros(self.words, np.uint64)
            some = (w >> b) & 1 == 1
            np.bitwise_or.at(digit, self.place[some], bit[some])
            self.digits.append((1 << b, None if some.all() else digit))

    def _axis(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.axes:
            values, at = np.unique(self.y[:, k], return_inverse=True)
            below = np.zeros((len(values) + 1, self.words), np.uint64)
            np.bitwise_or.at(below, (at + 1, self.place), self.bit)
            self.axes[k] = values, np.bitwise_or.accumulate(below, axis=0)
        return self.axes[k]

    @staticmethod
    def _ends(x: np.ndarray, values: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the values with ``abs(x - value) <= reach`` begin and end, with that very rounding."""
        last = len(values)
        low, high = np.searchsorted(values, x - reach, "left"), np.searchsorted(values, x + reach, "right")
        for end, into in ((low, lambda v: x - v > reach), (high, lambda v: v - x <= reach)):
            while True:
                up = (end < last) & into(values[np.minimum(end, last - 1)])
                down = (end > 0) & ~into(values[np.maximum(end, 1) - 1])
                if not (up | down).any():
                    break
                end += up
                end -= down & ~up
        return low, high

    def counts(self, x: np.ndarray, axes: Sequence[int], reach: float) -> np.ndarray:
        """The weight within reach of each query along ``axes``, one at least."""
        out = np.zeros(len(x), np.int64)
        ends = [(*self._ends(x[:, k], self._axis(k)[0], reach), self._axis(k)[1]) for k in axes]
        step = max(1, CELLS // (32 * self.words))
        for a in range(0, len(x), step):
            near = None
            for low, high, below in ends:
                one = below[high[a : a + step]]
                one ^= below[low[a : a + step]]
                near = one if near is None else np.bitwise_and(near, one, out=near)
            for value, digit in self.digits:
                out[a : a + step] += value * np.bitwise_count(near if digit is None else near & digit).sum(axis=1, dtype=np.int64)
        return out


def _sides_of(low: np.ndarray, high: np.ndarray, lower: np.ndarray, higher: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether boxes (rows) lie beyond reach of another one altogether, and along which axes they lie within reach of all of it."""
    beyond = (np.maximum(lower - high, low - higher) > reach).any(axis=1)
    return beyond, np.maximum(high - lower, higher - low) <= reach


def box_sums(queries: DataFrame, data: DataFrame, dim: int, reach: float, name: str) -> DataFrame:
    """Weight of the data within ``reach`` of each query along every axis: ``_id`` and partial sums ``name``.

    Queries are dealt into boxes, data into blocks in boxes. Blocks that are within reach of a whole box of queries, or of a part of one, count as one number;
    those in part within reach are compared by bits. A task has a bounded number of queries and blocks. Blocks travel packed, once for
    each box of queries that needs them.
    """
    spark = queries.sparkSession
    nq, nd = queries.count(), data.count()
    size = min(BIT_QUERIES, max(BLOCK_QUERIES, math.ceil(nq / max(1, spark.sparkContext.defaultParallelism))))
    sample = queries.select("_x").sample(min(1.0, SAMPLE / max(1, nq)), seed=11).limit(2 * SAMPLE).toArrow().column("_x")
    cuts = Cuts(_matrix(sample) if len(sample) else np.zeros((0, dim)), math.ceil(max(nq, nd) / size))
    points_, most = BIT_POINTS, BIT_BLOCKS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts.of(_matrix(batch.column(1))))], names=[*batch.schema.names, "_o"])

    def pack(table: pa.Table) -> pa.Table:
        y, w = _matrix(table.column("_x")), table.column("_w").to_numpy()
        box = Cuts(y, math.ceil(len(y) / points_)).of(y)
        rows = [np.flatnonzero(box == b) for b in np.unique(box)]
        first = table.column("_o")[0].as_py() << 32
        return pa.table({
            "_b": pa.array([first + i for i in range(len(rows))], pa.int64()),
            "_n": pa.array([int(w[r].sum()) for r in rows], pa.int64()),
            "_low": _lists(np.array([y[r].min(axis=0) for r in rows])),
            "_high": _lists(np.array([y[r].max(axis=0) for r in rows])),
            "_y": pa.array([y[r].tobytes() for r in rows], pa.binary()),
            "_w": pa.array([w[r].tobytes() for r in rows], pa.binary()),
        })

    asked = checkpointed(queries.select("_id", "_x").mapInArrow(place, "_id long, _x array<double>, _o long"))
    stored = data.select("_id", "_x", "_w").mapInArrow(place, "_id long, _x array<double>, _w long, _o long")
    packed = checkpointed(stored.groupBy("_o").applyInArrow(pack, "_b long, _n long, _low array<double>, _high array<double>, _y binary, _w binary"))
    blocks = packed.select("_b", "_n", "_low", "_high").orderBy("_b").toArrow()
    corner = [F.array(*[f(F.col("_x")[k]) for k in range(dim)]).alias(n) for f, n in ((F.min, "_low"), (F.max, "_high"))]
    boxes = asked.groupBy("_o").agg(*corner).orderBy("_o").collect()
    number, weight, lower, higher = blocks.column("_b").to_numpy(), blocks.column("_n").to_numpy(), _matrix(blocks.column("_low")), _matrix(blocks.column("_high"))
    whole: dict[int, int] = {}
    needs: list[tuple[np.ndarray, ...]] = []
    for r in boxes:
        beyond, inside = _sides_of(np.array([r["_low"]]), np.array([r["_high"]]), lower, higher, reach)
        inside = inside.all(axis=1)
        some = np.flatnonzero(~beyond & ~inside)
        whole[r["_o"]] = int(weight[inside].sum())
        needs.append((number[some], np.full(len(some), r["_o"]), np.arange(len(some)) // most))
    parts = spark.createDataFrame(pa.table({"_o": [r["_o"] for r in boxes], "_parts": [int(n[2][-1]) + 1 if len(n[2]) else 1 for n in needs]}))
    needed = spark.createDataFrame(pa.table(dict(zip(("_b", "_o", "_s"), [pa.array(np.concatenate(c), pa.int64()) for c in zip(*needs, strict=True)], strict=True))))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"_id": pa.array([], pa.int64()), name: pa.array([], pa.float64())})
        x = _matrix(left.column("_x"))
        box = Cuts(x, math.ceil(len(x) / points_)).of(x)
        order = np.argsort(box, kind="stable")
        x = x[order]
        _, start, sizes = np.unique(box[order], return_index=True, return_counts=True)
        low, high = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
        count = np.full(len(x), whole[left.column("_o")[0].as_py()] if left.column("_s")[0].as_py() == 0 else 0, np.int64)
        for values, weights in zip(right.column("_y"), right.column("_w"), strict=True):
            y, w = np.frombuffer(values.as_buffer()).reshape(-1, dim), np.frombuffer(weights.as_buffer(), np.int64)
            beyond, inside = _sides_of(low, high, y.min(axis=0), y.max(axis=0), reach)
            every = inside.all(axis=1)
            count[np.repeat(every, sizes)] += w.sum()
            some = ~beyond & ~every
            if some.any():
                rows = np.flatnonzero(np.repeat(some, sizes))
                axes = [k for k in range(dim) if not inside[some, k].all()]
                count[rows] += Bits(y, w).counts(x[rows], axes, reach)
        return pa.table({"_id": left.column("_id").take(pa.array(order)), name: pa.array(count.astype(np.float64))})

    q = asked.join(F.broadcast(parts), "_o").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    d = packed.join(F.broadcast(needed), "_b").select("_o", "_s", "_y", "_w")
    return q.groupBy("_o", "_s").cogroup(d.groupBy("_o", "_s")).applyInArrow(solve, f"_id long, {name} double")


def kernel_sums(queries: DataFrame, data: DataFrame, kernels: dict[str, Kernel]) -> DataFrame:
    """Sums over the data of one or more kernels at each query: a column each beside the queries'."""
    nq, nd = queries.count(), data.count()
    if max(nq, nd) <= ALL_PAIRS:
        parts = all_pairs(queries, data, (nq, nd), lambda x, _, y, w: {n: k.whole(x, y, w) for n, k in kernels.items()}, ", ".join(f"{n} double" for n in kernels))
        return queries.join(parts.groupBy("_id").agg(*[F.sum(n).alias(n) for n in kernels]), "_id")
    made = {n: g for n, g in grids([data] if queries is data else [queries, data], kernels).items() if g.nodes * (nq + nd) < GRID_PAYS * nq * nd}
    out = checkpointed(grid_sums(queries, data, made)) if made else queries
    for name, kernel in kernels.items():
        if name in made:
            continue
        placed = checkpointed(_projected(queries, kernel.dims, kernel.turn))  # joined back by value, so mapped once
        asked = _distinct(placed)
        stored = asked if queries is data else _distinct(_projected(data, kernel.dims, kernel.turn))
        if len(kernel.dims) == 1 and kernel.value is None:
            found = rank_counts(stored, kernel.reach, asked).select("_x", F.col("_cnt").cast("double").alias(name))
        elif kernel.value is None and math.isinf(kernel.p):
            parts = box_sums(asked, stored, len(kernel.dims), kernel.reach, name)
            found = matched(asked, parts.groupBy("_id").agg(F.sum(name).alias(name)), "_id", "left")
        else:
            boxes = boxed(stored, stored.count(), len(kernel.dims))
            parts = boxes.partials(asked, lambda x, _, y, w, n=name, k=kernel: {n: k.sums(x, y, w)}, f"{name} double", kernel.p, kernel.reach)
            found = matched(asked, parts.groupBy("_id").agg(F.sum(name).alias(name)), "_id", "left")
        at = found.select(F.col("_x").alias("_y"), F.coalesce(name, F.lit(0.0)).alias(name))
        out = matched(out, matched(placed.select("_id", "_y"), at, "_y").drop("_y"), "_id")
    return out


def rank_counts(data: DataFrame, radius: float, queries: DataFrame | None = None) -> DataFrame:
    """One-dimensional range counts as differences of global prefix sums: ``_cnt`` beside the queries', rows at most ``radius`` away.

    Each query asks for the number of rows below either end of its interval; points and ends are sorted together, and a
    prefix sum of weights answers. The cost is that of a sort, whatever the radius.
    """
    asked = data if queries is None else queries
    x = F.col("_x")[0]
    # at equal places a lower end comes before the points, an upper end after them
    events = data.select(x.alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("who"), "_w")
    for kind, end in ((0, x - radius), (2, x + radius)):
        events = events.union(asked.select(end, F.lit(kind), "_id", F.lit(0).cast("long")))
    below = global_prefix_sum(events, ["at", "kind"], "_w", "below").where("kind != 1")
    counts = below.groupBy("who").agg(F.sum(F.when(F.col("kind") == 2, F.col("below")).otherwise(-F.col("below"))).alias("_cnt"))
    return matched(asked, counts.withColumnRenamed("who", "_id"), "_id")
