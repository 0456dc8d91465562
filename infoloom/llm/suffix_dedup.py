"""Exact removal of long repeated byte strings by merging shards' positional Burrows-Wheeler transforms (operator 3).

Every string of ``short`` bytes (``length`` itself, unless shorter passages are to be reported too) has an anchor, the leftmost smallest of its ``gram``-byte hashes, so all copies of it
are found among the anchors with the same hash, and at the same offset from them. The bytes around an anchor that its strings,
prolonged to ``length`` where the text goes on, cover are its window. Windows of one hash are aligned at their anchors, which makes their transform a positional one
(Durbin, 2014): column by column it holds the next byte of each window, in the order of what stands before it read backwards.

A shard builds the transforms of its own windows. They are merged as Holt and McMillan (2014) merge transforms, by
refining an interleave: it says of which shard each place of the merged order is, begins anyhow, and each column deals it
anew by the bytes there, which is one step of the LF mapping. No window is sorted again. Where
neighbours part tells where their common stretch begins, and stretches of ``length`` bytes are the repeated intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, release, slices, written
from .near_dup import mixed

NULL_ID = -(2**63)
BASE = np.uint64(0x5851F42D4C957F2D)
SEGMENT = 1 << 18
POS_BITS = np.uint64(20)
POS_MASK = np.uint64((1 << 20) - 1)
D_BITS = 12  # of either end of an anchor's range of offsets, in a place


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(BASE), -1, 2**64)
    up, down = np.full(n, BASE), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Anchors:
    """Finds the anchors of all strings of ``length`` bytes in a text."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram = length, gram
        self.up, self.down = _powers(SEGMENT + length + 1)

    def of(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Positions, smallest and largest offsets of the strings that they anchor, and hashes, by segments.

        A string that starts ``d`` bytes before an anchor, d in its range, has that anchor. What a
        string's anchor is depends on its bytes alone.
        """
        size, gram, span = len(text), self.gram, self.length - self.gram + 1
        raw = np.frombuffer(text, np.uint8)
        for s in range(0, size - self.length + 1, SEGMENT):
            starts = min(SEGMENT, size - self.length + 1 - s)
            b = raw[s : s + starts + self.length - 1].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(b * self.up[: len(b)], out=sums[1:])
            n = len(b) - gram + 1
            hashes = mixed((sums[gram:] - sums[:n]) * self.down[:n])
            packed = (hashes & ~POS_MASK) | np.arange(n, dtype=np.uint64)
            width = -(-n // span) * span
            blocks = np.full(width, np.iinfo(np.uint64).max, np.uint64)
            blocks[:n] = packed
            blocks = blocks.reshape(-1, span)
            ahead = np.minimum.accumulate(blocks, axis=1).ravel()
            behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
            at = (np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts]) & POS_MASK).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.append(first[1:], starts) - 1
            p = at[first]
            yield p + s, p - last, p - first, hashes[p]


#: Rows of anchors, and of spans (from ``place`` to ``u1``, of ``length`` bytes or more if ``u2`` is 1) that a text settles by itself, where ``h`` is null.
ANCHOR = ["k", "th", "place", "h", "u1", "u2", "times"]


def _anchor_rows(length: int, short: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(short, gram)
        for batch in slices(batches):
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            got: list[tuple] = []
            spans: list[tuple] = []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                if len(text) < short:
                    continue
                parts = list(finder.of(text))
                if parts:
                    p, lo, hi, h = (np.concatenate(c) for c in zip(*parts, strict=True))
                    keys = b"".join(
                        xxhash.xxh3_128_digest(text[a:b], seed)
                        for a, b, seed in zip((p - hi).tolist(), (p - lo + length).tolist(), ((lo << D_BITS) | hi).tolist(), strict=True)
                    )
                    u = np.frombuffer(keys, "<i8").reshape(-1, 2)
                    place = (p << (2 * D_BITS)) | (lo << D_BITS) | hi
                    order = np.lexsort((u[:, 1], u[:, 0]))
                    new = np.ones(len(p), bool)
                    new[1:] = (u[order[1:]] != u[order[:-1]]).any(axis=1)
                    begin = np.flatnonzero(new)
                    times = np.diff(np.append(begin, len(p)))
                    one = order[begin]
                    got.append((place[one], h.view(np.int64)[one], u[one, 0], u[one, 1], times, ids[i], ths[i]))
                    twin = order[np.repeat(times, times) > 1]
                    if len(twin):  # settled within the text; periodic texts have many
                        for s, e in merged_spans((p - hi)[twin], (p - lo)[twin] + short):
                            spans.append((ids[i], ths[i], s, e, 0))
                        long_ = twin[(p - hi)[twin] + length <= len(text)]
                        if len(long_):
                            for s, e in merged_spans((p - hi)[long_], np.minimum((p - lo)[long_] + length, len(text))):
                                spans.append((ids[i], ths[i], s, e, 1))
            if got:
                width = [len(g[0]) for g in got]
                columns = [pa.array(np.concatenate(c)) for c in list(zip(*got, strict=True))[:5]]
                owner = [pa.array(np.repeat(np.array([g[j] for g in got]), width)) for j in (5, 6)]
                yield pa.RecordBatch.from_arrays([*owner, *columns], names=ANCHOR)
            if spans:
                k, th, s, e, whole = (np.array(c) for c in zip(*spans, strict=True))
                none = pa.nulls(len(k), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(th), pa.array(s), none, pa.array(e), pa.array(whole), none], names=ANCHOR)
        release()

    return run


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, smallest and largest offset of a packed place."""
    mask = (1 << D_BITS) - 1
    return place >> (2 * D_BITS), (place >> D_BITS) & mask, place & mask


FAR = np.int32(1 << 30)  # where a group begins, nothing is in common


def refine(
    columns: np.ndarray, group: np.ndarray, unit: np.ndarray, first: np.ndarray, last: np.ndarray, settled: int | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Merge transforms by refining their interleave, one column after the other.

    ``columns[c]`` holds the bytes of column ``c`` of all units (transforms) one after the other; those of a unit are in its own
    order. Members are sorted by group, then unit; ``first`` and ``last`` bound the columns that each has. Yields the column, the bytes in merged
    order, and then, with that column taken in, the order (as members) and where the stretch begins that each
    shares with the one before it. Groups whose bytes are all alike in a column stay as they are, and from column
    ``settled`` on (if given) groups go for good in which no stretch that holds that column is shared.
    """
    n = columns.shape[1]
    order, slot = np.arange(n), np.arange(n)
    head = np.ones(n, bool)
    head[1:] = group[1:] != group[:-1]
    place = np.cumsum(head) - 1
    f, b = first.copy(), last.copy()
    units = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))  # where each begins in a column
    number = np.repeat(np.arange(len(units)), np.diff(np.append(units, n)))
    start = int(first.min())
    begin = np.where(head, FAR, np.int32(start))
    low = (1 << 32) - 1
    for c in range(start, int(last.max())):
        symbols = columns[c][slot]
        here = (f <= c) & (c < b)
        s = np.where(here, symbols, np.int16(256))
        apart = np.flatnonzero((s[1:] != s[:-1]) & ~head[1:]) + 1
        if len(apart):
            open_ = np.zeros(int(place[-1]) + 1, bool)
            open_[place[apart]] = True
            at = np.flatnonzero(open_[place])
            m = np.arange(len(at))
            key = np.sort((((place[at] << 9) | s[at]) << 32) | m)
            rank, kind = key & low, key >> 32
            fresh = np.full(len(at), c + 1, np.int32)
            same = np.flatnonzero(kind[1:] == kind[:-1]) + 1
            if len(same):  # of what lies between two members of one byte, the latest beginning counts
                between = np.empty(2 * len(same), np.int64)
                between[::2], between[1::2] = rank[same - 1] + 1, rank[same] + 1
                fresh[same] = np.maximum.reduceat(np.append(begin[at], np.int32(0)), between)[::2]
            begin[at] = np.where(head[at], FAR, fresh)
            for x in (order, f, b, here):
                x[at] = x[at][rank]
            key = np.sort((number[order[at]] << 32) | m)
            owner = key >> 32
            new = np.ones(len(at), bool)
            new[1:] = owner[1:] != owner[:-1]
            slot[at[key & low]] = units[owner] + m - np.maximum.accumulate(np.where(new, m, 0))
        gone = np.flatnonzero(~here)
        if len(gone):  # a member outside its columns shares nothing
            gone = np.concatenate([gone, gone[gone < len(here) - 1] + 1])
            begin[gone[~head[gone]]] = c + 1
        yield c, symbols, order, begin
        if settled is not None and c >= settled and c % 32 == 0:
            shared = np.zeros(int(place[-1]) + 1, bool)
            shared[place[begin <= settled]] = True
            keep = shared[place]
            if not keep.any():
                return
            if not keep.all():
                order, slot, head, f, b, begin = (x[keep] for x in (order, slot, head, f, b, begin))
                place = np.cumsum(head) - 1


def laid_out(windows: list[bytes], first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Windows as columns: each by itself is a transform of one member."""
    rows = np.zeros((len(windows), width), np.uint8)
    for row, w, a, b in zip(rows, windows, first.tolist(), last.tolist(), strict=True):
        row[a:b] = np.frombuffer(w, np.uint8)
    return np.ascontiguousarray(rows.T)


def transform(columns: np.ndarray, group: np.ndarray, unit: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The merged transform of units, group by group."""
    out = np.zeros_like(columns)
    for c, symbols, _, _ in refine(columns, group, unit, first, last):
        out[c] = symbols
    return out


def repeated(
    columns: np.ndarray, group: np.ndarray, unit: np.ndarray, first: np.ndarray, last: np.ndarray, lengths: Sequence[int], reach: int
) -> list[np.ndarray]:
    """``hit[i, d]`` for each length: the string that starts ``d`` bytes before anchor ``i`` has a copy at another anchor of its group.

    Anchors stand at column ``reach``, which every string of an anchor holds.
    """
    hits = [np.zeros((columns.shape[1], reach + 1), bool) for _ in lengths]
    for c, _, order, begin in refine(columns, group, unit, first, last, settled=reach):
        for hit, length in zip(hits, lengths, strict=True):
            d = length - 1 - (c - reach)
            if 0 <= d <= reach:
                twin = begin <= c - length + 1
                twin[:-1] |= twin[1:]
                hit[order[twin], d] = True
    return hits


#: One row a shard and anchor hash: its windows' places and sizes, and its transform, columns one after the other.
SHARD = "h long, k array<long>, th array<long>, place array<long>, size array<long>, columns binary"
SPAN = "k long, th long, s long, e long, whole long"


def _shards(length: int, short: int, gram: int, shard_windows: int = 4096):
    """Build the transforms of the windows of a partition, ``shard_windows`` at a time."""
    reach = short - gram
    kind = pa.struct([("h", pa.int64()), ("place", pa.int64())])

    def built(h: list, k: list, th: list, place: list, windows: list) -> pa.RecordBatch:
        key = np.array(h, np.int64)
        rank = np.argsort(key, kind="stable")
        key, at = key[rank], np.array(place, np.int64)[rank]
        size = np.array(list(map(len, windows)), np.int64)
        first = reach - unpacked(at)[2]
        last = first + size[rank]
        columns = laid_out([windows[i] for i in rank.tolist()], first, last, reach + length)
        columns = transform(columns, key, np.arange(len(key)), first, last)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(begin[1:], len(key))
        bits = [columns[first[a:b].min() : last[a:b].max(), a:b].tobytes() for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
        offsets = pa.array(np.append(begin, len(key)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.array(x, np.int64)[rank])) for x in (k, th, place, size)]
        return pa.RecordBatch.from_arrays([pa.array(key[begin]), *lists, pa.array(bits, pa.binary())], names=["h", "k", "th", "place", "size", "columns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for batch in slices(batches, 64):
            for k, th, text, marks in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3), strict=True
            ):
                mark = marks.values.cast(kind)
                hs, places = mark.field("h").to_pylist(), mark.field("place").to_numpy()
                p, lo, hi = unpacked(places)
                for h, x, a, b in zip(hs, places.tolist(), (p - hi).tolist(), (p - lo + length).tolist(), strict=True):
                    for into, value in zip(kept, (h, k, th, x, text[a:b]), strict=True):
                        into.append(value)
                    if len(kept[0]) >= shard_windows:
                        yield built(*kept)
                        kept = ([], [], [], [], [])
        if kept[0]:
            yield built(*kept)
        release()

    return run


def _merge(length: int, short: int, gram: int, chunk_windows: int):
    """Merge the shards' transforms, whole groups at a time, and give the spans of repeated strings."""
    reach = short - gram
    lengths = [short] if short == length else [short, length]

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        k, th, place, size = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("k", "th", "place", "size"))
        sizes = table.column("place").combine_chunks().value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        p, _, hi = unpacked(place)
        first = reach - hi
        last = first + size
        columns = np.zeros((reach + length, len(place)), np.uint8)
        for bits, a, b in zip(table.column("columns").to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            top, low = int(first[a:b].min()), int(last[a:b].max())
            columns[top:low, a:b] = np.frombuffer(bits, np.uint8).reshape(low - top, b - a)
        group = np.repeat(table.column("h").to_numpy(), sizes)
        out = []
        for n, hit in zip(lengths, repeated(columns, group, np.repeat(np.arange(len(sizes)), sizes), first, last, lengths, reach), strict=True):
            edge = np.zeros((len(hit), hit.shape[1] + 2), np.int8)
            edge[:, 1:-1] = hit
            step = np.diff(edge, axis=1)
            i, a = np.nonzero(step == 1)
            _, b = np.nonzero(step == -1)  # offsets a .. b - 1 of anchor i
            out.append((k[i], th[i], p[i] - b + 1, p[i] - a + n, np.full(len(i), int(n == length))))
        columns_ = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays(columns_, names=["k", "th", "s", "e", "whole"]) if len(columns_[0]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        held = 0
        for batch in slices(batches, 256):
            kept.append(batch)
            held += len(batch.column(3).flatten())
            if held >= chunk_windows:
                table = pa.Table.from_batches(kept)
                h = table.column("h").to_numpy()
                cut = int(np.flatnonzero(h == h[-1])[0])  # the last group may go on
                if cut:
                    if (got := solve(table.slice(0, cut))) is not None:
                        yield got
                    kept = table.slice(cut).combine_chunks().to_batches()
                    held = sum(len(x.column(3).flatten()) for x in kept)
        if held and (got := solve(pa.Table.from_batches(kept))) is not None:
            yield got
        release()

    return run


def _narrowed(length: int, short: int, width: int):
    """Anchors of a group too large for one task, by ranges of ``width`` offsets: what all strings of a range share becomes the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("h", pa.int64()), ("place", pa.int64())])
        for batch in slices(batches, 64):
            rows: list[tuple[int, int, int, int]] = []
            keys: list[bytes] = []
            for k, th, text, marks in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3), strict=True
            ):
                for p, lo, hi in zip(*(x.tolist() for x in unpacked(marks.values.cast(kind).field("place").to_numpy())), strict=True):
                    for d in range(lo - lo % width, hi + 1, width):
                        a, b = max(lo, d), min(hi, d + width - 1)
                        core = text[p - d : p + short - (d + width - 1)]
                        rows.append((k, th, (p << 2 * D_BITS) | (a << D_BITS) | b, xxhash.xxh3_64_intdigest(core, d)))
                        keys.append(xxhash.xxh3_128_digest(text[p - b : p - a + length], (a << D_BITS) | b))
            if rows:
                k_, th_, place, h = zip(*rows, strict=True)
                u = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                columns = [pa.array(k_), pa.array(th_), pa.array(place), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(u[:, 0].copy()), pa.array(u[:, 1].copy())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.ones(len(rows), np.int64))], names=ANCHOR)

    return run


def repeated_spans(
    docs: DataFrame, length: int = 400, gram: int = 64, short: int | None = None, group_windows: int = 20_000, chunk_windows: int = 20_000
) -> DataFrame:
    """``(k, th, spans)`` of the documents ``(k, th, text)`` with a byte string that starts elsewhere too.

    A span is covered by such strings of ``length`` bytes where it is ``whole``, and by those of ``short`` bytes otherwise; an end
    beyond the text's stands for that.
    Anchors whose hash is unique are dropped. Anchors with equal windows are
    aggregated, within each text and before the shuffle: two or more of them settle each other, and one stands for them
    in the merge. So exact copies, however many, and periodic texts cost one row. The groups that are left are merged by sorted
    partitions, several groups in one pass and one group of at most ``group_windows`` windows in one task. Larger groups are
    narrowed first: windows are cut by ranges of offsets, and what all strings of a range share becomes the hash, in
    ranges of an eighth of ``short`` offsets, then 7, which go the same way, then single ones, where equal hashes are equal strings.
    """
    short = length if short is None else short
    if not gram < short <= length or short - gram >= 1 << D_BITS:
        raise ValueError(f"gram must be less than short, by less than {1 << D_BITS}, and short at most length")
    n = parallelism(docs.sparkSession)
    schema = ", ".join(f"{c} long" for c in ANCHOR)
    found = written(docs.mapInArrow(_anchor_rows(length, short, gram), schema))
    spans = found.where("h is null").select("k", "th", F.col("place").alias("s"), F.col("u1").alias("e"), F.col("u2").alias("whole"))
    rows = found.where("h is not null")
    mask = (1 << D_BITS) - 1
    p, lo, hi = F.shiftright("place", 2 * D_BITS), F.shiftright("place", D_BITS).bitwiseAND(F.lit(mask)), F.col("place").bitwiseAND(F.lit(mask))
    ends = F.array(*[F.struct((p - lo + m).alias("e"), F.lit(int(m == length)).cast("long").alias("whole")) for m in sorted({short, length})])

    def covered(anchors: DataFrame, both: bool) -> DataFrame:
        """All that an anchor's strings cover, of the short length alone or of both."""
        kinds = ends if both else F.slice(ends, 1, 1)
        return anchors.select("k", "th", (p - hi).alias("s"), F.explode(kinds).alias("x")).select("k", "th", "s", "x.e", "x.whole")

    for width in (max(1, short // 8), min(7, max(1, short // 8)), 1, None):
        # what is joined back by a key that may be frequent is written first: then both sides are plain shuffles, which Spark can split
        often = written(rows.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1").select("h"))
        rows = written(rows.join(often, "h"))
        units = written(rows.groupBy("h", "u1", "u2").agg(F.sum("times").alias("n"), F.min(F.struct("k", "th", "place")).alias("at")))
        spans = spans.union(covered(rows.join(units.where("n > 1").select("h", "u1", "u2"), ["h", "u1", "u2"]), True))
        kinds = written(units.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
        if width is None:  # a hash is that of one string now, and windows that differ share no longer one
            spans = spans.union(covered(units.join(kinds, "h").select("at.*"), False))
            break
        open_ = written(units.join(kinds, "h").select("h", "at.*", (F.col("kinds") > group_windows).alias("large")))
        merged = _marked(docs, open_.where(~F.col("large"))).mapInArrow(_shards(length, short, gram), SHARD)
        spans = spans.union(merged.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_merge(length, short, gram, chunk_windows), SPAN))
        if not kinds.where(F.col("kinds") > group_windows).limit(1).count():
            break
        rows = written(_marked(docs, open_.where("large")).mapInArrow(_narrowed(length, short, width), schema))
    return spans.groupBy("k", "th").agg(F.collect_set(F.struct("s", "e", "whole")).alias("spans"))


def _marked(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Texts with their anchors."""
    marks = anchors.groupBy("k", "th").agg(F.collect_list(F.struct("h", "place")).alias("marks"))
    return docs.join(marks.hint("shuffle_hash"), ["k", "th"]).select("k", "th", "text", "marks")


def merged_spans(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans as maximal runs; spans that touch are one run."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(new)
    return list(zip(s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist(), strict=True))


def _cut(digest: bool, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kind = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("whole", pa.int64())])
        for batch in slices(batches):
            sizes, cuts, passages, kept = [], [], [], []
            for text, spans in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3), strict=True):
                runs, short = [], []
                if spans.values is not None and len(spans.values):
                    both = spans.values.cast(kind)
                    s, e, whole = (both.field(x).to_numpy() for x in ("s", "e", "whole"))
                    e = np.minimum(e, len(text))
                    full = (whole == 1) & (e - s >= length)
                    runs = merged_spans(s[full], e[full]) if full.any() else []
                    some = full | (whole == 0)
                    short = merged_spans(s[some], e[some]) if some.any() else []
                at, parts = 0, []
                for s, e in runs:
                    parts.append(text[at:s])
                    at = e
                parts.append(text[at:])
                rest = b"".join(parts)
                sizes.append(len(text))
                cuts.append([{"start": s, "end": e} for s, e in runs])
                passages.append([{"start": s, "end": e} for s, e in short])
                kept.append(hashlib.sha256(rest).hexdigest().encode() if digest else rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(cuts, span_type), pa.array(passages, span_type), pa.array(kept, pa.binary())],
                names=["k", "th", "n_bytes", "spans", "passages", "kept"],
            )
        release()

    return run


def remove_repeats(
    docs: DataFrame, length: int = 400, gram: int = 64, digest: bool = False, short: int | None = None, group_windows: int = 20_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that starts anywhere else too, the same document included.

    Returns ``doc_id, n_bytes, spans, passages, kept``, one row a document row: the removed maximal runs of the UTF-8 bytes,
    those that strings of ``short`` bytes cover which start elsewhere (they stay; without ``short`` they are the same runs), and
    the remaining bytes (which may split a character, so they are binary), or with ``digest`` their SHA-256. Strings
    are judged on the input and do not cross documents. Null and empty texts and those under ``length``
    bytes keep all; texts of any length are searched whole, a segment at a time; ids may be null or repeated; rows repeated as a whole repeat each other's
    strings; an empty table gives an empty result; other columns are not read.
    """
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID).cast("long")).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).select("k", F.xxhash64("text").alias("th"), "text")
    spans = repeated_spans(base, length, gram, short, group_windows)
    met = base.join(spans.hint("shuffle_hash"), ["k", "th"], "left").select("k", "th", "text", "spans")
    runs = "array<struct<start:long,end:long>>"
    done = met.mapInArrow(_cut(digest, length), f"k long, th long, n_bytes long, spans {runs}, passages {runs}, kept binary")
    return done.select(F.when(F.col("k") != NULL_ID, F.col("k")).alias("doc_id"), "n_bytes", "spans", "passages", "kept")
