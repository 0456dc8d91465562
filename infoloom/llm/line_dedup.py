"""Exact line deduplication over a range-partitioned line index (operator 9)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free, parallelism, slices

SPACE = b" \t\n\x0b\x0c\r"
INDEX = "h1 long, h2 long, doc_id long, th long, pos int"


def line_key(line: bytes) -> bytes:
    """A line's key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    if len(key) < least:
        return False
    return len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least


def _index(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, ths = batch.column(0), batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            known = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
            lanes: list[bytes] = []
            rows: list[int] = []
            places: list[int] = []
            for i, body in enumerate(texts):
                if not body:
                    continue
                for pos, line in enumerate(body.lower().split(b"\n")):
                    key = line.strip(SPACE)
                    if _long_enough(key, min_chars):
                        lanes.append(xxhash.xxh3_128_digest(key))
                        rows.append(i)
                        places.append(pos)
            if lanes:
                h = np.frombuffer(b"".join(lanes), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(known[rows]), pa.array(ths[rows]), pa.array(np.array(places, np.int32))],
                    names=["h1", "h2", "doc_id", "th", "pos"],
                )

    return run


def _stream(carry: dict[int, tuple[int, int, int]]):
    """First occurrences of each hash, streamed in sorted order; later documents' lines are dropped.

    ``carry`` holds, for a partition whose first hash began in an earlier one, that hash and its first document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first_doc, started = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            part, h1, h2, doc, th, pos = (batch.column(k).to_numpy() for k in range(6))
            if not started and int(part[0]) in carry:
                a, b, first_doc = carry[int(part[0])]
                last = (a, b)
            started = True
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if last is not None and (int(h1[0]), int(h2[0])) == last:
                new[0] = False
                firsts = np.concatenate([[first_doc], doc[new]])
                group = np.cumsum(new)
            else:
                firsts, group = doc[new], np.cumsum(new) - 1
            origin = firsts[group]
            last, first_doc = (int(h1[-1]), int(h2[-1])), int(origin[-1])
            gone = doc != origin
            if gone.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[gone]), pa.array(th[gone]), pa.array(pos[gone])], names=["doc_id", "th", "pos"]
                )

    return run


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compressed keep bitmaps ``(doc_id, th, bitmap)`` of the documents that lose a line.

    The line index ``(128-bit hash, document, position)`` is range-partitioned by all of its
    columns, so that one hash with a third of all lines still spreads over partitions, and sorted inside each.
    A partition reports its last hash and where that hash began (one row a partition); from these the
    next partition knows the first document of a hash that it continues. A bitmap is the zlib-packed
    bit array of kept lines; documents without a row here keep everything. ``th`` is xxhash64 of the
    text: with ``doc_id`` it identifies a row; ids are nullable, and null counts as the smallest id.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    index = slim.mapInArrow(_index(min_chars), INDEX)
    order = ["h1", "h2", "doc_id", "th", "pos"]
    placed = checkpointed(
        index.repartitionByRange(parallelism(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    ends = placed.groupBy("part").agg(
        F.min(F.struct("h1", "h2", "doc_id")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")
    )
    tails = placed.join(F.broadcast(ends.select("part", "hi")), "part").where(
        (F.col("h1") == F.col("hi.h1")) & (F.col("h2") == F.col("hi.h2"))
    )
    tails = tails.groupBy("part").agg(F.min("doc_id").alias("first_doc"))
    carry: dict[int, tuple[int, int, int]] = {}
    previous: tuple[tuple[int, int], int] | None = None
    for r in ends.join(tails, "part").orderBy("part").collect():  # one row a partition
        begin, end = (r.lo.h1, r.lo.h2), (r.hi.h1, r.hi.h2)
        first = r.first_doc
        if previous and previous[0] == begin:
            carry[r.part] = (*begin, previous[1])
            if begin == end:
                first = previous[1]
        previous = (end, first)
    dropped = placed.select("part", *order).mapInArrow(_stream(carry), "doc_id long, th long, pos int")
    gathered = dropped.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    return gathered.mapInArrow(_pack, "doc_id long, th long, bitmap binary")


def pack_bitmap(gone: np.ndarray) -> bytes:
    """A compressed bitmap with a 0 for every dropped line up to the last one; lines beyond it are kept."""
    keep = np.ones((int(gone.max()) // 8 + 1) * 8, np.uint8)
    keep[gone] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def kept_lines(lines: list[bytes], bitmap: bytes | None) -> list[bytes]:
    """The lines that a bitmap keeps."""
    if bitmap is None:
        return lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    return [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = batch.column(2)
        maps = [pack_bitmap(gone[i].values.to_numpy()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc_id", "th", "bitmap"])


def _apply(digest: bool, names: list[str], out: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, maps = batch.column(len(names)).cast(pa.binary()).to_pylist(), batch.column(len(names) + 1).to_pylist()
            kept, totals, lost = [], [], []
            for text, bitmap in zip(texts, maps, strict=True):
                lines = (text or b"").split(b"\n")
                left = kept_lines(lines, bitmap)
                totals.append(len(lines))
                lost.append(len(lines) - len(left))
                if digest:
                    kept.append(hashlib.sha256(b"\n".join(left)).hexdigest())
                elif text is None:
                    kept.append(None)
                else:
                    kept.append(b"\n".join(left).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(totals, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())],
                names=[*names, *out],
            )

    return run


OUT = ("n_lines", "n_dropped", "kept")


def dedup_lines(
    docs: DataFrame, min_chars: int = 10, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", out: Sequence[str] = OUT
) -> DataFrame:
    """Apply the keep bitmaps: the columns of ``docs`` except the text, then ``n_lines, n_dropped, kept`` (or the names ``out``).

    A line goes if its key has at least ``min_chars`` code points and a document with a smaller id
    holds the key too; the smallest such document keeps all its lines with it. ``kept`` is the remaining text,
    or its SHA-256 with ``digest``. A null text has one empty line and stays null; an empty text stays
    empty. Rows with the same id are one document; identical rows get identical results. An empty
    table gives an empty result. Other columns pass through, and the last three replace columns of the same names.
    """
    maps = keep_bitmaps(docs, min_chars, id_col, text_col)
    passed = [c for c in docs.columns if c not in (text_col, *out)]
    text, key, hashed, bitmap = (free(f"_line_{c}", docs.columns) for c in ("text", "id", "th", "bitmap"))
    keyed = docs.select(
        *passed,
        F.col(text_col).alias(text),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias(key),
        F.xxhash64(text_col).alias(hashed),
    )
    right = maps.select(F.col("doc_id").alias(key), F.col("th").alias(hashed), F.col("bitmap").alias(bitmap))
    joined = keyed.join(right.hint("shuffle_hash"), [key, hashed], "left")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in passed)
    return joined.select(*passed, text, bitmap).mapInArrow(_apply(digest, passed, out), f"{schema}`{out[0]}` long, `{out[1]}` long, `{out[2]}` string")
