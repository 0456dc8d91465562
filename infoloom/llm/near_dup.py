"""Near-duplicate detection by tensored MinHash banding and exact verification (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free, parallelism, slices, written
from .graph import connected_components

SEED = 7
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle.

    Words are runs without ASCII white space, A-Z lower-cased.
    """
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(shingle, n)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashed[j : n - size + 1 + j])
    return np.unique(out)


class Banding:
    """Two collections of ``groups`` MinHash groups with ``rows`` hashes each.

    A table key pairs one group of either collection, so ``groups ** 2`` tables of ``2 * rows`` hashes
    each come from ``2 * groups * rows`` hashes.
    """

    def __init__(self, groups: int, rows: int) -> None:
        self.groups, self.rows = groups, rows
        rng = np.random.default_rng(SEED)
        n = 2 * groups * rows
        self.factors = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.masks = rng.integers(0, 2**63, n, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Group values of both collections, the first collection's first."""
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for s in range(0, len(shingles), 1 << 15):
            block = (shingles[None, s : s + (1 << 15)] ^ self.masks[:, None]) * self.factors[:, None]
            np.minimum(least, block.min(axis=1), out=least)
        grouped = mixed(least).reshape(2 * self.groups, self.rows)
        out = np.arange(2 * self.groups, dtype=np.uint64)
        for j in range(self.rows):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, j])
        return out


def _signatures(shingle: int, groups: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        banding = Banding(groups, rows)
        for batch in slices(batches):
            sizes, sigs, values = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(text, shingle)
                sizes.append(len(s))
                sigs.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                values.append(banding.signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(sigs, np.uint64).view(np.int64)),
                    pa.array([None if v is None else v.view(np.int64) for v in values], pa.list_(pa.int64())),
                ],
                names=["doc_id", "th", "n_shingles", "sig", "minhash"],
            )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(sets, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:-1], "shingles"],
            )

    return run


def star_forest(sets: list[np.ndarray], percent: int, root: np.ndarray | None = None) -> np.ndarray:
    """Component roots of sets linked where ``100 * intersection >= percent * union``, over given roots if any.

    Every pair that is not yet in one component is compared, so no link between components is missed. Sets whose
    shingles are the most shared lead, which soon joins a family around its middle and leaves few pairs.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    shared = np.bincount(flat, minlength=len(kinds))
    lead = np.add.reduceat(shared[flat], begins) / sizes
    root = np.arange(n) if root is None else root.copy()
    mark = np.zeros(len(kinds), bool)
    done = np.zeros(n, bool)
    for u in np.argsort(-lead, kind="stable"):
        done[u] = True
        # pairs with an earlier leader are settled: it was compared with u unless they already were joined
        rest = np.flatnonzero(~done & (root != root[u]) & (100 * np.minimum(sizes, sizes[u]) >= percent * np.maximum(sizes, sizes[u])))
        if not len(rest):
            continue
        mine = flat[begins[u] : ends[u]]
        mark[mine] = True
        width = sizes[rest]
        offsets = np.cumsum(width) - width
        at = np.arange(width.sum()) - np.repeat(offsets, width) + np.repeat(begins[rest], width)
        met = np.add.reduceat(mark[flat[at]].astype(np.int64), offsets)
        mark[mine] = False
        linked = rest[100 * met >= percent * (sizes[u] + width - met)]
        if len(linked):
            old = np.unique(np.append(root[linked], root[u]))
            root[np.isin(root, old)] = old.min()
    return root


LINK = "u long, v long"


def _verify_heads(percent: int):
    """Compare members with their head: sorted rows ``head, salt, sig, shingles``, the head's own set the first of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead = None, np.zeros(0, np.uint64)
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True))
            sig, lists = batch.column(3).to_pylist(), batch.column(4)
            found = []
            for i, k in enumerate(keys):
                own = lists[i].values.to_numpy().view(np.uint64)
                if k != key:
                    key, lead = k, own
                elif sig[i] != k[0] and 100 * min(len(own), len(lead)) >= percent * max(len(own), len(lead)):
                    at = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
                    met = int((lead[at] == own).sum())
                    if 100 * met >= percent * (len(lead) + len(own) - met):
                        found.append((sig[i], k[0]))
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _verify(percent: int):
    """Solve one block pair of one cluster after the other, and give the components that it joins; only one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sigs, parts, sets = None, [], [], []

        def solve() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                _, first, part = np.unique(np.array(parts, np.int64), return_index=True, return_inverse=True)
                root = star_forest(sets, percent, first[part])
                ids, away = np.array(parts, np.int64), root != first[part]
                if away.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique([ids[away], ids[root[away]]], axis=1)], names=["u", "v"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            sig, part, lists = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
            for i, k in enumerate(keys):
                if k != key:
                    yield from solve()
                    key, sigs, parts, sets = k, [], [], []
                elif sig[i] == sigs[-1]:
                    continue  # the same row again
                sigs.append(sig[i])
                parts.append(part[i])
                sets.append(lists[i].values.to_numpy().view(np.uint64))
        yield from solve()

    return run


def moved(rows: DataFrame, key: str, roots: DataFrame, out: str) -> DataFrame:
    """The rows with the root of a key's component; a key without a row of its own is its own root."""
    return rows.join(roots.select(F.col("node").alias(key), F.col("root").alias(out)), key, "left").withColumn(out, F.coalesce(out, key))


def _tables(nodes: DataFrame, groups: int, spent: list[DataFrame]) -> DataFrame:
    """``(sig, key, weight)`` of the tables that hold several sets; the weight tells how common a set's group values are.

    A group value that no other set has cannot make a common table key, so such values go before pairs of values are formed.
    """
    values = nodes.select("sig", F.posexplode("minhash").alias("g", "h"))
    # written before it is joined back: then both sides are plain shuffles, which Spark can split where a value is frequent
    met = written(values.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    spent.append(met)
    left = values.join(met, ["g", "h"]).groupBy("sig").agg(
        F.sum("n").alias("weight"),
        F.collect_list(F.when(F.col("g") < groups, F.struct("g", "h"))).alias("a"),
        F.collect_list(F.when(F.col("g") >= groups, F.struct("g", "h"))).alias("b"),
    )
    tables = left.select("sig", "weight", "b", F.explode("a").alias("x")).select("sig", "weight", "x", F.explode("b").alias("y"))
    return tables.select("sig", F.xxhash64("x.g", "x.h", "y.g", "y.h").alias("key"), "weight")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    groups: int = 16,
    rows: int = 4,
    head_rows: int = 256,
    block_shingles: int = 250_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard likeness of ``percent`` or more.

    Returns ``doc_id, th, n_shingles, component, component_id``, one row a document row; ``th`` is xxhash64 of the text,
    ``component`` a key of its own for each component (null without shingles) and ``component_id`` its smallest document id. With 16 groups of 4 hashes in each of two collections, 128 hashes make
    256 tables, and a pair at 0.8 exactly meets in one with probability 0.9996, a closer one more surely.

    Equal sets are one node from the start. Candidates are verified before anything is closed over them. Each table has a head,
    the set whose group values are the most common, which in a family of near copies is the one in its middle. A set is
    compared in full with the most common of its heads first, in tasks of ``head_rows`` sets, and components are formed of true
    links alone. What then is left are tables that hold several components: only their sets go on, in clusters of
    components that share a table, and of these all pairs are compared that are not in one component. A cluster
    with more than ``block_shingles`` shingles is cut into blocks, and each pair of blocks is a task of its own, so no task grows with a group.

    Null texts and texts without words have no shingles and are linked with nothing. A null id is smaller in no
    component and is kept only alone. Rows of one id with different texts are different nodes; very long texts are hashed
    whole, a slice of their shingles at a time; an empty table gives an empty result; other columns are not read.
    """
    n = parallelism(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    signed = written(
        slim.mapInArrow(_signatures(shingle, groups, rows), f"doc_id {id_type}, th long, n_shingles long, sig long, minhash array<long>")
    )
    nodes = (
        signed.where("n_shingles > 0")
        .groupBy("sig")
        .agg(F.min(F.struct("doc_id", "th")).alias("at"), F.max("n_shingles").alias("n_shingles"), F.max("minhash").alias("minhash"))
    )
    spent: list[DataFrame] = []
    tables = written(_tables(nodes, groups, spent))
    heads = written(
        tables.groupBy("key")
        .agg(F.max(F.struct("weight", "sig")).alias("head"), F.min("sig").alias("_first"), F.max("sig").alias("_last"))
        .where("_first < _last")
        .select("key", "head")
    )
    stars = written(tables.join(heads, "key").groupBy("sig").agg(F.max("head").alias("head")).select("sig", F.col("head.sig").alias("head")))
    # one row of each candidate brings its text; the id may be null
    member = stars.join(nodes.select("sig", "at", "n_shingles"), "sig").select("at.doc_id", "at.th", "sig")
    texts = slim.join(member.hint("shuffle_hash"), slim.doc_id.eqNullSafe(member.doc_id) & (slim.th == member.th))
    sets = written(texts.select("sig", "text").mapInArrow(_sets(shingle), "sig long, shingles array<long>"))
    spread = written(stars.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / head_rows).cast("int").alias("salts")))
    ours = stars.where("sig != head").join(spread, "head").select("sig", "head", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("salts")).cast("int").alias("salt"))
    ours = ours.select("sig", "head", "salt", F.lit(1).alias("late"))
    lead = spread.select(F.col("head").alias("sig"), "head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("late"))
    rows_ = ours.union(lead).join(sets, "sig").select("head", "salt", "late", "sig", "shingles")
    rows_ = rows_.repartition(n, "head", "salt").sortWithinPartitions("head", "salt", "late")
    links = written(rows_.mapInArrow(_verify_heads(percent), LINK))
    first_parts = connected_components(links)
    placed = written(moved(stars.select("sig"), "sig", first_parts, "part"))
    # tables with several components: their sets go on
    held = tables.join(placed, "sig").select("key", "sig", "part")
    several = written(held.groupBy("key").agg(F.min("part").alias("v"), F.max("part").alias("_last")).where("v < _last").select("key", "v"))
    open_ = written(held.join(several, "key").select("sig", "part", "v").distinct())
    clusters = connected_components(open_.select(F.col("part").alias("u"), "v").distinct())
    inside = moved(open_.select("sig", "part").distinct(), "part", clusters, "cluster").join(nodes.select("sig", "n_shingles"), "sig")
    inside = written(inside.select("sig", "part", "cluster", "n_shingles"))
    cuts = written(inside.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("cuts")))
    inside = inside.join(cuts, "cluster").select("cluster", "cuts", "sig", "part", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("cuts")).cast("int").alias("block"))
    pairs = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    pairs = pairs.select("sig", "part", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(sets, "sig")
    pairs = pairs.select("cluster", "i", "j", "sig", "part", "shingles").repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "sig")
    joined = connected_components(pairs.mapInArrow(_verify(percent), LINK))
    ids = signed.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"))
    named = ids.join(placed, "sig", "left").select("sig", "first_id", F.coalesce("part", "sig").alias("part"))
    named = written(moved(named, "part", joined, "root").select("sig", "first_id", "root"))
    smallest = written(named.groupBy("root").agg(F.min("first_id").alias("component_id")))
    # what follows reads these two and the signatures alone
    discard(*spent, tables, heads, stars, sets, spread, links, first_parts, placed, several, open_, clusters, inside, cuts, joined)
    names = named.join(smallest, "root").select("sig", F.col("root").alias("component"), "component_id")
    full = signed.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("sig")).alias("sig"))
    out = full.join(names, "sig", "left")
    return out.select(
        "doc_id", "th", "n_shingles", "component", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that :func:`near_duplicates` links to another one; columns stay as they are.

    A null or repeated id names rows together with the text's hash. Of each component one row stays: of its smallest id, and of rows that share it, that of the smallest text
    hash. Rows without shingles are linked with nothing and all stay.
    """
    key, hashed, once = (free(c, docs.columns) for c in ("_keep_id", "_keep_th", "_once"))
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("at")).select("at.*")
    lone = found.where("n_shingles = 0").select("doc_id", "th").distinct()
    stay = first.withColumn(once, F.lit(True)).union(lone.withColumn(once, F.lit(False)))
    stay = stay.withColumnsRenamed({"doc_id": key, "th": hashed})
    met = docs.join(stay.hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(hashed)))
    repeats = found.where("n_shingles > 0").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeats.limit(1).count():  # whole rows that repeat: one of each is enough
        met = met.where(once).dropDuplicates([key, hashed]).union(met.where(~F.col(once)))
    return met.select(*docs.columns)
