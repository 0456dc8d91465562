"""Benchmark decontamination by winnowed word fingerprints (operator 6, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
POS_BITS = 28
POS_MASK = (1 << POS_BITS) - 1


def words(text: Column) -> Column:
    """Words of a text: maximal runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def _fingerprints(df: DataFrame, k: int, window: int) -> DataFrame:
    """Add ``marks``: key (hash), position and the words around of the distinct winnowed k-grams of column ``words``.

    Each run of ``window`` words holds ``window - k + 1`` k-grams; its smallest, the leftmost of
    equals, is kept. Two texts that share a run keep the same k-gram of it. The words around are cut here, before
    marks become rows, so that no row carries a whole text.
    """
    n = F.size("words")
    grams = F.transform(
        F.sequence(F.lit(0), n - k),
        lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*[F.col("words")[i + j] for j in range(k)]), POS_BITS + 1), POS_BITS)
        .bitwiseOR(i.cast("long")),
    )
    none = F.array().cast("array<bigint>")
    packed = df.withColumn("_grams", F.when(n >= window, grams).otherwise(none))
    least = F.transform(
        F.sequence(F.lit(0), n - window), lambda s: F.least(*[F.col("_grams")[s + j] for j in range(window - k + 1)])
    )
    packed = packed.withColumn("_fps", F.when(n >= window, F.array_distinct(least)).otherwise(none))

    def mark(fp: Column) -> Column:
        pos = fp.bitwiseAND(F.lit(POS_MASK)).cast("int")
        around = F.slice("words", F.greatest(pos - (window - k), F.lit(0)) + 1, F.lit(2 * (window - k) + k))
        return F.struct(F.shiftright(fp, POS_BITS).alias("key"), pos.alias("pos"), around.alias("context"))

    return packed.withColumn("marks", F.transform("_fps", mark)).drop("_grams", "_fps")


def _starts(k: int, window: int) -> Column:
    """Starts of the windows around a shared k-gram in which document and item agree on every word."""
    lead, item_lead = F.least(F.col("pos"), F.lit(window - k)), F.least(F.col("item_pos"), F.lit(window - k))

    def agrees(o: Column) -> Column:
        return (
            (o <= lead)
            & (o <= item_lead)
            & (item_lead - o + window <= F.size("item_context"))
            & (lead - o + window <= F.size("context"))
            & (F.slice("context", lead - o + 1, window) == F.slice("item_context", item_lead - o + 1, window))
        )

    offsets = F.array(*[F.lit(o) for o in range(window - k + 1)])
    return F.transform(F.filter(offsets, agrees), lambda o: (F.col("pos") - o) * window + (window - 1))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 8,
    k: int = 4,
    broadcast_rows: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Benchmark passages in documents: ``doc_id, th, n_words, hit_positions, item_ids``, one row a document row.

    ``th`` is xxhash64 of the text.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window of its
    own length. Every word inside an occurrence of a window is a hit; ``item_ids`` are the sorted
    distinct ids of the items with an occurrence. Documents and items keep the smallest k-gram hash
    of each window, the kept hashes are joined, and each hit is extended to the windows around it, whose
    words are compared, so a shared window is never missed and a hash collision never counts.
    The item side is broadcast if it has at most ``broadcast_rows`` fingerprints (they are counted first), each with the
    few words around it, so that a long item adds no more than its fingerprints; beyond that the same join is left to
    shuffle. Texts of any length are read whole; their rows carry a window's surroundings, not the text.

    Null and empty texts have no words; a null item id is not listed; repeated rows count each; an
    empty benchmark leaves every document clean; an empty document table gives an empty result.
    Other columns of either table are not read.
    """
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("words"))
    small = items.select(
        F.count(F.when((F.size("words") > 0) & (F.size("words") < window), 1)).alias("short"),
        F.sum(F.greatest(F.size("words") - window + 1, F.lit(0)).cast("long")).alias("most"),
    ).first()
    fits = (small.most or 0) + small.short <= broadcast_rows
    # an inner explode would have its filter pushed below, with all it stands on
    item_fps = _fingerprints(items.where(F.size("words") >= window), k, window).select("item_id", F.explode_outer("marks").alias("m"))
    item_fps = item_fps.select("item_id", "m.key", F.col("m.pos").alias("item_pos"), F.col("m.context").alias("item_context"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), words(F.col(text_col)).alias("words"))
    base = base.withColumn("_row", F.monotonically_increasing_id()).withColumn("n_words", F.size("words").cast("long"))
    spread = _fingerprints(base, k, window).select("_row", "doc_id", "th", "n_words", F.posexplode_outer("marks").alias("_nth", "m"))
    spread = spread.select("_row", "doc_id", "th", "n_words", F.coalesce(F.col("_nth") == 0, F.lit(True)).alias("_one"), "m.key", "m.pos", "m.context")
    met = spread.join(F.broadcast(item_fps) if fits else item_fps, "key", "left").where(F.col("item_pos").isNotNull() | F.col("_one"))
    none = F.array().cast("array<int>")
    found = met.select(
        "_row", "doc_id", "th", "n_words", "item_id", F.when(F.col("item_pos").isNotNull(), _starts(k, window)).otherwise(none).alias("starts")
    )
    if small.short:  # an item of fewer words than a window: compared at each occurrence of its first word
        short = items.where((F.size("words") > 0) & (F.size("words") < window)).select(
            "item_id", F.col("words").alias("item_words"), F.col("words")[0].alias("word")
        )
        size = F.size("item_words")
        cells = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"), F.slice("words", i + 1, F.lit(window - 1)).alias("here")))
        cells = base.select("_row", "doc_id", "th", "n_words", F.explode(cells).alias("c")).select("_row", "doc_id", "th", "n_words", "c.*")
        cells = cells.join(F.broadcast(short) if fits else short, "word").where(F.slice("here", F.lit(1), size) == F.col("item_words"))
        found = found.unionByName(
            cells.select("_row", "doc_id", "th", "n_words", "item_id", F.array(F.col("pos") * window + (size - 1)).alias("starts"))
        )
    cover = F.transform(
        F.array_distinct(F.flatten("_starts")),
        lambda x: F.sequence(F.floor(x / window).cast("int"), F.floor(x / window).cast("int") + x % window),
    )
    grouped = found.groupBy("_row", "doc_id", "th", "n_words").agg(
        F.collect_list("starts").alias("_starts"),
        F.collect_set(F.when(F.size("starts") > 0, F.col("item_id").cast("string"))).alias("_items"),
    )
    return grouped.select(
        "doc_id",
        "th",
        "n_words",
        F.array_sort(F.array_distinct(F.flatten(cover))).alias("hit_positions"),
        F.array_sort("_items").alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, found: DataFrame, least_items: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with passages of fewer than ``least_items`` benchmark items; columns stay as they are.

    A row is known by its id, which may be null, and its text's hash, so rows repeated as a whole stay or go together and rows
    of one id with different texts are judged apart. A null text, and any table without findings, stays whole;
    an empty table gives an empty result.
    """
    key, hashed = (free(c, docs.columns) for c in ("_gone_id", "_gone_th"))
    gone = found.where(F.size("item_ids") >= least_items).select(F.col("doc_id").alias(key), F.col("th").alias(hashed)).distinct()
    same = docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(hashed))
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")
