"""Threshold-scaled shingle sketches of documents (operator 4, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .sharding import prefix_sums

NULL_ID = -(2**63)
HASH_BITS = 32


def with_sketch(df: DataFrame, text_col: str, out: str, shingle: int = 5, scale: int = 4) -> DataFrame:
    """Add ``out``: the sorted 32-bit hashes below ``2**32 / scale`` of a text's word shingles, and ``out + "_least"``: the smallest of all.

    A text of fewer than ``shingle`` words is one shingle; one without words has no hashes and a null smallest one.
    Whether a hash is kept depends on the hash alone, so the union of two texts' sketches is the sketch of the union of their
    shingle sets. (Shingles over a joint belong to neither of two parts of a text.) The smallest hash may lie
    above the threshold; it tells short texts apart, whose sketch may be empty, and merges by taking the smaller.
    """
    spaced = F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+")
    n = F.size("_words")

    def top(h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - HASH_BITS)

    hashes = F.transform(
        F.sequence(F.lit(0), n - shingle), lambda i: top(F.xxhash64(*[F.col("_words")[i + j] for j in range(shingle)]))
    )
    short = F.array(top(F.xxhash64(F.array_join("_words", " "))))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_words", F.array_remove(spaced, ""))
    df = df.withColumn("_hashes", F.when(n >= shingle, hashes).when(n > 0, short).otherwise(none))
    kept = F.array_sort(F.array_distinct(F.filter("_hashes", lambda h: h < 2**HASH_BITS // scale)))
    return df.withColumn(out, kept).withColumn(f"{out}_least", F.array_min("_hashes")).drop("_words", "_hashes")


def fingerprint(sketch: Column, least: Column) -> Column:
    """A sketch with the smallest hash, so that only a text without words has an empty one."""
    return F.when(least.isNull() | F.array_contains(sketch, least), sketch).otherwise(F.array(least))


def as_text(sketch: Column) -> Column:
    """A sketch as a string of 8 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches; 1 for two empty ones."""
    met = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - met
    return F.when(union > 0, met / union).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimate of the share of ``a`` that is in ``b``, for documents of very unequal lengths; 1 for an empty ``a``."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def sketch_and_edit(docs: DataFrame, shingle: int = 5, scale: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketch each document, its next neighbour by id and its edited text.

    The edited text has its last quarter of code points (rounded down) replaced by as many first ones of the
    next document, or all if it is shorter; the first document follows the last. Returns ``doc_id, text,
    edited`` and ``sketch, edited_sketch, next_sketch``, each with its ``_least``, one row a document row.

    Only ids and lengths are ordered globally. Texts move once, by their own key; what the next document sends
    back is its first characters and its sketch. A null text counts as empty, a null id as the smallest.
    Rows of one id are ordered by text hash, and identical rows count as one document and all get its result.
    A single document follows itself; an empty table gives an empty result; other columns are not read.
    """
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID).cast("long")).alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("_th", F.xxhash64("text"))
    slim = base.groupBy("_k", "_th").agg(F.max(F.char_length("text")).alias("_n"))
    ranked = prefix_sums(slim, ["_k", "_th"], "_n").select("_k", "_th", "_n", "row_no")
    total = ranked.agg((F.max("row_no") + 1).alias("_all"))
    behind = ranked.select(F.col("_k").alias("_prev_k"), F.col("_th").alias("_prev_th"), F.floor(F.col("_n") / 4).cast("int").alias("_want"), F.col("row_no").alias("_prev"))
    before = ranked.join(F.broadcast(total)).select("_k", "_th", F.pmod(F.col("row_no") - 1, F.col("_all")).alias("_prev"))
    links = before.join(behind, "_prev").drop("_prev")
    base = with_sketch(base, "text", "sketch", shingle, scale)
    sent = base.join(links.hint("shuffle_hash"), ["_k", "_th"]).select(
        F.col("_prev_k").alias("_k"),
        F.col("_prev_th").alias("_th"),
        F.substring(F.col("text"), F.lit(1), F.col("_want")).alias("_head"),
        F.col("sketch").alias("next_sketch"),
        F.col("sketch_least").alias("next_sketch_least"),
    )
    sent = sent.groupBy("_k", "_th").agg(*(F.first(c).alias(c) for c in ("_head", "next_sketch", "next_sketch_least")))
    both = base.join(sent.hint("shuffle_hash"), ["_k", "_th"])
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("_head"))
    both = with_sketch(both.withColumn("edited", edited), "edited", "edited_sketch", shingle, scale)
    sketches = [f"{c}{end}" for c in ("sketch", "edited_sketch", "next_sketch") for end in ("", "_least")]
    return both.select(F.when(F.col("_k") != NULL_ID, F.col("_k")).alias("doc_id"), "text", "edited", *sketches)
