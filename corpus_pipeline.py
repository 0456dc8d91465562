"""A training corpus from raw documents: five stages, each a pass of one text operator over all that its predecessor kept.

All stages hold to the same: ids may be null or repeated, and rows are then told apart by their text; a row repeated as a whole is
judged as its copies are; columns beyond those of ``documents`` pass through, whatever their names, up to the last stage; texts of any
length are read whole; and an empty table gives an empty result. Each docstring adds what null and empty texts and ties give.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from infoloom.llm import decontaminate, language, line_dedup, near_dup, pieces
from infoloom.llm.common import free, table, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Cosine under which a text, however short, is in none of the known languages.
LEAST_SCORE = 0.02
#: Chance that the best cosine of a text in none of the known languages exceeds the noise, were its cosines independent.
CHANCE = 0.01
#: Share of labelled texts of about one length that may lie under the cut for it.
SPREAD = 0.001
#: Segmentations of a document, as many as op1 draws: with one alone nothing would be drawn without replacement.
SAMPLES = 3


def size_class() -> Column:
    """Texts of about one length: the binary digits of the number of characters."""
    return F.length(F.bin(F.char_length("text").cast("long"))).cast("int")


def least_scores(docs: DataFrame, model: language.Prototypes) -> list[float]:
    """The cut for each of the size classes 0 to 32.

    It is the cosine that noise of standard deviation ``1 / sqrt(DIM)`` exceeds with ``CHANCE`` in the best of the languages (0.124 for
    four), or less where labelled texts of that size lie lower, as short ones do. A class without labelled texts has
    the cut of the next shorter one that has some. One row a class goes to the driver.
    """
    noise = NormalDist().inv_cdf(1 - CHANCE / max(1, len(model.langs))) / language.DIM**0.5
    known = language.predict(docs.where(F.col("lang").isNotNull()).select("text"), model).where(F.col("lang_pred") != "und")
    low = known.groupBy(size_class().alias("c")).agg(F.percentile_approx("lang_score", SPREAD, 100_000).alias("q"))
    seen = {r.c: r.q for r in low.collect()}
    cuts, last = [], LEAST_SCORE
    for c in range(33):
        last = max(LEAST_SCORE, min(noise, seen[c])) if c in seen else last
        cuts.append(last)
    return cuts


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language go on, with that language as theirs.

    A null text and one without letters are in no language and go. Of equal cosines the language that comes first by name
    wins. Where no row has a label, no language is known and nothing goes on.
    """
    model = language.fit(docs.where(~language.held_out()))
    cuts = F.array(*map(F.lit, least_scores(docs, model)))
    lang, score = free("_lang", docs.columns), free("_score", docs.columns)
    known = language.predict(docs, model, out=(lang, score)).where((F.col(lang) != "und") & (F.col(score) >= cuts[size_class()]))
    return known.withColumn("lang", F.col(lang)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds are cut; a document stays though nothing may be left of it.

    A null text stays null and an empty one empty. Rows of one id count as one document, and null as the smallest id, so a repeated row keeps
    what its copy keeps.
    """
    lines, dropped, kept = (free(c, docs.columns) for c in ("_lines", "_dropped", "_kept"))
    done = line_dedup.dedup_lines(docs, out=(lines, dropped, kept))
    return done.withColumn("text", F.col(kept)).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates goes on: that with the smallest id, and of rows that share it the one with the smallest hash.

    A null id counts as the smallest. Of a row repeated as a whole one copy stays. Null texts and those without words are duplicates of nothing and stay.
    """
    return near_dup.keep_one(docs, near_dup.near_duplicates(docs, shingle=5, percent=80))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of any benchmark item go on.

    Null and empty texts hold none and stay, and so do all where the benchmark is empty; items that are null or without words match nothing.
    """
    return decontaminate.drop_contaminated(docs, decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``SAMPLES`` distinct segmentations of every document, drawn without replacement: the rows and columns of :func:`pieces.sample_encodings`.

    Sample 0 is a plain draw, for those who want one a document. A text with fewer segmentations gives all it has, a null or empty one the
    one empty segmentation; rows with equal id and text get the same ones.
    """
    return pieces.sample_encodings(docs, MODEL, k=SAMPLES)


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("near-duplicates", dedup_documents),
    ("decontamination", decontaminated),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what goes from one stage to the next is written to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else written(docs), sf_dir)
    return docs


ORACLE_SQL = None
