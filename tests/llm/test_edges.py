"""Edges of the pipeline's stages and of decoding, and how the text operators are put together."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from infoloom.llm import common, near_dup, pieces

ROOT = Path(__file__).resolve().parent.parent.parent
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the public vocabulary")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with an odd documents table: nulls, repeats, a clashing column for every name that a stage uses inside."""
    folder = str(tmp_path_factory.mktemp("sf"))
    text = "the quick brown fox jumps over the lazy dog again and again\nuntil the night falls on the quiet town by the river"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text.upper(), "en", "s", 1), (None, "ein kurzer satz der nirgends noch einmal steht", "de", None, None)]
    rows += [(3, None, "de", "s", 0), (4, "", None, "s", 0), (5, "12 34", "en", "s", 5), (5, "noch ein anderer satz mit eigenen worten darin", "de", "s", 5)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("th", "kept", "sig", "words", "component", "_row", "lang_pred", "lang_score", "spans", "h", "key", "_keep_id", "_gone_id", "_once", "_line_id"):
        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "nothing of the kind is in any of these texts today"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("i", range(4))
def test_stages_hold_to_the_columns(spark, sf, i):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = corpus_pipeline.STAGES[i][1]
    got = stage(spark, docs, sf)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[c] == "clash" for r in rows for c in docs.columns[5:])
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    want = {0: [1, 1, 2, 5, None], 1: [1, 1, 2, 3, 4, 5, 5, None], 2: [1, 3, 4, 5, 5, None], 3: [1, 1, 2, 3, 4, 5, 5, None]}[i]
    assert ids == sorted((x is None, x or 0) for x in want)
    none = stage(spark, docs.limit(0), sf)
    assert none.columns == docs.columns and none.count() == 0


@needs_model
def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@needs_model
def test_decoding_edges(spark):
    ids = pieces.sample_encodings(spark.createDataFrame([(1, "so be it")], "doc_id long, text string"), MODEL, 1).first().ids
    rows = spark.createDataFrame([(1, ids, "clash"), (1, ids, "clash"), (2, None, "x"), (3, [], "x")], "k long, ids array<int>, decoded string")
    got = pieces.decode_ids(rows, MODEL)
    assert got.columns == ["k", "ids", "decoded"]
    assert sorted((r.k, r.decoded) for r in got.collect() if r.decoded is not None) == [(1, "so be it"), (1, "so be it"), (3, "")]
    assert pieces.decode_ids(rows.limit(0), MODEL).count() == 0


def test_written_tables(spark):
    df = spark.createDataFrame([(1, [2, 3], None)], "a int, b array<long>, c string")
    for _ in range(6):  # the size of a plan with joins of joins stays that of its files
        df = common.written(df.join(df.select("a", F.lit(1).alias("_x")), "a").drop("_x"))
    assert df.collect() == [(1, [2, 3], None)] and common.written(df.limit(0)).count() == 0
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert os.path.isdir(folder)
    common.discard(df)
    assert not os.path.exists(folder)


def test_tables_meet_nearly_all_links():
    """Measured recall of the tables on pairs of likeness 0.8 to 0.81: 16 x 16 tables of two groups of four hashes."""
    import numpy as np

    rng, banding, met, n = np.random.default_rng(3), near_dup.Banding(16, 4), 0, 1500
    for _ in range(n):
        common_, own = 160, 20  # 160 of 200
        x = rng.integers(0, 2**63, common_ + 2 * own, dtype=np.uint64)
        a, b = banding.signature(np.sort(x[: common_ + own])), banding.signature(np.sort(np.concatenate([x[:common_], x[common_ + own :]])))
        same = a == b
        met += bool(same[:16].any() and same[16:].any())
    assert met / n >= 0.997


def test_a_pipeline_gone_missing_is_an_error(tmp_path):
    shutil.copytree(ROOT / "infoloom", tmp_path / "infoloom", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode and "corpus_pipeline" in done.stderr
