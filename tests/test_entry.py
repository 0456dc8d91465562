"""The driver's entry points, the streams and the sources."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import infoloom as il
from infoloom import sources, streaming

ROOT = Path(__file__).resolve().parent.parent


def test_queries_have_names_in_common():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_imports_without_the_text_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "infoloom", tmp_path / "infoloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_stream_matches_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i % 6}:00", i % 3) for i in range(60)] + [("2024-01-01 02:00:00", 0)]
    df = spark.createDataFrame(rows, "ts string, x int").select(F.to_timestamp("ts").alias("ts"), "x")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    done = streaming.windowed_entropy(stream, "x", "ts", "2 minutes", "0 seconds", "zhang")
    query = done.writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r.window.start: r.value for r in spark.table("windows").collect()}
    want = {r.window.start: r.value for r in il.entropy(df.withColumn("window", F.window("ts", "2 minutes")), "x", group_by=["window"], estimator="zhang").collect()}
    assert len(got) >= 3 and all(got[k] == pytest.approx(want[k]) for k in got)


def test_stream_embedding(spark, tmp_path):
    df = spark.range(20).select((F.col("id") % 2).alias("s"), F.col("id").alias("v"), F.col("id").cast("timestamp").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streaming.embed_stream(stream, "s", "v", "ts", 2).writeStream.format("memory").queryName("embedded").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("embedded").collect()
    assert len(got) == 16 and all(r.value - r.past == 4 for r in got)


def test_sources(spark, tmp_path):
    df = sources.from_arrays(spark, x=[1, 2, 2], y=[0.5, 1.5, 2.5])
    assert df.columns == ["t", "x", "y"]
    sources.write(df, str(tmp_path / "t"), "csv", options={"header": "true"})
    assert sources.read(spark, str(tmp_path / "t"), "csv", ["x"], header="true").count() == 3
    batch = spark.createDataFrame([([1, 1, 2],), ([3, 3],)], "a array<int>")
    assert il.entropy(sources.from_rows(batch, "a"), "x", group_by=["batch"]).count() == 2
    with pytest.raises(ValueError):
        sources.from_arrays(spark, x=[1], y=[1, 2])
