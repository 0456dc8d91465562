"""Embedding, transfer entropies and ordinal patterns."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import infoloom as il
from infoloom.operators.ordinal import symbolize
from infoloom.plans import series
from infoloom.plans.surrogates import effective_transfer_entropy

X, Y = [0, 1] * 5, [0, 0, 1, 0, 1, 0, 1, 0, 1, 0]


def brute_te(x, y, sh, dh, step):
    delay = max(sh, dh) * step
    rows = [(y[t], tuple(x[t - j * step] for j in range(sh, 0, -1)), tuple(y[t - j * step] for j in range(dh, 0, -1))) for t in range(delay, len(y), step)]

    def h(keys):
        c = Counter(keys)
        n = len(keys)
        return -sum(v / n * math.log(v / n) for v in c.values())

    return h([(s, d) for _, s, d in rows]) + h([(f, d) for f, _, d in rows]) - h(rows) - h([d for _, _, d in rows])


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame(list(zip(range(10), X, Y, strict=True)), "t int, x int, y int").cache()


def test_golden(pair):
    assert il.transfer_entropy(pair, "x", "y", ["t"]).first().value == pytest.approx(0.278001346410, abs=1e-10)
    assert il.transfer_entropy(pair, "y", "x", ["t"]).first().value == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize(("sh", "dh", "step"), [(1, 1, 1), (2, 1, 1), (1, 3, 2), (2, 2, 3)])
def test_histories(spark, sh, dh, step):
    rng = random.Random(sh * 10 + dh)
    x, y = [rng.randrange(3) for _ in range(60)], [rng.randrange(2) for _ in range(60)]
    df = spark.createDataFrame(list(zip(range(60), x, y, strict=True)), "t int, x int, y int")
    got = il.transfer_entropy(df, "x", "y", ["t"], (), sh, dh, step).first()
    assert got.value == pytest.approx(brute_te(x, y, sh, dh, step), abs=1e-10)
    local = il.transfer_entropy(df, "x", "y", ["t"], (), sh, dh, step, local=True)
    assert local.agg(F.avg("local_value")).first()[0] == pytest.approx(got.value)


def test_blocks_agree_with_windows(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 7)
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"), (F.xxhash64("id") % 4).alias("x"), (F.xxhash64("id", F.lit(1)) % 3).alias("y"))
    plain = il.transfer_entropy(df, "x", "y", ["id"], ["g"], 2, 3, 2, blocked=False).first()
    blocked = il.transfer_entropy(df, "x", "y", ["id"], ["g"], 2, 3, 2, blocked=True).first()
    assert blocked.n == plain.n
    assert blocked.value == pytest.approx(plain.value)
    assert series.longest(df, ["g"]) > 7  # so series are cut unless told otherwise
    monkeypatch.setattr(series, "BLOCK_ROWS", 2)  # and blocks may be shorter than what is looked back
    assert il.transfer_entropy(df, "x", "y", ["id"], ["g"], 2, 3, 2).first().value == pytest.approx(plain.value)


def test_history_longer_than_series(pair):
    assert il.transfer_entropy(pair, "x", "y", ["t"], src_hist=20).first().n == 0


def test_conditional(pair):
    df = pair.withColumn("z", F.lit(0))
    got = il.conditional_transfer_entropy(df, "x", "y", "z", ["t"]).first().value
    assert got == pytest.approx(0.278001346410, abs=1e-10)


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(map(float, values))), "t int, x double")


def test_ordinal_goldens(spark):
    tied = frame(spark, [3, 2, 2, 1, 1, 4, 4, 0])
    get = lambda df, **k: il.entropy(df, "x", "ordinal", order_by=["t"], **k).first()
    assert get(tied, order=3).value == pytest.approx(1.098612288668)
    assert get(tied, order=3, tie_mode="strict3").value == pytest.approx(0.867563228481)
    assert get(frame(spark, [1, 2, 3, 2, 1]), order=2).value == pytest.approx(math.log(2))
    assert get(frame(spark, [1, 2, 1.5, 3, 2.5, 4, 3.5, 5]), order=3).value == pytest.approx(0.693147180560)
    short = get(frame(spark, [1, 2]), order=3)
    assert (short.value, short.n) == (0.0, 0)


def test_codes(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, 1.0, 2.0, math.nan]) for _ in range(40)]
    got = {r.t: r.x_pattern for r in symbolize(frame(spark, values), ["x"], 4, ["t"]).collect()}
    for t in range(37):
        w = values[t : t + 4]
        perm = sorted(range(4), key=lambda i: (math.isnan(w[i]), 0 if math.isnan(w[i]) else w[i], i))
        assert got[t] == sum(sum(perm[i] > perm[j] for j in range(i + 1, 4)) * math.factorial(3 - i) for i in range(4))
    with pytest.raises(ValueError):
        symbolize(frame(spark, values), ["x"], 21, ["t"])


def test_effective(spark):
    df = spark.range(80).select("id", (F.xxhash64("id") % 2).alias("x")).withColumn("y", F.xxhash64(F.col("id") - 1) % 2)
    got = effective_transfer_entropy(df, "x", "y", ["id"], rounds=3).first()
    assert got.observed > 0.5 and got.p_value == pytest.approx(0.25) and got.value < got.observed


def test_effective_query_can_reach_significance(monkeypatch):
    import inspect

    from infoloom import queries

    given = {}
    monkeypatch.setattr(queries, "_events", lambda s, d: None)
    monkeypatch.setattr(queries.surrogates, "effective_transfer_entropy", lambda *a, **k: given.update(k))
    queries.QUERIES["effective_te"](None, "")
    rounds = given.get("rounds", inspect.signature(queries.surrogates.surrogate_values).parameters["rounds"].default)
    assert 1 / (rounds + 1) <= 0.05


def test_shuffles_are_joined_without_broadcasts(spark):
    from infoloom.plans.series import shuffled_pasts

    df = spark.range(50).select(F.col("id").alias("t"), (F.col("id") % 2).alias("s"), F.col("id").alias("v"))
    out = shuffled_pasts(df, ["v"], ["t"], ["s"], 3, 0, ["t"])
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "SortMergeJoin [_rn" in final and "BroadcastHashJoin [_rn" not in final
    for r in range(3):
        for s in (0, 1):
            assert sorted(x.v for x in rows if x["round"] == r and x.s == s) == list(range(s, 50, 2))
