"""Discrete estimators against closed-form goldens, invariants and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

import infoloom as il
from infoloom.operators import discrete
from infoloom.operators.nsb import nsb_value

DATA = [[1, 1, 2, 3, 3, 4, 5], [1, 1, 1, 2, 2, 3, 4], [1, 2, 1, 3, 2, 1]]
GOLDEN = {
    "mle": [1.549826045878, 1.277034259466, 1.011404264707],
    "miller_madow": [1.835540331592, 1.491319973752, 1.178070931374],
    "shrink": [1.609437912434, 1.386294361120, 1.098612288668],
    "grassberger": [1.975506766338, 1.749316290147, 1.382864023018],
    "zhang": [1.878571428571, 1.521428571429, 1.2],
    "bonachela": [1.549735449735, 1.253924162257, 0.953422619048],
    "chao_shen": [2.196636225308, 1.679513267961, 1.257316134210],
    "chao_wang_jost": [2.069906619147, 1.678443949186, 1.253454429058],
    "ansb": [3.353104447354, 2.853104447354, 2.544803087699],
    "nsb": [1.452646020211, 1.227849024503, 0.953531800262],
}
PRIORS = {
    "jeffrey": [1.576971099043, 1.320358739142, 1.043757036331],
    "laplace": [1.589026915174, 1.342113178914, 1.060856947158],
    "sch_grass": [1.563745292922, 1.302806466320, 1.035360560685],
    "min_max": [1.577938798350, 1.328884004820, 1.055661238765],
}


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.createDataFrame([(g, x) for g, d in enumerate(DATA) for x in d], "g int, x int").cache()


@pytest.fixture(scope="module")
def triple(spark):
    rows = zip([0, 0, 1, 1, 0, 1, 0, 1], [0, 1, 0, 1, 0, 1, 0, 1], [0, 0, 0, 0, 1, 1, 1, 1], range(8), strict=True)
    return spark.createDataFrame(list(rows), "x int, y int, z int, t int").cache()


@pytest.mark.parametrize("name", GOLDEN)
def test_goldens(grouped, name):
    got = [r.value for r in il.entropy(grouped, "x", group_by=["g"], estimator=name).orderBy("g").collect()]
    assert got == pytest.approx(GOLDEN[name], abs=1e-10)


@pytest.mark.parametrize("prior", PRIORS)
def test_priors(grouped, prior):
    got = [r.value for r in il.entropy(grouped, "x", group_by=["g"], estimator=il.Estimator("bayes", alpha=prior)).orderBy("g").collect()]
    assert got == pytest.approx(PRIORS[prior], abs=1e-10)


def test_information(triple):
    assert il.mutual_information(triple, ["x", "y"]).first().value == pytest.approx(0.130812035941, abs=1e-10)
    assert il.conditional_mutual_information(triple, ["x", "y"], "z").first().value == pytest.approx(0.346573590280, abs=1e-10)


def test_invariants(triple):
    h = il.entropy(triple, "x").first().value
    assert il.mutual_information(triple, ["x", "x"]).first().value == pytest.approx(h)
    ab, ba = (il.mutual_information(triple, v).first().value for v in (["x", "y"], ["y", "x"]))
    assert ab == pytest.approx(ba)
    const = triple.withColumn("c", F.lit(1))
    assert il.conditional_mutual_information(const, ["x", "y"], "c").first().value == pytest.approx(ab)
    assert il.conditional_entropy(triple, "x", "y").first().value == pytest.approx(h - ab)
    assert il.entropy(triple, "x", base=2).first().value == pytest.approx(h / math.log(2))
    assert il.entropy(triple.repartition(7), "x").first().value == pytest.approx(h)


@pytest.mark.parametrize("name", discrete.LOCAL)
def test_local_means(grouped, name):
    means = il.local_entropy(grouped, "x", group_by=["g"], estimator=name).groupBy("g").agg(F.avg("local_value").alias("v")).orderBy("g").collect()
    if name != "shrink":  # its weights are not the sample's frequencies
        assert [r.v for r in means] == pytest.approx(GOLDEN[name], abs=1e-10)
    local = il.conditional_mutual_information
    assert local(grouped.withColumn("y", F.col("x") % 2).withColumn("z", F.lit(0)), ["x", "y"], "z", local=True, estimator=name).count() == 20


def test_nulls_clashing_names_and_empty(spark, triple):
    odd = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, None, 7), (None, "b", 8)], "`_c` int, value string, n int")
    got = il.entropy(odd, "value").first()
    assert (got.n, got.value) == (3, pytest.approx(-(2 / 3) * math.log(2 / 3) - math.log(1 / 3) / 3))
    assert {(r["_c"], r.n) for r in il.entropy(odd, "value", group_by=["_c"]).collect()} == {(1, 2), (None, 1)}
    none = triple.where("x > 9")
    assert il.entropy(none, "x").first().asDict() == {"value": 0.0, "n": 0}
    assert math.isnan(il.entropy(none, "x", estimator="ansb").first().value)
    assert il.entropy(none, "x", group_by=["y"]).count() == 0


def test_cross_and_divergences(spark):
    p = spark.createDataFrame([(v,) for v in [1, 1, 2, 3]], "x int")
    q = spark.createDataFrame([(v,) for v in [1, 2, 2, 4]], "x int")
    cross = -(0.5 * math.log(0.25) + 0.25 * math.log(0.5))
    assert il.cross_entropy(p, q, "x").first().value == pytest.approx(cross)
    assert il.cross_entropy(p, q.where("x > 3"), "x", estimator="miller_madow").first().value == 0.0
    assert il.kl_divergence(p, p, "x").first().value == pytest.approx(0.0)
    assert il.js_divergence([p, p], "x").first().value == pytest.approx(0.0)
    mixture = {1: 0.375, 2: 0.375, 3: 0.125, 4: 0.125}
    js = -sum(v * math.log(v) for v in mixture.values()) - il.entropy(p, "x").first().value / 2 - il.entropy(q, "x").first().value / 2
    assert il.js_divergence([p, q], "x").first().value == pytest.approx(js)
    with pytest.raises(NotImplementedError):
        il.cross_entropy(p, q, "x", estimator="zhang")


def test_nsb_edges():
    assert math.isnan(nsb_value([(1.0, 5.0)]))  # no coincidence
    assert math.isnan(nsb_value([(7.0, 1.0)]))  # one symbol
    assert nsb_value([(1.0, 3.0), (2.0, 2.0)]) == pytest.approx(1.452646020211, abs=1e-9)
    assert nsb_value([(1.0, 3.0), (2.0, 2.0)], k=50) > 1.45


def test_coverage_tail_is_stable(spark):
    from infoloom.operators.discrete import _unseen_tail

    for a, n in ((0.3, 200.0), (0.9, 3.0), (1e-4, 1000.0)):
        want = sum((1 - a) ** (1 + j) / (n + j) for j in range(400_000))
        got = spark.range(1).select(_unseen_tail(F.lit(a), F.lit(n)).alias("v")).first().v
        assert got == pytest.approx(want, rel=1e-9)


def test_bad_arguments(triple):
    with pytest.raises(ValueError):
        il.entropy(triple, "x", estimator="nope")
    with pytest.raises(ValueError):
        il.entropy(triple, "x", base=1)
    with pytest.raises(NotImplementedError):
        il.local_entropy(triple, "x", estimator="bonachela")


def test_own_estimator(grouped, triple, monkeypatch):
    monkeypatch.setattr(discrete, "ADDED", {})
    il.register_entropy("own_mle", lambda n, k, total: total(lambda c: -c / n * F.log(c / n)))
    il.register_entropy("hartley", lambda n, k, total: F.log(k))
    got = {r.g: r.value for r in il.entropy(grouped, "x", group_by=["g"], estimator="own_mle").collect()}
    assert [got[i] for i in range(3)] == pytest.approx(GOLDEN["mle"])
    assert {r.g: r.value for r in il.entropy(grouped, "x", group_by=["g"], estimator="hartley").collect()} == pytest.approx({g: math.log(len(set(d))) for g, d in enumerate(DATA)})
    x, y = triple.columns[:2]
    own, mle = (il.mutual_information(triple, [x, y], estimator=e).first().value for e in ("own_mle", "mle"))
    assert own == pytest.approx(mle, abs=1e-12)
    for name in ("mle", "hartley"):
        with pytest.raises(ValueError):
            il.register_entropy(name, lambda n, k, total: n)
