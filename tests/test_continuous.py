"""Kernel and nearest-neighbour measures against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import infoloom as il
from infoloom.functions.special import digamma, digamma_value, trigamma_value, unit_ball_volume
from infoloom.operators import knn, neighbors


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double").cache()


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(42).normal(size=(120, 3))
    x[:10] = x[10:20]  # ties
    return x, spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").cache()


def test_special(spark):
    for x in (0.5, 1.0, 2.0, 7.25, 1e6):
        got = spark.range(1).select(digamma(F.lit(x)).alias("v")).first().v
        assert got == pytest.approx(digamma_value(x), abs=1e-12)
    assert digamma_value(1.0) == pytest.approx(-0.5772156649015329)
    assert trigamma_value(1.0) == pytest.approx(math.pi**2 / 6)
    assert unit_ball_volume(3) == pytest.approx(4 / 3 * math.pi)
    assert unit_ball_volume(2, 1.0) == pytest.approx(2.0)
    assert unit_ball_volume(4, math.inf, 0.5) == 1.0


def test_line_goldens(line):
    value = lambda **k: il.entropy(line, "x", **k).first().value
    assert value(approach="kl", k=3) == pytest.approx(2.796355636710, abs=1e-10)
    for order, renyi, tsallis in ((0.6, 2.672091519726, 4.779974356653), (1.2, 2.779802177545, 2.132394167500), (1.8, 2.909516428888, 1.128089680644)):
        assert value(approach="renyi", alpha=order, k=3) == pytest.approx(renyi, abs=1e-10)
        assert value(approach="tsallis", q=order, k=3) == pytest.approx(tsallis, abs=1e-10)
    assert value(approach="kernel", bandwidth=1.0) == pytest.approx(math.log(10))
    assert value(approach="kernel", bandwidth=2.0) == pytest.approx(1.978213006508)
    assert value(approach="kernel", kernel="gaussian", bandwidth=1.0) == pytest.approx(2.589780275707, abs=1e-10)


def test_ksg_goldens(spark):
    df = spark.createDataFrame(list(zip([1.0, 3.0, 0.0, 2.0, 5.5], [4.0, 1.5, 0.25, 2.75, 1.0], strict=True)), "x double, y double")
    assert il.mutual_information(df, ["x", "y"], "ksg", k=2).first().value == pytest.approx(0.266666666667)
    assert il.mutual_information(df, ["x", "y"], "ksg", k=2, variant=2).first().value == pytest.approx(-0.916666666667)


@pytest.fixture(params=["boxes", "nested", "pairs"])
def boxes(request, monkeypatch):
    """Whether points are searched box by box, as many are, in one level or two, with boxes and blocks of a few points."""
    monkeypatch.setattr(neighbors, "BLOCK_POINTS", 16)
    if request.param != "pairs":
        monkeypatch.setattr(neighbors, "ALL_PAIRS", 0)
        monkeypatch.setattr(neighbors, "BOX_POINTS", 12)
        monkeypatch.setattr(neighbors, "BLOCK_QUERIES", 20)
        monkeypatch.setattr(neighbors, "MAX_BOXES", 64 if request.param == "boxes" else 3)
    return request.param


@pytest.mark.parametrize(("metric", "p"), [("chebyshev", math.inf), ("euclidean", 2.0), ("manhattan", 1.0), (3.0, 3.0), (0.5, 0.5)])
def test_nearest(cloud, metric, p, boxes):
    x, df = cloud
    pts = neighbors.points(df, ["a", "b", "c"])
    got = neighbors.kth_distance(pts, pts, 3, knn.norm(metric), True).collect()
    assert sum(r._w for r in got) == len(x)
    for r in got:
        d = np.sort(neighbors.distances(np.array([r._x]), x, p)[0])
        assert r._rho == pytest.approx(d[3])


def test_nearest_of_another_sample(cloud, boxes):
    x, df = cloud
    a, b = neighbors.points(df.where("a > 0.5"), ["a", "b"]), neighbors.points(df.where("a < 0").union(df.where("a < -1")), ["a", "b"])
    y = np.concatenate([x[x[:, 0] < 0], x[x[:, 0] < -1]])
    for r in neighbors.kth_distance(a, b, 5, 2.0, False).collect():
        assert r._rho == pytest.approx(np.sort(neighbors.distances(np.array([r._x]), y[:, :2], 2.0)[0])[4])


def test_a_point_with_many_rows(spark, boxes):
    rows = [(0.0, 0.0)] * 2500 + [(float(i), float(i % 5)) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "x double, y double")
    x = np.array(rows)
    mine = neighbors.points(df, ["x", "y"])
    assert mine.count() == 60 and neighbors.total(mine) == len(rows)
    rho = {tuple(r._x): r._rho for r in neighbors.kth_distance(mine, mine, 2, math.inf, True).collect()}
    assert rho[0.0, 0.0] == 0.0 and rho[1.0, 1.0] == 1.0 and rho[59.0, 4.0] == 2.0
    local = il.local_entropy(df, ["x", "y"], "kernel", bandwidth=2.5).collect()
    near = (np.abs(x[:, None] - x[None]).max(axis=2) <= 1.25).sum(axis=1) / (len(x) * 2.5**2)
    assert sorted(r.local_value for r in local) == pytest.approx(sorted(-np.log(near)))


@pytest.mark.parametrize("variant", [1, 2])
def test_ksg(cloud, boxes, variant):
    x, df = cloud
    d = np.abs(x[:, None] - x[None])
    rho = np.sort(d.max(axis=2), axis=1)[:, 4]

    def psi(dims):
        near = d[:, :, dims].max(axis=2)
        count = np.maximum((near < rho[:, None]).sum(axis=1) - 1, 0) + 1 if variant == 1 else (near <= rho[:, None]).sum(axis=1)
        return np.array([digamma_value(c) for c in count])

    fixed = digamma_value(4) - (0.25 if variant == 2 else 0.0)
    want = fixed + psi([2]) - psi([0, 2]) - psi([1, 2])
    assert il.conditional_mutual_information(df, ["a", "b"], "c", "ksg", variant=variant).first().value == pytest.approx(want.mean())
    local = il.conditional_mutual_information(df, ["a", "b"], "c", "ksg", variant=variant, local=True).collect()
    assert sorted(r.local_value for r in local) == pytest.approx(sorted(want))


def test_cuts():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(900, 2)), np.zeros((300, 2))])
    cuts = neighbors.Cuts(x, 16)
    sizes = np.bincount(cuts.of(x), minlength=16)
    assert len(sizes) == 16 and sizes.sum() == len(x) and np.sort(sizes)[-2] < 150
    assert (neighbors.Cuts(np.zeros((0, 2)), 4).of(x) == 0).all() and (neighbors.Cuts(x[-9:], 4).of(x[-9:]) == 0).all()


@pytest.mark.parametrize("bandwidth", [0.3, 1.0])
def test_box(cloud, bandwidth, boxes):
    x, df = cloud
    near = np.abs(x[:, None] - x[None]) <= bandwidth / 2 + 1e-15
    want = {n: near[:, :, list(d)].all(axis=2).sum(axis=1) / (len(x) * bandwidth ** len(d)) for n, d in {"a": [0], "b": [1], "ab": [0, 1]}.items()}
    assert il.entropy(df, "a", "kernel", bandwidth=bandwidth).first().value == pytest.approx(-np.log(want["a"]).mean())
    mi = il.mutual_information(df, ["a", "b"], "kernel", bandwidth=bandwidth).first().value
    assert mi == pytest.approx(np.mean(np.log(want["ab"] / want["a"] / want["b"])))


def test_gaussian_mi(cloud, boxes):
    x, df = cloud

    def density(d):
        cov = np.atleast_2d(np.cov(x[:, d].T)) * 0.25
        diff = x[:, None, d] - x[None][:, :, d]
        q = np.einsum("ijk,kl,ijl->ij", diff, np.linalg.inv(cov), diff)
        return np.where(q <= 64, np.exp(-q / 2), 0).sum(axis=1) / (len(x) * np.sqrt((2 * np.pi) ** len(d) * np.linalg.det(cov)))

    want = np.mean(np.log(density([0, 1]) / density([0]) / density([1])))
    assert il.mutual_information(df, ["a", "b"], "kernel", kernel="gaussian", bandwidth=0.5).first().value == pytest.approx(want, abs=1e-9)


def test_scaling_and_sums(cloud):
    _, df = cloud
    distinct = df.distinct()
    h = il.entropy(distinct, ["a", "b"], "kl").first().value
    scaled = distinct.select((F.col("a") * 3).alias("a"), (F.col("b") * 3).alias("b"))
    assert il.entropy(scaled, ["a", "b"], "kl").first().value == pytest.approx(h + 2 * math.log(3))
    parts = [il.entropy(distinct, v, "kl").first().value for v in ("a", "b", ["a", "b"])]
    assert il.mutual_information(distinct, ["a", "b"], "kl").first().value == pytest.approx(parts[0] + parts[1] - parts[2])
    local = il.local_entropy(distinct, ["a", "b"], "kl").agg(F.avg("local_value")).first()[0]
    assert local == pytest.approx(h)


def test_errors_and_missing_values(spark, line):
    with pytest.raises(ValueError):
        il.entropy(line, "x", "kl", k=10)
    with pytest.raises(ValueError):
        il.entropy(line, "x", "kernel", kernel="wide")
    with pytest.raises(ValueError):
        il.entropy(line, "x", "kernel", bandwidth=0)
    with pytest.raises(NotImplementedError):
        il.mutual_information(line, ["x", "x"], "nope")
    odd = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,)], "x double")
    assert il.entropy(odd, "x", "kernel").first().n == 2
    assert il.entropy(odd.where("x = 1"), "x", "kl").first().value == 0.0


@pytest.mark.parametrize("limit", [20_000, 30])
def test_grouped(cloud, limit, monkeypatch):
    from infoloom.operators import grouped

    monkeypatch.setattr(grouped, "GROUP_POINTS", limit)
    _, df = cloud
    both = df.distinct().withColumn("g", (F.xxhash64("a") % 2 == 0).cast("string")).cache()
    kinds = [("kernel", {"bandwidth": 0.7}), ("kernel", {"kernel": "gaussian", "bandwidth": 0.5}), ("kl", {"k": 3, "variant": 2}), ("renyi", {"alpha": 1.2}), ("tsallis", {"q": 0.6})]
    for approach, params in kinds[:3] if limit == 30 else kinds:
        got = {r.g: (r.value, r.n) for r in il.entropy(both, ["a", "b"], approach, group_by=["g"], **params).collect()}
        for g in ("true", "false"):
            want = il.entropy(both.where(F.col("g") == g), ["a", "b"], approach, **params).first()
            assert got[g] == (pytest.approx(want.value), want.n)


@pytest.mark.parametrize("extra", [0, 2000])
def test_gaussian_counts_all_pairs_whatever_the_size(spark, extra):
    n = 4000 + extra  # the number of rows used to decide how far a kernel reached
    q = spark.range(n).select((F.col("id") % 2 * 2.0 - 1.0).alias("x"))
    sd = 0.5 * math.sqrt(n / (n - 1))
    for at in (4.5, 5.5):  # 7 and 9 standard deviations from the nearest
        p = spark.createDataFrame([(at,)], "x double")
        want = sum(0.5 * math.exp(-0.5 * ((at - y) / sd) ** 2) for y in (-1, 1)) / (math.sqrt(2 * math.pi) * sd)
        assert il.cross_entropy(p, q, "x", "kernel", kernel="gaussian", bandwidth=0.5).first().value == pytest.approx(-math.log(want))
    from infoloom.operators import grouped

    y = np.concatenate([np.zeros(n - 1), [40.0]])
    s = 0.5 * np.std(y, ddof=1)
    far = math.exp(-0.5 * (40 / s) ** 2)
    want = ((n - 1) * math.log((n - 1 + far) / n) + math.log((1 + (n - 1) * far) / n)) / n - math.log(math.sqrt(2 * math.pi) * s)
    assert grouped._density(y[:, None], "gaussian", 0.5) == pytest.approx(-want)


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_a_grid_equals_all_pairs(spark, dim, monkeypatch):
    rng = np.random.default_rng(dim)
    x = rng.normal(scale=2.0, size=(300, dim))
    if dim < 3:
        x = np.concatenate([x, x[:9] + 200.0, x[:9] - 36.0])  # nodes stand in islands
    df = spark.createDataFrame([(i, list(map(float, r)), 1 + i % 3) for i, r in enumerate(x)], "_id long, _x array<double>, _w long")
    some = df.where("_id % 7 != 0")
    turn = np.eye(dim) + 0.1 * np.tri(dim)
    kernels = {"whole": neighbors.gaussian(range(dim), turn), "last": neighbors.gaussian([dim - 1])}
    want = {n: k.whole(x, y := x[np.arange(len(x)) % 7 != 0], 1 + np.flatnonzero(np.arange(len(x)) % 7) % 3) for n, k in kernels.items()}
    monkeypatch.setattr(neighbors, "ALL_PAIRS", 0)
    monkeypatch.setattr(neighbors, "GRID_PAYS", math.inf)
    monkeypatch.setattr(neighbors, "SLICE", 1000)
    assert len(neighbors.grids([df, some], kernels)) == 2 and len(y) < len(x)
    got = {r._id: r for r in neighbors.kernel_sums(df, some, kernels).collect()}
    for n in kernels:
        assert [got[i][n] for i in range(len(x))] == pytest.approx(want[n], rel=1e-11)
    monkeypatch.setattr(neighbors, "NODES", 10)  # no grid: box by box
    got = {r._id: r for r in neighbors.kernel_sums(df, some, kernels).collect()}
    for n in kernels:
        assert [got[i][n] for i in range(len(x))] == pytest.approx(want[n], rel=1e-11)


@pytest.mark.parametrize("dim", [1, 2, 4])
def test_bits_count_as_plain_comparisons_do(spark, dim, monkeypatch):
    rng = np.random.default_rng(dim)
    x = np.unique(np.round(rng.normal(size=(700, dim)), 1) / 1.0, axis=0)  # many pairs lie at the reach exactly
    w = 1 + np.arange(len(x)) ** 2 % 37
    reach = 0.7 + 1e-15
    want = (neighbors.distances(x, x, math.inf) <= reach) @ w
    assert (neighbors.Bits(x, w).counts(x, range(dim), reach) == want).all()
    monkeypatch.setattr(neighbors, "BLOCK_QUERIES", 100)
    monkeypatch.setattr(neighbors, "BIT_POINTS", 20)
    monkeypatch.setattr(neighbors, "BIT_BLOCKS", 3)
    df = spark.createDataFrame([(i, list(map(float, r)), int(w[i])) for i, r in enumerate(x)], "_id long, _x array<double>, _w long").cache()
    got = {r._id: r.n for r in neighbors.box_sums(df, df, dim, reach, "n").groupBy("_id").agg(F.sum("n").alias("n")).collect()}
    assert [got[i] for i in range(len(x))] == list(want)
    far = df.where("_x[0] > 1")
    got = {r._id: r.n for r in neighbors.box_sums(df, far, dim, reach, "n").groupBy("_id").agg(F.sum("n").alias("n")).collect()}
    assert [got[i] for i in range(len(x))] == list((neighbors.distances(x, x[x[:, 0] > 1], math.inf) <= reach) @ w[x[:, 0] > 1])


def test_box_sums_move_few_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "ALL_PAIRS", 0)  # a query used to be one row for each box within reach
    monkeypatch.setattr(neighbors.Boxes, "partials", lambda *a, **k: pytest.fail("queries are sent box by box"))
    df = spark.range(400).select((F.col("id") % 20 / 20.0).alias("a"), (F.floor(F.col("id") / 20) / 20.0).alias("b"))
    x = np.array([[i % 20 / 20.0, i // 20 / 20.0] for i in range(400)])
    near = (np.abs(x[:, None] - x[None]).max(axis=2) <= 0.25 + 1e-15).sum(axis=1) / (400 * 0.25)
    assert il.entropy(df, ["a", "b"], "kernel", bandwidth=0.5).first().value == pytest.approx(-np.log(near).mean())


@pytest.mark.parametrize("rows", [100_000, 40])
def test_grouped_in_one_dimension_stays_out_of_python(spark, rows, monkeypatch):
    from infoloom.operators import grouped
    from infoloom.plans import series

    monkeypatch.setattr(series, "BLOCK_ROWS", rows)
    x = np.round(np.random.default_rng(5).normal(size=300), 2)  # with ties
    data = {g: x[a:b] for g, a, b in (("a", 0, 180), ("b", 180, 295), (None, 295, 300))}
    df = spark.createDataFrame([(g, float(v)) for g, xs in data.items() for v in xs], "g string, x double")
    want = {g: (grouped._kl(v[:, None], 3, 2), grouped._order(v[:, None], "renyi", 1.2), grouped._order(v[:, None], "tsallis", 0.6)) for g, v in data.items()}
    monkeypatch.setattr(grouped, "_radii", lambda *a: pytest.fail("a whole group in one task"))
    for i, (approach, params) in enumerate((("kl", {"k": 3, "variant": 2}), ("renyi", {"alpha": 1.2}), ("tsallis", {"q": 0.6}))):
        out = il.entropy(df, "x", approach, group_by=["g"], **params)
        assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().toString()
        got = {r.g: (r.value, r.n) for r in out.collect()}
        assert got == {g: (pytest.approx(want[g][i]), len(v)) for g, v in data.items()}
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "g string, x double")
    assert {r.g: r.value for r in il.entropy(one, "x", "kl", k=1, group_by=["g"]).collect()}["a"] == 0.0
    with pytest.raises(Exception, match="needs more points"):
        il.entropy(one, "x", "kl", k=2, group_by=["g"]).collect()
