"""Tests of large samples: sorted order, tiles, moments and factors against matrices and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.config import CIConfig, DiscoverConfig, SplineConfig
from loomgraph.functions import kernels, radial, sorted_sums, splines, tiles
from loomgraph.operators import ci, factors, moment_splines, precision, residuals
from loomgraph.plans.discover import discover


def frame(spark, cols, parts=3):
    names = [f"v{j}" for j in range(len(cols))]
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(*cols, strict=True))]
    return spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} double" for c in names)).repartition(parts)


def numbers(row):
    return [row[c] for c in ("statistic", "mean", "variance", "p_value")]


def told(r):
    return [r.statistic, r.mean, r.variance, r.p_value]


@pytest.mark.parametrize("kind", ["plain", "ties", "copies", "constant"])
@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_sorted_distance_covariance(spark, kind, block):
    rng = np.random.default_rng(1)
    n = 150
    x = {"plain": rng.normal(size=n), "ties": rng.integers(0, 5, n), "copies": np.repeat(rng.normal(size=3), 50), "constant": np.zeros(n)}[kind]
    y = {"plain": rng.normal(size=n) + x, "ties": rng.integers(0, 4, n), "copies": np.tile(rng.normal(size=2), 75), "constant": rng.normal(size=n)}[kind]
    got = kernels.dcov_tail(sorted_sums.distance_sums(frame(spark, [x, y]), "v0", "v1", block)).first()
    want = ci.dcov_gamma(x, y)
    if kind == "constant":
        assert got.statistic == pytest.approx(0, abs=1e-12) and got.p_value == 1.0
    else:
        assert np.allclose(numbers(got), told(want), rtol=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_concordant_sums(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    x, y, w = rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float), rng.integers(1, 4, n).astype(float)
    want = sum(w[i] * w[j] * (x[i] - x[j]) * (y[i] - y[j]) for i in range(n) for j in range(n) if x[j] < x[i] and y[j] < y[i])
    assert sorted_sums.concordant_in_block(x, y, w) == pytest.approx(want)


def test_running_sums_and_quantiles(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.integers(0, 6, 200), rng.normal(size=50)))
    df = frame(spark, [x])
    steps = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    assert np.allclose(sorted_sums.exact_quantiles(df, "v0", steps), np.quantile(x, steps))
    assert sorted_sums.exact_quantiles(df.limit(0), "v0", steps) == []
    blocks = sorted_sums.range_blocks(df, ["v0", "i"], 6, "b")
    got = {r.i: r.s for r in sorted_sums.running_sums(blocks, "b", ["v0", "i"], {"s": F.col("v0")}).collect()}
    order = np.lexsort((np.arange(len(x)), x))
    assert np.allclose([got[i] for i in order], np.cumsum(x[order]))


@pytest.mark.parametrize("tile", [16, 1000])
def test_tiles(spark, tile):
    rng = np.random.default_rng(2)
    cols = rng.normal(size=(4, 90))
    df = frame(spark, cols)
    k, l = tiles.Kernel(("v0", "v1")), tiles.Kernel(("v2", "v3"))
    got = kernels.dcov_tail(tiles.centred_sums(df, k, l, tile)).first()
    assert np.allclose(numbers(got), told(ci.dcov_gamma(cols[:2].T, cols[2:].T)), rtol=1e-9)
    got = kernels.hsic_tail(tiles.centred_sums(df, tiles.Kernel(("v0",), "rbf", sig=0.5), tiles.Kernel(("v1",), "rbf", sig=0.5), tile)).first()
    assert np.allclose(numbers(got), told(ci.hsic_gamma(cols[0], cols[1], 0.5)), rtol=1e-9)


def test_permutations_by_tiles(spark):
    """The replicates are those of the test in numpy, as permutations come from the same order of hashes."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2, 60))
    for kind, method, scale in (("distance", "dcc.perm", lambda n: 1 / n), ("rbf", "hsic.perm", lambda n: 1 / (n * n))):
        got = tiles.permutation_test(frame(spark, [x, y]), tiles.Kernel(("v0",), kind), tiles.Kernel(("v1",), kind), 9, 3, scale, tile=16).first()
        want = ci.run_test(x, y, CIConfig(method, replicates=9, seed=3))
        assert got.replicates == 9 and got.statistic == pytest.approx(want.statistic) and got.p_value == pytest.approx(want.p_value)


@pytest.mark.parametrize("given", [1, 2, 3])
def test_splines_from_moments(spark, given):
    rng = np.random.default_rng(given)
    s = rng.normal(size=(given, 200))
    if given == 3:
        s[2] = 1.5  # one value alone
    ys = np.stack((np.sin(2 * s[0]) + 0.1 * rng.normal(size=200), s.sum(0) ** 2 + rng.normal(size=200)))
    out = moment_splines.spline_residuals(frame(spark, [*s, *ys]), [f"v{given}", f"v{given + 1}"], [f"v{j}" for j in range(given)]).orderBy("i").collect()
    for j, y in enumerate(ys):
        want = residuals.fast_spline(y, s.T, SplineConfig())
        assert np.allclose([r[f"resid_v{given + j}"] for r in out], want.residuals, atol=1e-6)


def test_factors(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(2, 120)), 1)
    df = frame(spark, x)
    made, rank = factors.incomplete_cholesky(df, ["v0", "v1"], 0.8, 25, 1e-3)
    want = ci.inchol(x.T, 0.8, 25)
    got = np.array([r.f for r in made.orderBy("i").collect()])
    assert rank == want.shape[1] and np.allclose(got, want, atol=1e-8)
    r = factors.hsic_lowrank(df, ["v0"], ["v1"], 1.0, 12)
    assert np.allclose(told(r), told(ci.hsic_gamma(x[0], x[1], 1.0, 12)), rtol=1e-8)
    assert factors.incomplete_cholesky(df.limit(0), ["v0"])[1] == 0


def test_factors_of_many_rows(spark):
    """60,000 rows: the factor reproduces the kernel to its tolerance, and the test tells dependence."""
    n = 60_000
    df = spark.range(n).select(F.col("id").alias("i"), F.randn(3).alias("v0"), F.randn(4).alias("v1")).withColumn("v2", F.col("v0") * F.col("v0") + F.col("v1"))
    made, rank = factors.incomplete_cholesky(df, ["v0"], 1.0, 60, 1e-3)
    assert rank < 30 and made.selectExpr("max(1 - aggregate(f, 0D, (a, x) -> a + x * x)) m").first().m <= 1e-3 + 1e-9
    assert factors.hsic_lowrank(df, ["v0"], ["v1"], num_col=20).p_value > 1e-3
    assert factors.hsic_lowrank(df, ["v0"], ["v2"], num_col=20).p_value < 1e-6


def test_records_of_second_opinions(spark):
    tasks = spark.createDataFrame([(t, [0]) for t in range(4)], "task_id long, s array<int>")
    one = lambda p: lambda t: t.select("task_id", F.when(F.col("task_id") == 3, F.lit(None)).otherwise(F.lit(p)).cast("double").alias("p"), F.lit("dcc.gamma").alias("method"), F.lit(p).alias("statistic"))
    got = {r.task_id: r for r in precision.fallback_chain(tasks, [one(0.2), lambda t: t.select("task_id", F.lit(0.7).alias("p"))], ["fast", "exact"]).collect()}
    assert (got[0].source, got[0].attempts, got[0].method, got[0].statistic) == ("fast", 1, "dcc.gamma", 0.2)
    assert (got[3].source, got[3].attempts, got[3].method, got[3].p) == ("exact", 2, None, 0.7)
    hybrid = precision.hybrid_provider(one(0.06), one(0.04), 0.05, 0.7)
    rows = {r.task_id: r for r in hybrid(tasks).collect()}
    assert (rows[0].p, rows[0].source, rows[0].attempts, rows[0].statistic) == (0.04, "verifier", 2, 0.04)
    hybrid.close()


def _curves(seed, n=120):
    rng = np.random.default_rng(seed)
    s = rng.normal(size=(n, 3))
    return s, np.column_stack((np.sin(2 * s[:, 0]) + 0.3 * rng.normal(size=n), s[:, 0] ** 2 + s[:, 1] + rng.normal(size=n), rng.normal(size=n)))


@pytest.mark.parametrize("size", [1, 2])
def test_one_penalty_reaches_the_best_of_a_fine_grid(size):
    s, ys = _curves(size)
    x, pens = splines.tprs_design([s[:, j] for j in range(size)])
    for y, fit in zip(ys.T, residuals.tprs_gcv_many(ys, s[:, :size]), strict=True):
        grid = np.linspace(-14, 14, 1500)  # beyond, the plain score cuts off directions without a penalty
        scores = [residuals._gcv_parts(x, y, pens, np.array([r]))[0] for r in grid]
        assert fit.gcv <= min(scores) * (1 + 1e-9)
        gcv, edf, beta = residuals._gcv_parts(x, y, pens, np.minimum(np.log(fit.smoothing), 14))
        assert fit.gcv == pytest.approx(gcv, rel=1e-6) and fit.edf == pytest.approx(edf, rel=1e-5) and np.allclose(fit.residuals, y - x @ beta, atol=1e-5)


def test_gradient_and_hessian_of_several_penalties():
    s, ys = _curves(7)
    x, pens = splines.tprs_design([s[:, j] for j in range(3)])
    w = residuals.Whitened.of(x, pens)
    solves = {"analytic": 0, "differences": 0}
    for y in ys.T:
        z = w.q.T @ y
        rest = float(y @ y - z @ z)
        cost = lambda r, z=z, rest=rest: w.score(r, z, rest, len(y), False)
        for rho in (np.zeros(3), np.array([2.0, -3.0, 1.0])):
            assert cost(rho) == pytest.approx(residuals._gcv_parts(x, y, pens, rho)[0], rel=1e-8)
            _, g, h = w.score(rho, z, rest, len(y))
            _, g2, h2 = residuals.by_differences(cost, 1e-4)(rho)
            assert np.allclose(g, g2, atol=1e-6) and np.allclose(h, h2, atol=1e-5)
        ends = {}
        for name in solves:
            def counted(r, name=name, cost=cost):
                solves[name] += 1
                return cost(r)

            def slopes(r, z=z, rest=rest):
                solves["analytic"] += 1
                return w.score(r, z, rest, len(y))

            start = np.log([residuals.initial_smoothing(x, p) for p in pens])
            rho, _ = residuals.minimise(counted, slopes if name == "analytic" else residuals.by_differences(counted), start)
            ends[name] = cost(rho)
        assert ends["analytic"] == pytest.approx(ends["differences"], rel=1e-6)
    assert solves["analytic"] * 3 < solves["differences"]


def test_designs_without_full_rank():
    s, ys = _curves(8, 60)
    twice = np.column_stack((s[:, 0], s[:, 0], s[:, 1]))
    fits = residuals.tprs_gcv_many(ys, twice)
    assert all(np.isfinite(f.residuals).all() and np.isfinite(f.gcv) for f in fits)


def test_lowrank_bounds(monkeypatch):
    """What a cut to a tenth of the eigenpairs leaves out is bounded, and the bounds of p hold its value."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(ci, "EIGEN_ROWS", 100)
    cfg = CIConfig("dcc.lowrank")
    n = 600
    x = rng.normal(size=n)
    samples = [x, 0.1 * x + rng.normal(size=n), rng.exponential(size=n), rng.standard_t(2, n), np.repeat(rng.normal(size=40), 15), np.round(rng.normal(size=n), 1)]
    for v in samples:
        size = np.sort(np.abs(np.linalg.eigvalsh(np.abs(v[:, None] - v))))[::-1]
        bound = ci.left_out(v, n // 10)
        assert size[n // 10] <= bound * (1 + 1e-9) + 1e-9 and bound <= 1.6 * size[n // 10 - 3]
    for a in range(len(samples)):
        for b in range(a):
            got = ci.paired_bounded(ci.prepare_bounded(samples[a], cfg), ci.prepare_bounded(samples[b], cfg))
            want = ci.paired(ci.prepare(samples[a], cfg), ci.prepare(samples[b], cfg), cfg)
            assert got.bounds[0] - 1e-9 <= want.p_value <= got.bounds[1] + 1e-9 and got.mean == pytest.approx(want.mean)
    same = ci.paired_bounded(*(ci.prepare_bounded(samples[k], cfg) for k in (4, 4)))
    assert same.bounds[0] == same.bounds[1]  # nothing is left out


def test_lowrank_search_by_bounds(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.normal(size=n)
    data = np.column_stack((x, x + rng.normal(size=n), rng.normal(size=n)))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "i long, a double, b double, c double")
    cfg = DiscoverConfig(alpha=0.1, max_conditioning_size=1, ci=CIConfig("dcc.lowrank"))
    out = discover(df, ["a", "b", "c"], cfg, order_by=["i"])
    p = {(a, b): ci.paired(*(ci.prepare(data[:, k], cfg.ci) for k in (a, b)), cfg.ci).p_value for a, b in ((0, 1), (0, 2), (1, 2))}
    assert out.found.edges == {k for k, v in p.items() if v < 0.1}


@pytest.mark.parametrize("kind", ["line", "plane", "near copies"])
def test_thin_plates_without_the_matrix(monkeypatch, kind):
    """Leading eigenpairs from products with the matrix are the matrix's, and residuals those of all eigenpairs."""
    rng = np.random.default_rng(6)
    z = rng.normal(size=(900, 1 if kind == "line" else 2)) * ([1] if kind == "line" else [1, 0.2])
    if kind == "near copies":
        z = np.repeat(z[:300], 3, 0) * (1 + 2e-16 * rng.integers(-2, 3, (900, 2)))
    y = np.column_stack((np.sin(3 * z[:, 0]), z[:, 0] ** 2)) + 0.1 * rng.normal(size=(900, 2))
    want = residuals.residuals(y, z, "tprs_gcv")
    monkeypatch.setattr(splines, "EIGEN_PLACES", 100)
    monkeypatch.setattr(radial, "DENSE", 100)
    assert np.abs(residuals.residuals(y, z, "tprs_gcv") - want).max() < 1e-5
    z = np.unique(z - z.mean(0), axis=0)
    val, vec = radial.leading_radial(z, 10)
    e = radial.thin_plate(np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)), z.shape[1])
    size = np.linalg.eigvalsh(e)
    assert np.allclose(np.sort(np.abs(val)), np.sort(np.abs(size))[-10:], rtol=1e-5) and np.abs(vec.T @ vec - np.eye(10)).max() < 1e-8


@pytest.mark.parametrize("kind", ["plain", "ties", "same", "two", "constant"])
def test_permuted_distances_need_no_matrix(kind):
    rng = np.random.default_rng(8)
    n = 700
    x = {"two": np.arange(n) % 2, "ties": rng.integers(0, 5, n), "constant": np.zeros(n)}.get(kind, rng.normal(size=n)).astype(float)
    y = {"two": np.arange(n) // 2 % 2, "ties": rng.integers(0, 4, n), "same": x}.get(kind, rng.normal(size=n)).astype(float)
    cfg = CIConfig("dcc.perm", replicates=30, seed=5)
    a, b = (ci.centred(ci.distances(v[:, None])) for v in (x, y))
    orders = [ci.permutation(n, 5, r) for r in range(30)]
    want = np.array([np.vdot(a, b[np.ix_(o, o)]) / n for o in orders])
    got = ci.dcov_perm(x, y, cfg)
    size = max(np.abs(want).max(), 1e-9)
    stat = np.vdot(a, b) / n
    assert np.abs(np.array(got.replicates) - want).max() < 1e-8 * size and abs(got.statistic - stat) < 1e-8 * size
    assert got.p_value == ((want >= stat - 1e-9 * size).sum() + 1) / 31
    assert ci.prepare(x, cfg).matrix.nbytes <= 8 * n
    both = ci.dcov_perm(x, np.column_stack((y, y)), cfg)  # of two columns there is no order
    assert np.allclose(both.replicates, np.sqrt(2) * want, atol=1e-8 * size)


@pytest.mark.parametrize("side", [2, 7, 16, 100])
def test_concordant_sums_in_a_grid(side):
    rng = np.random.default_rng(9)
    for n in (1, 2, 15, 64, 101):
        for y in (rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.arange(n) * 1.0, -np.arange(n) * 1.0):
            x = np.sort(rng.integers(0, 9, n)) - 4.0
            rank = np.argsort(np.argsort(y, kind="stable"))
            want = sum((x[i] - x[j]) * (y[i] - y[j]) for i in range(n) for j in range(i) if y[j] < y[i])
            assert sorted_sums.concordant_in_grid(x, y, rank, side) == pytest.approx(want, abs=1e-9)
            assert sorted_sums.PermutedProducts(x, y)() == pytest.approx(sum(abs((x[i] - x[j]) * (y[i] - y[j])) for i in range(n) for j in range(n)), abs=1e-9)


def test_numbered_hashes():
    import hashlib

    from loomgraph.functions.hashes import md5_numbered

    for prefix, n in (("1|0|", 1), ("2147483646|99|", 10_001), ("", 101), ("a" * 60, 12)):
        want = [hashlib.md5(f"{prefix}{i}".encode()).digest() for i in range(n)]
        high, low = md5_numbered(prefix, n)
        assert high.tolist() == [int.from_bytes(d[:8], "big") for d in want] and low.tolist() == [int.from_bytes(d[8:], "big") for d in want]


def test_tests_of_replicates_are_dealt_out_one_by_one(spark):
    """Tests of one set and one x were one task's."""
    from loomgraph.plans.providers import matrix_provider

    x = np.random.default_rng(10).normal(size=(30, 20))
    tasks = spark.createDataFrame([(i, 0, i + 1, []) for i in range(16)], "task_id long, x int, y int, s array<int>")
    ask = matrix_provider(x, CIConfig("dcc.perm", replicates=3), partitions=4)
    told = ask(tasks).withColumn("part", F.spark_partition_id()).collect()
    ask.close()
    assert len(told) == 16 and len({r.part for r in told}) >= 6
