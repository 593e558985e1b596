"""Kernels as polynomials, full ranks, and layouts that do not grow faster than the rows."""

import numpy as np
import pytest

from loomgraph.config import CIConfig
from loomgraph.functions import kernels, smooth, sorted_sums, tiles
from loomgraph.operators import analytics, ci, moment_splines

from .test_large import frame, numbers, told


@pytest.mark.parametrize("low, high, sig", [(0.0, 1.0, 1.0), (-3.0, 3.0, 0.1), (5.0, 5.0, 1.0), (0.0, 1e-9, 1.0), (-1e3, 1e3, 1e4)])
def test_an_expansion_is_the_kernel(low, high, sig):
    x = np.append(np.random.default_rng(1).uniform(low, high, 300), [low, high])
    m = smooth.terms(low, high, sig)
    t = smooth.polynomials(x, low, high, m)
    assert np.abs(t @ smooth.coefficients(low, high, sig, m) @ t.T - np.exp(-((x[:, None] - x) ** 2) / sig)).max() < 1e-13


def test_rbf_sums_make_no_pairs(spark, monkeypatch):
    """Tiles made n^2 pairs of kernels that need one pass; where a range is too wide for its sig they still do."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 120))
    want = told(ci.hsic_gamma(x, y, 0.3))
    k, l = (tiles.Kernel((c,), "rbf", sig=0.3) for c in ("v0", "v1"))
    df = frame(spark, [x, y])
    by_tiles = numbers(kernels.hsic_tail(kernels.from_totals(kernels.row_totals(tiles.row_sums(df, k, l, 32)))).first())
    wide = frame(spark, [x * 1e4, y])
    assert smooth.rbf_sums(wide, "v0", "v1") is None
    assert np.allclose(numbers(kernels.hsic_tail(tiles.centred_sums(wide, tiles.Kernel(("v0",), "rbf"), tiles.Kernel(("v1",), "rbf"), 32)).first()), told(ci.hsic_gamma(x * 1e4, y)), rtol=1e-9)
    monkeypatch.setattr(tiles, "row_sums", None)
    got = numbers(kernels.hsic_tail(tiles.centred_sums(df, k, l, 32)).first())
    assert np.allclose(got, want, rtol=1e-9) and np.allclose(got, by_tiles, rtol=1e-9)


@pytest.mark.parametrize("method", ["hsic.gamma", "hsic.perm"])
@pytest.mark.parametrize("scale", [(1, 1), (1e4, 1), (1e4, 1e4)])
def test_large_kernel_parts(monkeypatch, method, scale):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 90)) * np.array(scale)[:, None]
    cfg = CIConfig(method, replicates=19)
    want = ci.run_test(x, y, cfg)
    monkeypatch.setattr(ci, "MATRIX_ROWS", 50)
    assert ci.prepare(x, cfg).kind == ("smooth" if scale[0] == 1 else "large")
    got = ci.run_test(x, y, cfg)
    assert np.allclose(told(got), told(want), rtol=1e-9) and np.allclose(got.replicates, want.replicates, rtol=1e-9)


def test_a_full_rank_needs_no_eigenpairs(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2, 80))
    y = y + x / 4
    d = [ci.distances(v[:, None]) for v in (x, y)]
    (a, u), (b, v) = (ci.top_eigen(k, 80) for k in d)
    u, v = u - u.mean(0), v - v.mean(0)
    by_eigenpairs = float(((u.T @ v) ** 2 * np.outer(a, b)).sum()) / 80
    monkeypatch.setattr(ci, "top_eigen", None)
    for rows in (8192, 50):
        monkeypatch.setattr(ci, "MATRIX_ROWS", rows)
        got, want = ci.dcov_lowrank(x, y, 1000), ci.dcov_gamma(x, y)
        assert got.method == "dcc.lowrank" and got.statistic == pytest.approx(by_eigenpairs) and np.allclose(told(got), told(want), rtol=1e-9)


def test_factors_read_a_written_sample_once_a_pivot(spark, tmp_path):
    """Each pivot evaluated the query behind the sample anew."""
    import uuid

    from pyspark.sql import functions as F

    from loomgraph.operators import factors

    folder = tmp_path / "seen"
    folder.mkdir()

    @F.udf("double")
    def seen(v):
        (folder / uuid.uuid4().hex).touch()
        return v

    rng = np.random.default_rng(6)
    df = frame(spark, rng.normal(size=(2, 40)), 1).withColumn("v0", seen.asNondeterministic()("v0"))
    factors.hsic_lowrank(df, ["v0"], ["v1"], num_col=8)
    assert len(list(folder.iterdir())) == 40


def test_blocks_and_tiles_do_not_multiply():
    """Small blocks gave n / 8 partitions for each level, small tiles (n / 16)^2 / 2 tasks and n / 16 copies of each row."""
    assert [sorted_sums.block_count(n, 8) for n in (0, 20, 1_000, 360_000, 1 << 21)] == [1, 3, 16, 16, 32]
    assert [tiles.block_count(n, 16) for n in (0, 40, 1_000, 200_000, 360_000)] == [1, 3, 16, 16, 22]
    assert sorted_sums.block_count(1 << 21) == 32 and tiles.block_count(5_000, 1024) == 5


@pytest.mark.parametrize("cells", [128 * 5, 1 << 17])
def test_tiles_in_cells(spark, monkeypatch, cells):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(3, 300)), 1)
    k, l = tiles.Kernel(("v0", "v1")), tiles.Kernel(("v2",), "rbf")
    monkeypatch.setattr(tiles, "CELLS", cells)
    got = {r.i: [r[c] for c in ("rk", "rl", "kl", "kk", "ll", "ok", "ol")] for r in tiles.row_sums(frame(spark, x), k, l, 140).collect()}
    a, b = ci.distances(x[:2].T), ci.rbf(x[2][:, None], 1.0)
    want = np.column_stack((a.sum(1), b.sum(1), (a * b).sum(1), (a * a).sum(1), (b * b).sum(1), a.sum(1), b.sum(1) - 1))
    assert np.allclose([got[i] for i in range(300)], want, rtol=1e-10)


def test_pairs_of_runs_are_made_in_all_tasks(spark):
    runs = spark.createDataFrame([(i, "ok" if i % 5 else "error", float(i)) for i in range(60)], "run_id long, status string, value double").coalesce(1)
    out = analytics.pairwise_runs(runs)
    kept = [i for i in range(60) if i % 5]
    assert sorted((r.i, r.j, r["diff"]) for r in out.collect()) == [(i, j, float(j - i)) for i in kept for j in kept if i < j]
    assert out.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_splines_read_a_written_sample_once(spark, tmp_path):
    """Quantiles, sums and residuals each evaluated the query behind the rows anew."""
    import uuid

    from pyspark.sql import functions as F

    folder = tmp_path / "seen"
    folder.mkdir()

    @F.udf("double")
    def seen(v):
        (folder / uuid.uuid4().hex).touch()
        return v

    rng = np.random.default_rng(8)
    df = frame(spark, rng.normal(size=(2, 60)), 1).withColumn("v0", seen.asNondeterministic()("v0"))
    assert moment_splines.spline_residuals(df, ["v1"], ["v0"]).count() == 60 and len(list(folder.iterdir())) == 60


def test_concordant_sums_sort_once(monkeypatch):
    """Each bit of the ranks sorted all rows anew."""
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 37, 64, 300):
        x, y, w = rng.integers(0, 40, n) / 8, rng.normal(size=n), rng.integers(1, 4, n).astype(float)
        up = (x[:, None] > x) & (y[:, None] > y)
        want = float((np.outer(w, w) * (x[:, None] - x) * (y[:, None] - y) * up).sum())
        calls, sort = [], np.argsort
        monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or sort(*a, **k))
        got = sorted_sums.concordant_in_block(x, y, w)
        monkeypatch.undo()
        assert got == pytest.approx(want) and len(calls) == 1
