"""Orientation against a second implementation, methods against their definitions, the command line, a real stream, and a copy without the optional parts."""

import itertools
import json
import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import cli
from loomgraph.config import CIConfig, DiscoverConfig
from loomgraph.operators import ci, patterns, precision, residuals
from loomgraph.plans import orientation, providers
from loomgraph.plans.discover import discover
from loomgraph.plans.skeleton import Skeleton
from loomgraph.sources.scenarios import shared_roots
from loomgraph.streaming.windows import window_moments

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class Plain:
    """Orientation on sets of lines and arrows, written without a matrix."""

    def __init__(self, p, edges):
        self.p, self.lines, self.arrows = p, {frozenset(e) for e in edges}, set()

    def near(self, a, b):
        return frozenset((a, b)) in self.lines or (a, b) in self.arrows or (b, a) in self.arrows

    def point(self, a, b):
        self.lines.discard(frozenset((a, b)))
        self.arrows.discard((b, a))
        self.arrows.add((a, b))

    def line(self, a, b):
        return frozenset((a, b)) in self.lines

    def colliders(self, sep):
        lines = {frozenset(e) for e in self.lines}
        for y in range(self.p):
            for x, z in itertools.permutations(range(self.p), 2):
                if {frozenset((x, y)), frozenset((y, z))} <= lines and frozenset((x, z)) not in lines and y not in sep(x, z):
                    self.point(x, y)
                    self.point(z, y)

    def by_second(self, pairs):
        return sorted(pairs, key=lambda e: (e[1], e[0]))

    def rules(self):
        while True:
            before = (set(self.lines), set(self.arrows))
            for a, b in self.by_second(self.arrows):
                for c in range(self.p):
                    if c != a and self.line(b, c) and not self.near(a, c):
                        self.point(b, c)
            for a, b in self.by_second(e for x in self.lines for e in itertools.permutations(x)):
                if self.line(a, b) and any((a, c) in self.arrows and (c, b) in self.arrows for c in range(self.p)):
                    self.point(a, b)
            for a, b in self.by_second(e for x in self.lines for e in itertools.permutations(x)):
                if self.line(a, b):
                    via = [c for c in range(self.p) if self.line(a, c) and (c, b) in self.arrows]
                    if any(not self.near(c, d) for c, d in itertools.combinations(via, 2)):
                        self.point(a, b)
            if before == (self.lines, self.arrows):
                return

    def allowed(self, v, s):
        parents = [a for a, b in self.arrows if b == v]
        return all(self.near(a, b) for a, b in itertools.combinations(s, 2)) and all(self.near(u, m) for u in parents for m in s if u != m)

    def step(self, bad):
        around = lambda: {v: [u for u in range(self.p) if u != v and self.line(u, v)] for v in range(self.p)}
        sets = lambda of: (s for k in range(len(of), 0, -1) for s in itertools.combinations(of, k))
        hood, moved, size = around(), set(), 1
        while any(len(n) >= size for n in hood.values()):
            for v in range(self.p):
                if len(hood[v]) == size or (len(hood[v]) < size and v in moved):
                    for s in sets(hood[v]):
                        if self.allowed(v, s) and not bad(v, s):
                            if any(v in t and self.allowed(w, t) and not bad(w, t) for w in s for t in sets(hood[w])):
                                continue
                            for u in hood[v]:
                                if u in s:
                                    self.point(u, v)
                                elif self.line(u, v):
                                    self.point(v, u)
                            self.rules()
                            hood = around()
                            moved.add(v)
                            break
            size += 1

    def pdag(self):
        return {*((a, b) for x in self.lines for a, b in itertools.permutations(x)), *self.arrows}


@pytest.mark.parametrize("seed", range(60))
def test_orientation_by_a_second_implementation(seed):
    rng = np.random.default_rng(seed)
    p = int(rng.integers(4, 9))
    edges = {e for e in itertools.combinations(range(p), 2) if rng.random() < (0.3, 0.5, 0.8)[seed % 3]}
    seps = {e: tuple(int(v) for v in range(p) if v not in e and rng.random() < 0.6) for e in itertools.combinations(range(p), 2) if e not in edges}
    bad = lambda v, s: int((v * 7919 + sum(m * 31 for m in s) + seed) % 4 == 0)
    o = orientation.Orientation(orientation.adjacency(Skeleton(p, edges, seps)))
    plain = Plain(p, edges)
    sep = lambda a, b: seps.get((min(a, b), max(a, b)), ())
    if seed % 5:  # colliders as they stand; else lines alone
        orientation.orient_colliders(o, sep)
        plain.colliders(sep)
    orientation.apply_rules(o)
    plain.rules()
    if seed % 2:
        orientation.generalised_step(o, bad, (True, True, True))
        plain.step(bad)
    assert {(int(a), int(b)) for a, b in zip(*np.nonzero(o.pdag), strict=True)} == plain.pdag()


def test_causes_point_at_their_effect(spark):
    """Two causes of one variable, and one that has no part in it; the trace has every test that counted."""
    rng = np.random.default_rng(4)
    n = 160
    a, b = rng.uniform(-np.pi, np.pi, (2, n))
    c = np.sin(a) + np.cos(b) + 0.12 * rng.normal(size=n)
    d = rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.column_stack((a, b, c, d)))], "i long, a double, b double, c double, d double")
    out = discover(df, ["a", "b", "c", "d"], DiscoverConfig(alpha=0.05, residual="fast_spline", max_conditioning_size=1, trace=True), order_by=["i"])
    found = {(r.a, r.b) for r in out.pdag().collect()}
    assert {("a", "c"), ("b", "c")} <= found and not found & {("c", "a"), ("c", "b")}
    tested = out.tables()["ci_results"].collect()
    assert len(tested) == out.summary()["tests"] and out.summary()["regression_step"] and out.summary()["residual_cache"]["fits"] > 0
    assert sum(r.deletes for r in tested) == len(out.found.deletions)


def test_ambiguous_triples_by_any_provider(spark):
    edges = {(0, 1), (1, 2), (0, 3), (2, 3)}
    p = lambda x, y, s: 0.9 if s in ((), (1,), (3,)) else 0.0
    provider = providers.callback_provider(lambda x, y, s: p(x, y, tuple(sorted(s))), 2)
    assert orientation.unfaithful_triples(spark, Skeleton(4, edges), provider, 0.5) == {(0, 1, 2), (0, 3, 2)}  # 1 and 3 are each in one of three sets; only the empty set separates 1 and 3
    assert orientation.unfaithful_triples(spark, Skeleton(4, set()), provider, 0.5) == frozenset()
    g = patterns.triple_tests(spark.createDataFrame(sorted(edges), "x int, y int"))
    assert g.count() == 4 * 4


def test_parts_and_definitions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4))
    cols = list(x.T)
    for cfg in (CIConfig("dcc.gamma"), CIConfig("hsic.gamma"), CIConfig("hsic.gamma", num_col=8), CIConfig("dcc.lowrank", num_col=9), CIConfig("dcc.perm", replicates=9), CIConfig("hsic.perm", replicates=9), CIConfig("hsic.perm", replicates=9, num_col=6)):
        many = ci.test_pairs(cols, [(0, 1), (0, 2), (3, 1)], cfg)
        assert [r.p_value for r in many] == [ci.run_test(cols[a], cols[b], cfg).p_value for a, b in ((0, 1), (0, 2), (3, 1))]
    # hsic.perm by factors: permuting rows of the centred factor of y.
    cfg = CIConfig("hsic.perm", replicates=7, num_col=6, seed=3)
    fx, fy = (f - f.mean(0) for f in (ci.inchol(c[:, None], 1.0, 6) for c in cols[:2]))
    stat = lambda f: np.linalg.norm(fx.T @ f) ** 2 / 40**2
    reps = [stat(fy[ci.permutation(40, 3, r)]) for r in range(7)]
    got = ci.hsic_perm(cols[0], cols[1], cfg)
    assert got.statistic == pytest.approx(stat(fy)) and got.replicates == pytest.approx(reps)
    assert got.p_value == (sum(r >= stat(fy) for r in reps) + 1) / 8
    import hashlib

    order = sorted(range(500), key=lambda i: hashlib.md5(f"4|2|{i}".encode()).hexdigest())
    assert ci.permutation(500, 4, 2).tolist() == order  # one law at every size
    # hsic.clust finds clusters in each replicate.
    seen = []
    real = ci.kmeans
    ci.kmeans = lambda z, k, seed=1, steps=100: seen.append(seed) or real(z, k, seed, steps)
    try:
        ci.hsic_clust(cols[0], cols[1], cols[2], CIConfig("hsic.clust", replicates=5))
    finally:
        ci.kmeans = real
    assert len(set(seen)) == 5


@pytest.mark.parametrize("method", ["dcc.gamma", "dcc.perm", "hsic.gamma", "hsic.perm"])
@pytest.mark.parametrize("index", [1.0, 1.5])
@pytest.mark.parametrize("dims", [1, 2])
def test_large_samples_give_the_same_values(monkeypatch, method, index, dims):
    """Beyond the rows of a matrix, blocks and sorted order give what the matrix gives, ties included."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 40, (300, dims)) / 10, rng.normal(size=(300, dims))
    cfg = CIConfig(method, index=index, legacy_index=False, replicates=7)
    small = ci.run_test(x, y, cfg)
    monkeypatch.setattr(ci, "MATRIX_ROWS", 100)
    monkeypatch.setattr(ci, "_BLOCK", 64)
    large = ci.run_test(x, y, cfg)
    assert np.allclose([large.p_value, large.statistic, large.mean, large.variance], [small.p_value, small.statistic, small.mean, small.variance], rtol=1e-10)
    assert np.allclose(large.replicates, small.replicates, rtol=1e-9)


def test_hundred_thousand_rows():
    rng = np.random.default_rng(6)
    x = rng.normal(size=100_000)
    free, bound = ci.dcov_gamma(x, rng.normal(size=len(x))), ci.dcov_gamma(x, x**2 + rng.normal(size=len(x)))
    assert free.p_value > 1e-3 and bound.p_value < 1e-6


def test_shared_fits_and_solves():
    rng = np.random.default_rng(3)
    s, ys = rng.normal(size=(60, 2)), rng.normal(size=(60, 3))
    for backend in ("linear", "fast_spline", "tprs_gcv"):
        many = residuals.residuals(ys, s, backend)
        assert np.allclose(many, np.column_stack([residuals.residual(y, s, backend) for y in ys.T]), atol=1e-9)
    x = rng.normal(size=(50, 4))
    y = x @ [1.0, 2.0, 0.0, 1.0]
    for scale, how in ((1.0, "cholesky"), (1e-5, "qr"), (1e-9, "svd")):
        z = x * [1, 1, 1, scale]
        beta, route = residuals.fixed_solve(z, y, np.diag([0, 0.5, 0, 0.0]))
        assert route == how
        want = np.linalg.lstsq(np.vstack((z, np.sqrt(0.5) * np.eye(4)[1:2])), np.append(y, 0.0), rcond=np.sqrt(np.finfo(float).eps))[0]
        assert np.allclose(z @ beta, z @ want, atol=1e-4)
    t = np.linspace(0, 1, 80)
    gap = residuals.oracle_gap(np.sin(6 * t) + 0.2 * rng.normal(size=80), np.sin(6 * t), t[:, None])
    assert 0 <= gap < 1


def test_fallbacks_and_injection(spark):
    tasks = spark.createDataFrame([(i, 0, 1, [2]) for i in range(9)], "task_id long, x int, y int, s array<int>")
    good = providers.callback_provider(lambda x, y, s: 0.4, 2)
    broken = precision.inject(good, F.col("task_id") % 3 == 0, float("nan"))
    got = {r.task_id: (r.p, r.attempts) for r in precision.fallback_chain(tasks, [broken, good]).collect()}
    assert got == {i: (0.4, 2 if i % 3 == 0 else 1) for i in range(9)}


def test_command_line(spark, tmp_path, capsys):
    shared_roots(spark, 40, 3).coalesce(1).write.csv(str(tmp_path / "in.csv"), header=True)
    assert cli.main(["--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "out"), "--order-by", "row_id", "--alpha", "0.1", "--max-conditioning-size", "1", "--report"]) == 0
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    edges = spark.read.parquet(str(tmp_path / "out" / "edges"))
    assert summary["variables"] == 3 and edges.count() == summary["edges"]
    assert spark.read.csv(str(tmp_path / "out" / "report" / "levels"), header=True).count() == summary["levels"]


def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = spark.range(400).selectExpr("timestamp_seconds(id * 7) AS at", "sin(id) AS a", "cos(id * 0.9) AS b")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = window_moments(stream, "at", ["a", "b"], "10 minutes").writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda rs: sorted((str(r.start), r.n, round(r.c_0_1, 9)) for r in rs)
    assert key(spark.sql("select * from win").collect()) == key(window_moments(rows, "at", ["a", "b"], "10 minutes").collect())


def test_a_copy_without_the_optional_parts(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
