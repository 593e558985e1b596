from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.config import CIConfig, DiscoverConfig
from loomgraph.operators import graphdiff, layer, patterns, precision
from loomgraph.plans import orientation, providers
from loomgraph.plans.discover import discover, kernel_ci_test
from loomgraph.plans.skeleton import Skeleton, search
from loomgraph.sources import scenarios, sinks
from loomgraph.sources.matrix import complete_cases


def formula(x, y, s, turn):
    return ((min(x, y) * 7919 + max(x, y) * 104729 + turn * 31 + sum(v * 13 for v in s) + len(s) * 57) % 1000) / 1000


def naive(p, test, alpha, top):
    edges, sep, pmax, levels = set(combinations(range(p), 2)), {}, {}, []
    for level in range(min(top, p - 2) + 1):
        near = {v: sorted(u for u in range(p) if (min(u, v), max(u, v)) in edges) for v in range(p)}
        gone, tests, opens, planned = [], 0, False, 0
        for x, y in sorted(edges):
            done = False
            for a, b in ((x, y), (y, x)):
                pool = [u for u in near[a] if u != b]
                for k, s in enumerate(combinations(pool, level)):
                    planned += 1
                    if done:
                        continue
                    tests += 1
                    opens |= k == 0 and len(pool) > level
                    q = test(a, b, s)
                    pmax[x, y] = max(pmax.get((x, y), -1), q)
                    if q >= alpha:
                        sep[x, y] = s
                        gone.append((x, y))
                        done = True
        if not planned:
            break
        edges -= set(gone)
        levels.append((level, tests, planned, len(gone)))
        if not opens:
            break
    return edges, sep, pmax, levels


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(p=st.integers(3, 6), turn=st.integers(0, 99), alpha=st.sampled_from([0.5, 0.8, 0.95]))
def test_search_equals_a_sequential_loop(spark, p, turn, alpha):
    got = search(spark, p, providers.callback_provider(lambda x, y, s: formula(x, y, s, turn), 3), alpha=alpha)
    assert (got.edges, got.sepsets, got.pmax, got.levels) == naive(p, lambda x, y, s: formula(x, y, s, turn), alpha, p)


def test_constraints_and_original(spark):
    table = spark.createDataFrame([(0, 1, "", 0.9), (0, 2, "", 0.01), (1, 2, "", 0.01), (0, 2, "1", 0.9), (1, 2, "0", 0.9)], "x int, y int, s_key string, p double")
    got = search(spark, 3, providers.table_provider(table), alpha=0.5, fixed=[(1, 0)], na_delete=False)
    assert (0, 1) in got.edges and (0, 2) not in got.edges
    got = search(spark, 3, providers.table_provider(table), alpha=0.5, gaps=[(2, 0)])
    assert got.edges == {(1, 2)} and got.sepsets == {(0, 1): ()}
    original = search(spark, 3, providers.table_provider(table), alpha=0.5, na_delete=False, method="original")
    assert (0, 1) not in original.edges


def _matrix(seed=4, n=140):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.uniform(-np.pi, np.pi, (2, n))
    return np.column_stack((x1, x2, np.sin(x1) + np.cos(x2) + 0.12 * rng.normal(size=n), rng.normal(size=n)))


def test_collider_is_found_whatever_the_order(spark):
    x = _matrix()
    results = set()
    for seed, parts in ((0, 1), (1, 8)):
        order = np.random.default_rng(seed).permutation(len(x))
        df = spark.createDataFrame([(int(i), *map(float, x[i])) for i in order], "row_id long, a double, b double, c double, d double").repartition(parts)
        out = discover(df, ["a", "b", "c", "d"], DiscoverConfig(alpha=0.05, residual="fast_spline"), order_by=["row_id"])
        results.add(tuple(sorted((r.a, r.b, r.mark) for r in out.pdag().collect())))
    assert len(results) == 1
    assert {("a", "c", 1), ("b", "c", 1)} <= set(results.pop())


def test_permuted_columns_give_the_same_graph(spark):
    x = _matrix(9)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double, d double")
    cfg = DiscoverConfig(alpha=0.05, graph_stage="skeleton", max_conditioning_size=1)
    one, two = (discover(df, c, cfg, order_by=["row_id"]).skeleton().collect() for c in (["a", "b", "c", "d"], ["d", "c", "b", "a"]))
    assert {frozenset(r) for r in one} == {frozenset(r) for r in two}


@pytest.mark.parametrize("name", ["chain", "fork", "collider", "additive", "independent"])
def test_scenarios(spark, name):
    df = scenarios.scenario(spark, name, 140, 3)
    out = discover(df, ["x1", "x2", "x3", "x4"], DiscoverConfig(alpha=0.01, graph_stage="skeleton", max_conditioning_size=0), order_by=["row_id"])
    truth = {tuple(sorted(e)) for e in scenarios.TRUTH[name]}
    assert truth <= out.found.edges


def test_methods_and_gauss(spark):
    df = scenarios.linear_blocks(spark, 200, 2)
    cols = [c for c in df.columns if c != "row_id"]
    out = discover(df, cols, DiscoverConfig(alpha=0.05, ci=CIConfig("gauss")), order_by=["row_id"])
    assert {(min(a, b) // 5, max(a, b) // 5) for a, b in out.found.edges} <= {(0, 0), (1, 1), (0, 1)}
    assert out.summary()["variables"] == 10 and set(out.tables()) >= {"edges", "sepsets", "pmax", "levels", "deletions", "pdag", "orientation_events"}
    x = _matrix()
    for m in ("dcc.gamma", "dcc.perm", "hsic.gamma", "hsic.perm", "hsic.clust", "dcc.lowrank"):
        cfg = DiscoverConfig(ci=CIConfig(m, replicates=20), residual="fast_spline")
        assert kernel_ci_test(x, 0, 2, (), cfg) < 0.06
        assert 0 <= kernel_ci_test(x, 0, 1, (3,), cfg) <= 1
    for extra in ({"precision": "hybrid"}, {"conservative": True}, {"majority": True}, {"skeleton_method": "original"}):
        sdf = scenarios.scenario(spark, "additive", 60, 2)
        discover(sdf, ["x1", "x2", "x3", "x4"], DiscoverConfig(max_conditioning_size=1, **extra), order_by=["row_id"])


def _sk(p, edges, seps=None):
    return Skeleton(p, {tuple(sorted(e)) for e in edges}, seps or {})


def test_orientation_rules():
    o = orientation.orient(_sk(3, [(0, 1), (1, 2)], {(0, 2): ()}), None)
    assert o.pdag.tolist() == [[0, 1, 0], [0, 0, 0], [0, 1, 0]]
    o = orientation.orient(_sk(4, [(0, 1), (1, 2), (1, 3)], {(0, 2): (), (0, 3): (1,), (2, 3): (1,)}), None)
    assert o.pdag[1, 3] == 1 and o.pdag[3, 1] == 0  # rule 1
    g = orientation.Orientation(np.array([[0, 1, 1], [1, 0, 0], [0, 1, 0]]))
    g.pdag = np.array([[0, 1, 1], [1, 0, 0], [0, 1, 0]])
    orientation.apply_rules(g)
    assert g.pdag[0, 1] == 1 and g.pdag[1, 0] == 0  # rule 2
    three = np.array([[0, 1, 1, 1], [1, 0, 0, 0], [1, 1, 0, 0], [1, 1, 0, 0]])
    g = orientation.Orientation(three.copy())
    orientation.apply_rules(g, (False, False, True))
    assert g.pdag[0, 1] == 1 and g.pdag[1, 0] == 0  # rule 3
    clash = orientation.Orientation(orientation.adjacency(_sk(4, [(0, 1), (1, 2), (2, 3)])))
    orientation.orient_colliders(clash, lambda a, b: (), True)
    assert clash.pdag[1, 2] == 2 and clash.pdag[2, 1] == 2
    assert orientation.orient(_sk(3, []), None).events == []


def test_pattern_joins_agree_with_the_array_rules(spark):
    rng = np.random.default_rng(1)
    for _ in range(4):
        p = 7
        g = np.zeros((p, p), int)
        for a, b in combinations(range(p), 2):
            k = rng.integers(0, 5)
            g[a, b], g[b, a] = ((0, 0), (1, 1), (1, 0), (0, 1), (1, 1))[k]
        df = spark.createDataFrame([(int(a), int(b), int(g[a, b])) for a, b in zip(*np.nonzero(g), strict=True)], "a int, b int, mark int")
        # A sequential pass may go on from what it wrote; it starts only where the join finds something.
        for join, rule in ((patterns.rule1, orientation._rule1), (patterns.rule2, orientation._rule2), (patterns.rule3, orientation._rule3)):
            o = orientation.Orientation(g.copy())
            rule(o)
            found = {(r.a, r.b) for r in join(df).collect()}
            assert bool(found) == bool(o.events)
            assert not o.events or o.events[0][3:5] in found
        o = orientation.Orientation(g.copy())
        orientation.apply_rules(o)
        still = spark.createDataFrame([(int(a), int(b), int(o.pdag[a, b])) for a, b in zip(*np.nonzero(o.pdag), strict=True)], "a int, b int, mark int")
        assert not any(join(still).count() for join in (patterns.rule1, patterns.rule2, patterns.rule3))
        asked = [(v, list(s)) for v in range(p) for s in combinations(range(p), 2) if v not in s]
        got = {(r.v, tuple(r.s)): r.ok for r in patterns.check_immor(df, spark.createDataFrame(asked, "v int, s array<int>")).collect()}
        assert got == {(v, tuple(s)): orientation.check_immor(g, v, s) for v, s in asked}


def test_precision(spark):
    t = spark.createDataFrame([(0, 0.1, 0.3), (1, 0.9, 0.01), (2, float("nan"), 0.02), (3, 0.15, None)], "task_id long, p double, v double")
    rows = {r.task_id: (r.source, r.p_final) for r in precision.verify(t.select("task_id", "p"), t.select("task_id", F.col("v").alias("p")), 0.2, 0.7).collect()}
    assert rows == {0: ("verifier", 0.3), 1: ("primary", 0.9), 2: ("verifier", 0.02), 3: ("primary", 0.15)}
    with pytest.raises(ValueError, match="lacks"):
        precision.verify(t.select("task_id"), t, 0.2, 0.7)
    assert precision.formula_text("x1", ["x2", "x3"]) == "x1 ~ s(x2,x3)" and precision.formula_text("y", ["a", "b", "c"]) == "y ~ s(a) + s(b) + s(c)"
    bad = lambda tasks: tasks.select("task_id", F.when(F.col("task_id") > 1, F.lit(0.5)).alias("p"))
    good = lambda tasks: tasks.select("task_id", F.lit(0.25).alias("p"))
    got = {r.task_id: (r.p, r.attempts) for r in precision.fallback_chain(t.select("task_id"), [bad, good]).collect()}
    assert got == {0: (0.25, 2), 1: (0.25, 2), 2: (0.5, 1), 3: (0.5, 1)}


def test_diff_and_sinks(spark, tmp_path):
    e = lambda *p: spark.createDataFrame(p, "x int, y int")
    d = {(r.x, r.y): r.status for r in graphdiff.adjacency_diff(e((0, 1), (1, 2)), e((1, 2), (2, 3))).collect()}
    assert d == {(0, 1): "removed", (1, 2): "unchanged", (2, 3): "added"}
    assert graphdiff.skeleton_shd(e((0, 1)), e((0, 1))).first().shd == 0
    tables = {"edges": e((0, 1)), "seps": spark.createDataFrame([(0, [1, 2])], "x int, s array<int>")}
    text = sinks.write_report(spark, tables, {"alpha": 0.1}, str(tmp_path / "r"))
    assert "## edges" in text
    sinks.write_tables(tables, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/seps")).first().s == [1, 2]


def test_complete_cases(spark):
    rows = [(i, float(i), None if i % 5 == 0 else 1.0, float("nan") if i == 3 else 2.0, "t") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, t string")
    assert complete_cases(df, ["a", "b", "c"], order_by="k").count() == 31
    with pytest.raises(ValueError):
        complete_cases(df.limit(3), ["a", "b", "c"])


def test_empty_plan(spark):
    assert layer.layer_plan(spark.createDataFrame([], "x int, y int"), 1).count() == 0
