"""Regressions in waves: the same events as tests one by one, in few queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.config import CIConfig
from loomgraph.plans import orientation
from loomgraph.plans.providers import regression_provider
from loomgraph.plans.skeleton import Skeleton


def curved(seed, n=60, p=6):
    """A random graph of curved dependences, its skeleton, and no separating sets."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, p))
    edges = set()
    for j in range(1, p):
        for i in rng.choice(j, min(j, 2), replace=False).tolist():
            x[:, j] += np.sin(2 * x[:, i])
            edges.add((i, j))
    return x, Skeleton(p, edges)


@pytest.mark.parametrize("seed", range(4))
def test_waves_orient_like_single_tests(spark, seed):
    x, sk = curved(seed)
    settings = {"alpha": 0.1, "ci": CIConfig("dcc.gamma"), "backend": "fast_spline", "orient_collider": bool(seed % 2)}
    one = orientation.orient(sk, x, **settings)
    ask = regression_provider(x, settings["ci"], "fast_spline", partitions=3)
    two, waves = orientation.orient_in_waves(spark, sk, ask, **settings)
    ask.close()
    assert (two.pdag == one.pdag).all() and two.events == one.events and two.tests == one.tests
    assert [t[:5] + t[6:] for t in two.trace] == [t[:5] + t[6:] for t in one.trace] and np.allclose([t[5] for t in two.trace], [t[5] for t in one.trace])
    assert len(waves) <= 1 + len(one.events) and (not one.trace or sum(waves) > 0)


def test_what_was_asked_under_other_parents_is_not_used():
    """Keys hold the whole conditioning set, so a changed parent makes a new request."""
    g = np.zeros((3, 3), int)
    g[0, 1] = g[1, 0] = 1
    before = orientation._requests(g, 1, (0,))
    g[2, 1] = 1
    assert before == {(1, (0,), 0)} and orientation._requests(g, 1, (0,)) == {(1, (0, 2), 0)}


def test_without_undirected_edges_nothing_is_asked(spark):
    sk = Skeleton(3, {(0, 1), (1, 2)}, {(0, 2): ()})
    o, waves = orientation.orient_in_waves(spark, sk, lambda t: t.select("task_id", F.lit(0.5).alias("p")), alpha=0.1)
    assert waves == [] and o.pdag[0, 1] == o.pdag[2, 1] == 1


def test_failing_tests_may_have_no_p(spark):
    from loomgraph.plans.providers import matrix_provider

    x = np.column_stack((np.arange(5.0), np.arange(5.0) ** 2, np.ones(5)))  # too few rows for a gamma tail
    tasks = spark.createDataFrame([(0, 0, 1, []), (1, 0, 2, [1])], "task_id long, x int, y int, s array<int>")
    quiet = matrix_provider(x, CIConfig("dcc.gamma", on_error="na"))
    assert sorted(r.p != r.p for r in quiet(tasks).collect()) == [True, True]
    quiet.close()
    loud = matrix_provider(x, CIConfig("dcc.gamma"))
    with pytest.raises(Exception, match="six rows"):
        loud(tasks).collect()
    loud.close()


def test_records_of_a_large_trace(spark):
    """A traced search tells the whole test, and its records outlive the matrix."""
    from loomgraph.config import DiscoverConfig
    from loomgraph.plans.discover import discover
    from loomgraph.sources.scenarios import shared_roots

    out = discover(shared_roots(spark, 60, 5), ["V1", "V2", "V3", "V4", "V5"], DiscoverConfig(alpha=0.1, max_conditioning_size=1, residual="fast_spline", precision="hybrid", graph_stage="skeleton", trace=True), order_by=["row_id"])
    rows = out.tables()["ci_results"].collect()
    assert len(rows) == sum(level[1] for level in out.found.levels)
    assert all(r.method == "dcc.gamma" and r.variance > 0 and r.attempts in (1, 2) and r.source in ("primary", "verifier") and (r.attempts == 2) >= (r.source == "verifier") for r in rows)
    assert out.cache["requests"] >= out.cache["fits"] > 0


def test_command_line_options(spark, tmp_path, capsys):
    import json

    from loomgraph import cli
    from loomgraph.sources.scenarios import shared_roots

    shared_roots(spark, 60, 3).write.csv(str(tmp_path / "in.csv"), header=True)
    args = ["--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "out"), "--order-by", "row_id", "--index", "1.5", "--gaps", "V1:V2", "--keep", "V2:V3", "--labels", "a,b,c", "--trace", "--graph-stage", "skeleton", "--on-error", "na"]
    assert cli.main(args) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["settings"]["ci"]["index"] == 1.5 and not told["settings"]["ci"]["legacy_index"]
    edges = {(r.x, r.y) for r in spark.read.parquet(str(tmp_path / "out" / "edges")).collect()}
    assert (0, 1) not in edges and (1, 2) in edges
    assert spark.read.parquet(str(tmp_path / "out" / "ci_results")).filter("statistic is not null").count() > 0
    with pytest.raises(ValueError, match="no pair"):
        cli.main([*args, "--gaps", "V1:zz"])
