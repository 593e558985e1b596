"""Numbers of sets: ranks to sets and back, plans by ranks, and what the search makes of them."""

import itertools

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import layer, patterns
from loomgraph.plans.providers import formula_provider
from loomgraph.plans.skeleton import search


@pytest.mark.parametrize("size", [0, 1, 2, 3, 5, 7])
def test_ranks(spark, size):
    items = [1, 4, 5, 9, 12, 13, 20]
    want = list(itertools.combinations(items, size))
    df = spark.range(len(want)).select(F.col("id").alias("n"), F.array(*map(F.lit, items)).alias("items"))
    got = df.select("n", layer.unrank(F.col("items"), size, F.col("n")).alias("s"), "items").select("n", "s", layer.rank_of(F.col("items"), F.col("s")).alias("back")).orderBy("n").collect()
    assert [tuple(r.s) for r in got] == want and [r.back for r in got] == list(range(len(want)))


def test_spread_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(layer, "STRETCH", 7)
    df = spark.createDataFrame([(0, 0, 50), (1, 3, 3), (2, 5, 6), (3, 10, 2)], "k int, a long, b long")
    got = sorted((r.k, r.n) for r in layer.spread(df, F.col("a"), F.col("b"), "n").collect())
    assert got == [(0, i) for i in range(50)] + [(2, 5)]


@pytest.mark.parametrize("level", [0, 1, 2, 3])
def test_plans_by_ranks_are_the_plan(spark, level):
    edges = spark.createDataFrame([(x, y) for x in range(7) for y in range(x + 1, 7) if (x * y) % 5 != 1], "x int, y int")
    plan = {r.task_id: r for r in layer.layer_plan(edges, level).collect()}
    sided = layer.sides(edges, level).cache()
    got, at = [], 0
    for step in (1, 3, 4, 100):
        got += layer.plan_ranks(sided, level, at, at + step).collect()
        at += step
    assert len(got) == len(plan) and all(plan[r.task_id] == r for r in got)


def test_a_hub_of_forty_neighbours(spark):
    """Level 3 around a hub: a wave makes its ranks only, and the last of them."""
    edges = spark.createDataFrame([(0, y) for y in range(1, 41)], "x int, y int")
    sided = layer.sides(edges, 3)
    n = 39 * 38 * 37 // 6
    some = layer.plan_ranks(sided, 3, n - 2, n + 50).filter("edge_y = 40").collect()
    assert sorted(tuple(r.s) for r in some) == [(36, 37, 39), (36, 38, 39), (37, 38, 39)][-2:]


def test_waves_do_not_change_results(spark):
    p = formula_provider(lambda x, y, s: F.pmod(F.least(x, y).cast("long") * 37 + F.greatest(x, y) * 11 + F.size(s) * 5 + F.aggregate(s, F.lit(0).cast("long"), lambda a, v: a + v * 3), F.lit(100)) / 100.0)
    one = search(spark, 7, p, alpha=0.93, fixed=[(0, 1)])
    for waves in ((1,), (2, 5)):
        two = search(spark, 7, p, alpha=0.93, fixed=[(0, 1)], waves=waves)
        assert (two.edges, two.sepsets, two.pmax, two.levels, two.deletions) == (one.edges, one.sepsets, one.pmax, one.levels, one.deletions)
        assert sum(two.evaluated) <= sum(one.evaluated)


def test_numbers_without_a_global_window(spark):
    tasks = spark.createDataFrame([(x, y, [s]) for x in range(3) for y in range(3) if x != y for s in range(4)], "x int, y int, s array<int>").repartition(5)
    got = sorted((r["rank"], r.x, r.y, tuple(r.s)) for r in layer.in_pcalg_order(tasks).collect())
    assert [g[1:] for g in got] == sorted(g[1:] for g in got) and [g[0] for g in got] == list(range(24))


def test_triples_of_a_wide_node(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), *((0, y) for y in range(3, 15))], "x int, y int")
    n = patterns.triple_tests(edges).filter("x = 0 and z = 2").count()
    assert n == 2**13  # all subsets of the thirteen other neighbours of 0, the empty one from both ends
