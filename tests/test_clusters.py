"""Clusters of many rows against a plain search of all centres."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.config import CIConfig
from loomgraph.functions import clusters
from loomgraph.operators import ci
from loomgraph.plans.providers import matrix_provider


def plain(z, k, seed, steps=100):
    """Lloyd's steps, every centre held against every row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(z, axis=0)))
    centre = z[[rng.integers(len(z))]]
    d = ((z - centre[0]) ** 2).sum(1)
    while len(centre) < k:
        centre = np.vstack((centre, z[rng.choice(len(z), p=d / d.sum())]))
        d = np.minimum(d, ((z - centre[-1]) ** 2).sum(1))
    label = np.zeros(len(z), int)
    for at in range(steps):
        new = ((z[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        if (new == label).all() and at:
            break
        label = new
        for j in range(k):
            if (label == j).any():
                centre[j] = z[label == j].mean(0)
    return label


@pytest.mark.parametrize("n,k,dims", [(1, 1, 1), (7, 3, 1), (17, 17, 2), (300, 30, 1), (1500, 150, 2), (700, 70, 3), (1200, 1, 2)])
def test_clusters_are_those_of_a_plain_search(n, k, dims):
    z = np.random.default_rng(n).normal(size=(n, dims)) * [1, 30, 0.1][:dims]
    places = clusters.Places(z, k, range(4))
    for seed in range(4):
        want = plain(z, k, seed)
        assert (clusters.lloyd(places, seed) == want).all() and (ci.kmeans(z, k, seed) == want).all()
        assert (clusters.lloyd(places, seed + 100, 2) == plain(z, k, seed + 100, 2)).all()  # a seed not told before, and few steps


@pytest.mark.parametrize("fill", [lambda r: np.tile(r.normal(size=(60, 2)), (9, 1)), lambda r: np.zeros((50, 1)), lambda r: r.integers(0, 3, (400, 2)).astype(float)])
def test_copies_of_few_places(fill):
    z = fill(np.random.default_rng(3))
    few = len(np.unique(z, axis=0))
    for k in (few // 2 + 1, few, len(z)):
        assert (ci.kmeans(z, k, 5) == plain(z, k, 5)).all()


def test_a_tenth_of_many_rows_as_clusters():
    z = np.random.default_rng(1).normal(size=(40_000, 2))
    began = time.time()
    label = ci.kmeans(z, 4000, 1, 5)
    assert time.time() - began < 15  # 40,000 x 4,000 distances for the start and for each step take longer
    sums = np.stack([np.bincount(label, weights=z[:, c], minlength=4000) for c in (0, 1)], 1) / np.maximum(1, np.bincount(label, minlength=4000))[:, None]
    assert ((z - sums[label]) ** 2).mean() < 1e-3


def test_permutations_inside_clusters_and_their_test():
    rng = np.random.default_rng(8)
    label = rng.integers(0, 40, 300)
    p, q, want = ci.permuted_inside(label, np.random.default_rng(2)), np.random.default_rng(2), np.arange(300)
    for j in np.unique(label):
        members = np.flatnonzero(label == j)
        want[members] = q.permutation(members)
    assert (p == want).all() and (label[p] == label).all()
    x = rng.normal(size=(2000, 1))
    assert ci.inchol(x, 1.0, 2000).size < 2000 * 100  # memory of the rank that it has, not of its limit
    factor = ci.inchol(x, 1.0, 2000)
    assert factor.base is None or factor.base.nbytes < 2000 * 100 * 8
    assert np.abs(factor @ factor.T - ci.rbf(x, 1.0)).max() < 2e-3
    assert (ci.inchol(x[:150], 1e-4, 70)).shape == (150, 70)
    assert ci.hsic_clust(x[:200], x[:200] + 1, rng.normal(size=200), CIConfig("hsic.clust", replicates=19)).p_value == 0.05


def test_cluster_tests_of_one_set_are_dealt_out(spark):
    tests = [(i, x, y, [4]) for i, (x, y) in enumerate((x, y) for x in range(4) for y in range(4) if x != y)]
    data = np.random.default_rng(2).normal(size=(60, 5))
    provide = matrix_provider(data, CIConfig("hsic.clust", replicates=5), partitions=97)
    got = provide(spark.createDataFrame(tests, "task_id long, x int, y int, s array<int>")).select("task_id", "p", F.spark_partition_id().alias("task")).collect()
    provide.close()
    assert len(got) == 12 and len({r.task for r in got}) > 6  # at most 3 where the lesser of x and y decides
    for r in got[:3]:
        x, y = tests[r.task_id][1:3]
        assert r.p == ci.run_test(data[:, x], data[:, y], CIConfig("hsic.clust", replicates=5, seed=(1 + 1000003 * r.task_id) % 2147483647), data[:, [4]]).p_value
