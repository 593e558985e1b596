"""Orientation of a skeleton: colliders, rules to a fixpoint, and the regression step.

These steps write one after the other and look at what was written, on a graph of
at most some hundred nodes; so they run on one p x p array.  Regressions do not run there:
``orient_in_waves`` asks for them in waves, as a query, before the sequential step needs them.
The joins in ``operators.patterns`` give the same patterns as tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CIConfig, SplineConfig
from ..operators import layer, patterns
from ..operators.ci import run_test
from ..operators.residuals import residual
from .providers import Provider
from .skeleton import Skeleton

Sepset = Callable[[int, int], tuple[int, ...]]


@dataclass
class Orientation:
    pdag: np.ndarray
    events: list[tuple] = field(default_factory=list)
    trace: list[tuple] = field(default_factory=list)
    tests: int = 0

    def note(self, phase: str, rule: str, x: int, y: int, z: int = -1, s: Iterable[int] = (), p: float | None = None, accepted: bool = True, message: str = "") -> None:
        self.events.append((len(self.events), phase, rule, x, y, z, list(s), p, accepted, message))

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        a, b = np.nonzero(self.pdag)
        make = spark.createDataFrame
        return {
            "pdag": make([(int(i), int(j), int(self.pdag[i, j])) for i, j in zip(a, b, strict=True)], "a int, b int, mark int"),
            "orientation_events": make(self.events, "seq long, phase string, rule string, x int, y int, z int, s array<int>, p double, accepted boolean, message string"),
            "orientation_tests": make(self.trace, "context string, target int, other int, subset array<int>, given array<int>, p double, rejected boolean"),
        }


def adjacency(sk: Skeleton) -> np.ndarray:
    g = np.zeros((sk.p, sk.p), int)
    for x, y in sk.edges:
        g[x, y] = g[y, x] = 1
    return g


def _near(g: np.ndarray, a: int, b: int) -> bool:
    return bool(g[a, b] or g[b, a])


def _line(g: np.ndarray, a: int, b: int) -> bool:
    return g[a, b] == 1 and g[b, a] == 1


def _arrow(g: np.ndarray, a: int, b: int) -> bool:
    return g[a, b] == 1 and g[b, a] == 0


def _by_column(g: np.ndarray, wanted: Callable[[np.ndarray, int, int], bool]) -> list[tuple[int, int]]:
    """The pairs (a, b) that satisfy a predicate, b before a in order."""
    p = len(g)
    return [(a, b) for b in range(p) for a in range(p) if a != b and wanted(g, a, b)]


def orient_colliders(o: Orientation, sepset: Sepset, solve_confl: bool = False, unfaithful: frozenset = frozenset()) -> None:
    """x->y<-z for unshielded x-y-z with y outside the ends' separating set.

    Patterns are read from the graph as it was; a later write wins, or with
    ``solve_confl`` two opposite arrows become a conflict.
    """
    start, g = o.pdag.copy(), o.pdag

    def point(x: int, y: int) -> None:
        if not solve_confl:
            g[x, y], g[y, x] = 1, 0
        elif g[x, y] == 1:
            g[y, x] = 0
        else:
            g[x, y] = g[y, x] = 2

    p = len(start)
    for y in range(p):
        around = [v for v in range(p) if _line(start, v, y)]
        for x in around:
            for z in around:
                if x == z or _near(start, x, z) or y in sepset(x, z) or y in sepset(z, x):
                    continue
                if (min(x, z), y, max(x, z)) in unfaithful:
                    o.note("collider", "unfaithful", x, y, z, accepted=False)
                    continue
                point(x, y)
                point(z, y)
                o.note("collider", "collider", x, y, z)


def _rule1(o: Orientation) -> None:
    g = o.pdag
    for a, b in _by_column(g, _arrow):
        for c in range(len(g)):
            if c not in (a, b) and _line(g, b, c) and not _near(g, a, c):
                g[c, b] = 0
                o.note("rules", "rule1", b, c, a)


def _rule2(o: Orientation) -> None:
    g = o.pdag
    for a, b in _by_column(g, _line):
        if _line(g, a, b) and any(_arrow(g, a, c) and _arrow(g, c, b) for c in range(len(g))):
            g[b, a] = 0
            o.note("rules", "rule2", a, b)


def _rule3(o: Orientation) -> None:
    g = o.pdag
    for a, b in _by_column(g, _line):
        if not _line(g, a, b):
            continue
        via = [c for c in range(len(g)) if _line(g, a, c) and _arrow(g, c, b)]
        if any(not _near(g, c, d) for c, d in combinations(via, 2)):
            g[b, a] = 0
            o.note("rules", "rule3", a, b)


def apply_rules(o: Orientation, rules: tuple[bool, bool, bool] = (True, True, True)) -> None:
    """The chosen rules in turn until the graph stands still; they point edges that are undirected still, so conflicts come from colliders alone."""
    while True:
        before = o.pdag.copy()
        for used, rule in zip(rules, (_rule1, _rule2, _rule3), strict=True):
            if used:
                rule(o)
        if (before == o.pdag).all():
            return


def check_immor(g: np.ndarray, v: int, s: Iterable[int]) -> bool:
    """Whether s is a clique to which every parent of v is joined: s->v makes no new collider."""
    s = list(s)
    parents = [u for u in range(len(g)) if _arrow(g, u, v)]
    return all(_near(g, a, b) for a, b in combinations(s, 2)) and all(_near(g, u, m) for u in parents for m in s if u != m)


def regression_rejections(o: Orientation, data: np.ndarray, v: int, s: Iterable[int], alpha: float, ci: CIConfig, backend: str, spline: SplineConfig) -> int:
    """How many of s depend on the residual of v given s and v's parents; 0: v can be regressed on them."""
    s = list(s)
    given = sorted({*s, *(u for u in range(len(o.pdag)) if _arrow(o.pdag, u, v))})
    res = residual(data[:, v], data[:, given], backend, spline)
    bad = 0
    for m in s:
        p = run_test(res, data[:, m], ci).p_value
        o.tests += 1
        o.trace.append(("regression", v, m, s, given, float(p), bool(p < alpha)))
        bad += p < alpha
    return bad


def _subsets(items: list[int]) -> Iterator[tuple[int, ...]]:
    for k in range(len(items), 0, -1):
        yield from combinations(items, k)


def generalised_step(o: Orientation, rejections: Callable[[int, tuple[int, ...]], int], rules: tuple[bool, bool, bool]) -> None:
    """Orient undirected neighbours of nodes that regress to independence, small neighbourhoods first."""
    g = o.pdag
    p = len(g)
    around = lambda: [[u for u in range(p) if u != v and _line(g, u, v)] for v in range(p)]
    near, done, size = around(), [False] * p, 1
    while max(map(len, near), default=0) >= size:
        for v in range(p):
            if not (len(near[v]) == size or (len(near[v]) < size and done[v])):
                continue
            for s in _subsets(near[v]):
                if not check_immor(g, v, s) or rejections(v, s):
                    continue
                rival = any(v in t and check_immor(g, w, t) and not rejections(w, t) for w in s for t in _subsets(near[w]))
                if rival:
                    o.note("regression", "rival", v, -1, s=s, accepted=False)
                    continue
                for u in s:
                    g[u, v], g[v, u] = 1, 0
                for u in near[v]:
                    if u not in s and _line(g, u, v):
                        g[v, u], g[u, v] = 1, 0
                o.note("regression", "accepted", v, -1, s=s)
                apply_rules(o, rules)
                near = around()
                done[v] = True
                break
        size += 1


Request = tuple[int, tuple[int, ...], int]


class Unknown(Exception):
    """A regression test whose p-value has not been asked for, with others that may be needed after it."""

    def __init__(self, requests: set[Request]) -> None:
        super().__init__(f"{len(requests)} tests")
        self.requests = requests


#: Of a node's sets, how many are asked for before it is known that they are needed.
AHEAD = 64


def _requests(g: np.ndarray, v: int, s: Iterable[int]) -> set[Request]:
    given = tuple(sorted({*s, *(u for u in range(len(g)) if _arrow(g, u, v))}))
    return {(v, given, m) for m in s}


def _ahead(g: np.ndarray) -> set[Request]:
    """What each node may ask for while the graph stays as it is: its first sets that make no new collider."""
    out: set[Request] = set()
    for v in range(len(g)):
        near = [u for u in range(len(g)) if u != v and _line(g, u, v)]
        for s in islice((s for s in _subsets(near) if check_immor(g, v, s)), AHEAD):
            out |= _requests(g, v, s)
    return out


def known_rejections(o: Orientation, known: dict[Request, float], v: int, s: Iterable[int], alpha: float) -> int:
    """``regression_rejections`` from p-values that are known; what was asked for under other parents has another key and is not used."""
    wanted = _requests(o.pdag, v, s)
    if not wanted <= known.keys():
        raise Unknown((wanted | _ahead(o.pdag)) - known.keys())
    bad = 0
    for m in s:
        given = next(iter(wanted))[1]
        p = known[v, given, m]
        o.tests += 1
        o.trace.append(("regression", v, m, list(s), list(given), float(p), bool(p < alpha)))
        bad += p < alpha
    return bad


def orient_in_waves(spark: SparkSession, sk: Skeleton, ask: Callable[[DataFrame], DataFrame], **settings) -> tuple[Orientation, list[int]]:
    """``orient`` with regressions as queries; and how many tests each wave asked for.

    The step runs on what is known until a p-value is missing.  Then one query asks for it and for what
    the nodes may need while the graph stands as it does, and the step runs anew: so it takes the same
    decisions in the same order as with tests one by one, whatever the waves held.
    """
    known: dict[Request, float] = {}
    waves: list[int] = []
    while True:
        try:
            return orient(sk, None, known=known, **settings), waves
        except Unknown as missing:
            asked = sorted(missing.requests)
            waves.append(len(asked))
            tasks = spark.createDataFrame([(i, v, list(given), m) for i, (v, given, m) in enumerate(asked)], "task_id long, target int, s array<int>, other int")
            for r in ask(tasks).collect():  # one row a request
                known[asked[r.task_id]] = math.nan if r.p is None else r.p


def orient(sk: Skeleton, data: np.ndarray | None, *, alpha: float = 0.2, ci: CIConfig = CIConfig(), backend: str = "linear", spline: SplineConfig = SplineConfig(), rules: tuple[bool, bool, bool] = (True, True, True), orient_collider: bool = True, solve_confl: bool = False, unfaithful: frozenset = frozenset(), known: dict[Request, float] | None = None) -> Orientation:
    """The partially directed graph of a skeleton.

    The regression step tests one by one on the matrix, or takes p-values from ``known`` (``Unknown`` where
    one is missing); without both it is left out.
    """
    o = Orientation(adjacency(sk))
    if not sk.edges:
        return o
    sep = lambda a, b: sk.sepsets.get((min(a, b), max(a, b)), ())
    if orient_collider:
        orient_colliders(o, sep, solve_confl, unfaithful)
    apply_rules(o, rules)
    if known is not None:
        generalised_step(o, lambda v, s: known_rejections(o, known, v, s, alpha), rules)
    elif data is not None:
        generalised_step(o, lambda v, s: regression_rejections(o, data, v, s, alpha, ci, backend, spline), rules)
    else:
        o.note("regression", "skipped", -1, -1, accepted=False, message="there is no matrix to regress on")
    return o


def unfaithful_triples(spark: SparkSession, sk: Skeleton, provider: Provider, alpha: float, majority: bool = False, na_delete: bool = True) -> frozenset:
    """The ambiguous unshielded triples (x, y, z) with x < z, by the published conservative and majority rules.

    All tests go to the provider at once; each pair of ends is tested once given a set.
    """
    if not sk.edges:
        return frozenset()
    wanted = patterns.triple_tests(spark.createDataFrame(sorted(sk.edges), "x int, y int")).persist()
    asked = wanted.select("x", F.col("z").alias("y"), "s").distinct()
    asked = layer.numbered(asked, ["x", "y"], ["s"], "task_id").persist()  # numbers name permutations
    tests = asked.join(provider(asked), "task_id").select("x", F.col("y").alias("z"), "s", layer.effective_p(F.col("p"), na_delete).alias("p"))
    found = patterns.unfaithful(wanted.join(tests, ["x", "z", "s"]), alpha, majority).collect()  # triples of a graph
    wanted.unpersist()
    asked.unpersist()
    return frozenset((r.x, r.y, r.z) for r in found)
