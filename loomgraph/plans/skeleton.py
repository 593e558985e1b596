"""The level loop: plan, p-values in waves, replay, deletion, until no test opens another level.

Between levels the driver holds at most p(p-1)/2 edges; tests and p-values stay in
tables.  So results do not depend on how tasks were dealt out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import resolve_max_size
from ..operators import layer
from ..operators.precision import LEDGER, RECORD, record_columns
from ..sources.staging import stage
from .providers import Provider


@dataclass
class Skeleton:
    """Edges that remain, and what removed the others; pairs are (x, y) with x < y."""

    p: int
    edges: set[tuple[int, int]]
    sepsets: dict[tuple[int, int], tuple[int, ...]] = field(default_factory=dict)
    pmax: dict[tuple[int, int], float] = field(default_factory=dict)
    levels: list[tuple[int, int, int, int]] = field(default_factory=list)
    evaluated: list[int] = field(default_factory=list)
    traced: list[DataFrame] = field(default_factory=list)
    deletions: list[tuple[int, int, int, tuple[int, ...], float]] = field(default_factory=list)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        make = spark.createDataFrame
        return {
            "edges": make(sorted(self.edges), "x int, y int"),
            "sepsets": make([(*k, list(v)) for k, v in sorted(self.sepsets.items())], "x int, y int, s array<int>"),
            "pmax": make([(*k, v) for k, v in sorted(self.pmax.items())], "x int, y int, p double"),
            "levels": make(self.levels, "level int, n_tests long, n_planned long, n_deleted long"),
            "evaluated": make(list(enumerate(self.evaluated)), "level int, n_evaluated long"),
            "ci_results": self.ci_results(spark),
            "deletions": make([(a, b, c, list(s), q) for a, b, c, s, q in self.deletions], "level int, x int, y int, s array<int>, p double"),
        }


    def ci_results(self, spark: SparkSession) -> DataFrame:
        """Rows (level, task_id, x, y, s, p, deletes) of the tests that a sequential search runs, if they were traced.

        With them what the provider tells: method, statistic, mean, variance, replicates, source, attempts.
        """
        out = spark.createDataFrame([], "level int, task_id long, x int, y int, s array<int>, p double, deletes boolean, " + ", ".join(f"{c} {t}" for c, t in (RECORD | LEDGER).items()))
        for part in self.traced:
            out = out.unionByName(part)
        return out


def _pairs(pairs: Sequence[tuple[int, int]]) -> set[tuple[int, int]]:
    return {(min(a, b), max(a, b)) for a, b in pairs}


def search(spark: SparkSession, p: int, provider: Provider, *, alpha: float, max_size: float = float("inf"), na_delete: bool = True, gaps: Sequence[tuple[int, int]] = (), fixed: Sequence[tuple[int, int]] = (), method: str = "stable", waves: Sequence[int] = (), trace: bool = False) -> Skeleton:
    """The skeleton over variables 0 to p-1.

    ``waves``: a level's tests are run so many an edge at a time (the last number again and
    again), and not for edges that a wave has decided; () runs all at once.  Results are the
    same.  ``trace`` keeps a row for each test in ``ci_results``.

    ``method``: 'stable' deletes after each level; 'original' at once, edge by edge, so its result depends on the variables' order.
    """
    top = resolve_max_size(max_size, p)
    keep = _pairs(fixed)
    out = Skeleton(p, {(x, y) for x in range(p) for y in range(x + 1, p)} - _pairs(gaps))
    for level in range(top + 1):
        if not out.edges:
            break
        if method == "original":
            opens = _original_level(spark, out, provider, level, alpha, na_delete, keep)
        else:
            opens = _stable_level(spark, out, provider, level, alpha, na_delete, keep, waves, trace)
        if not opens:
            break
    return out


def _in_waves(sided: DataFrame, level: int, provider: Provider, alpha: float, na_delete: bool, waves: Sequence[int], most: int, held: list[DataFrame]) -> DataFrame:
    """The tests that may count, with p; a wave makes those of its ranks only."""
    spark = sided.sparkSession
    at, k, decided, got = 0, 0, [], None
    while at < most:
        step = waves[min(k, len(waves) - 1)]
        left = sided.join(spark.createDataFrame(decided, "edge_x int, edge_y int"), ["edge_x", "edge_y"], "left_anti") if decided else sided
        part = layer.plan_ranks(left, level, at, at + step)
        p = part.join(provider(part), "task_id").persist()
        held.append(p)
        got = p if got is None else got.unionByName(p)
        if at + step < most:
            hits = p.filter(layer.effective_p(F.col("p"), na_delete) >= alpha).select("edge_x", "edge_y").distinct().collect()  # edges
            decided += [(r.edge_x, r.edge_y) for r in hits]
        at, k = at + step, k + 1
    return got


def _stable_level(spark, out, provider, level, alpha, na_delete, keep, waves, trace) -> bool:
    tested = sorted(out.edges - keep)
    degree = Counter(v for e in out.edges for v in e)
    each = [math.comb(degree[x] - 1, level) + math.comb(degree[y] - 1, level) for x, y in tested]
    planned, most = sum(each), max(each, default=0)
    if not planned:
        return False
    edges = spark.createDataFrame(sorted(out.edges), "x int, y int")
    only = (lambda df: df.join(spark.createDataFrame(tested, "edge_x int, edge_y int"), ["edge_x", "edge_y"], "left_semi")) if len(tested) < len(out.edges) else (lambda df: df)
    held: list[DataFrame] = []
    try:
        if waves and most > waves[0]:
            held.append(only(layer.sides(edges, level)).persist())
            done = _in_waves(held[0], level, provider, alpha, na_delete, waves, most, held)
        else:
            plan = only(layer.layer_plan(edges, level)).persist()
            done = plan.join(provider(plan), "task_id").persist()
            held += [plan, done]
        consumed = layer.replay(done, alpha, na_delete)
        if trace:  # written, whatever its size: the provider's matrix may be gone when it is read
            deletes = F.coalesce(F.col("task_id") == F.col("first_hit"), F.lit(False)).alias("deletes")
            kept = consumed.select("level", "task_id", "x", "y", "s", "p", deletes, *record_columns(consumed, "provider", 1))
            out.traced.append(stage(kept, "trace"))
        rows = layer.edge_outcome(consumed).collect()  # one row an edge
        rows.sort(key=lambda r: (r.x, r.y))
        opens = any(r.opens for r in rows)
        out.evaluated.append(done.count())
    finally:
        for df in held:
            df.unpersist()
    gone = 0
    for r in rows:
        e = (r.x, r.y)
        out.pmax[e] = max(out.pmax.get(e, float("-inf")), r.pmax)
        if r.deleted:
            gone += 1
            out.edges.discard(e)
            out.sepsets[e] = tuple(r.s)
            out.deletions.append((level, r.x, r.y, tuple(r.s), r.pmax))
    out.levels.append((level, sum(r.n_tests for r in rows), planned, gone))
    return opens


def _original_level(spark, out, provider, level, alpha, na_delete, keep) -> bool:
    """Edges in order; each sees the deletions before it."""
    opens, tests, planned, gone = False, 0, 0, 0
    for e in sorted(out.edges):
        if e in keep:
            continue
        around = [x for x in out.edges if x == e or set(x) & set(e)]
        plan = layer.layer_plan(spark.createDataFrame(sorted(around), "x int, y int"), level).filter((F.col("edge_x") == e[0]) & (F.col("edge_y") == e[1])).persist()
        planned += plan.count()
        consumed = layer.replay(plan.join(provider(plan), "task_id"), alpha, na_delete)
        for r in layer.edge_outcome(consumed).collect():
            tests += r.n_tests
            out.pmax[e] = max(out.pmax.get(e, float("-inf")), r.pmax)
            if r.deleted:
                gone += 1
                out.edges.discard(e)
                out.sepsets[e] = tuple(r.s)
                out.deletions.append((level, *e, tuple(r.s), r.pmax))
        opens = opens or bool(plan.filter("opens_next").limit(1).count())
        plan.unpersist()
    out.levels.append((level, tests, planned, gone))
    return opens
