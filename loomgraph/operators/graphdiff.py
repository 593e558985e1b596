"""Comparison of two graphs and of their evidence, as set operations and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adjacency_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (x, y, status): edges added by b, removed from a, or unchanged."""
    a, b = (e.select("x", "y").distinct() for e in (a, b))
    tag = lambda df, s: df.withColumn("status", F.lit(s))
    return tag(b.subtract(a), "added").unionByName(tag(a.subtract(b), "removed")).unionByName(tag(a.intersect(b), "unchanged"))


def skeleton_shd(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: edges that only one of the graphs has."""
    return adjacency_diff(a, b).agg(F.coalesce(F.sum((F.col("status") != "unchanged").cast("int")), F.lit(0)).alias("shd"))


def pmax_joined(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x", "y", F.col("p").alias("p_a")).join(b.select("x", "y", F.col("p").alias("p_b")), ["x", "y"]).withColumn("diff", F.col("p_b") - F.col("p_a"))


def pmax_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    return pmax_joined(a, b).agg(F.max(F.abs("diff")).alias("max_abs"), F.avg(F.abs("diff")).alias("mean_abs"), F.count(F.lit(1)).alias("n"))


def pmax_top(a: DataFrame, b: DataFrame, k: int = 20) -> DataFrame:
    """The k pairs whose p-values differ most."""
    return pmax_joined(a, b).withColumn("abs_diff", F.abs("diff")).orderBy(F.desc("abs_diff"), "x", "y").limit(k)


def sepset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (x, y, s_a, s_b, same) of pairs that either graph separates."""
    j = a.select("x", "y", F.array_sort("s").alias("s_a")).join(b.select("x", "y", F.array_sort("s").alias("s_b")), ["x", "y"], "full")
    return j.withColumn("same", F.coalesce(F.col("s_a") == F.col("s_b"), F.lit(False)))


def sepset_mismatch_rate(a: DataFrame, b: DataFrame) -> DataFrame:
    return sepset_diff(a, b).agg(F.avg((~F.col("same")).cast("double")).alias("mismatch_rate"), F.count(F.lit(1)).alias("pairs"))


def pdag_counts(kinds: DataFrame) -> DataFrame:
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def pdag_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (kind, a, b, status) of two tables of edge kinds."""
    tag = lambda df, s: df.select("kind", "a", "b").withColumn("status", F.lit(s))
    a, b = a.select("kind", "a", "b"), b.select("kind", "a", "b")
    return tag(b.subtract(a), "added").unionByName(tag(a.subtract(b), "removed")).unionByName(tag(a.intersect(b), "unchanged"))


def graph_metrics(edges: DataFrame, pmax: DataFrame, levels: DataFrame) -> DataFrame:
    """One row: edges, tests, levels, largest and smallest positive p."""
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    p = pmax.agg(F.max("p").alias("max_pmax"), F.min(F.when(F.col("p") > 0, F.col("p"))).alias("min_positive_pmax"))
    return e.crossJoin(p).crossJoin(levels.agg(F.sum("n_tests").alias("n_tests"), F.count(F.lit(1)).alias("n_levels")))  # one row each


def relative_l2(a: Column, b: Column) -> Column:
    """Aggregate: the norm of the difference over the norm of a."""
    return F.sqrt(F.sum((a - b) * (a - b))) / F.sqrt(F.sum(a * a))


def log_distance(p: Column, alpha: float) -> Column:
    return F.abs(F.log(F.greatest(p, F.lit(2.2250738585072014e-308)) / alpha))


def trace_faults(plan: DataFrame, trace: DataFrame) -> DataFrame:
    """Rows of a test trace that no planned task explains, and of planned tasks run twice."""
    keys = ["task_id", "x", "y"]
    unknown = trace.join(plan.select(*keys), keys, "left_anti").select(*keys).withColumn("fault", F.lit("not planned"))
    twice = trace.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*keys).withColumn("fault", F.lit("run twice"))
    return unknown.unionByName(twice)


def graph_diff(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """One row that compares two searches: tables edges (x, y), pmax (x, y, p), sepsets (x, y, s), levels (n_tests)."""
    edges = adjacency_diff(a["edges"], b["edges"])
    count = lambda s: F.sum((F.col("status") == s).cast("long"))
    shape = edges.agg(*(F.coalesce(count(s), F.lit(0)).alias(s) for s in ("added", "removed", "unchanged"))).withColumn("shd", F.col("added") + F.col("removed"))
    tests = [t["levels"].agg(F.coalesce(F.sum("n_tests"), F.lit(0)).alias(n)) for t, n in ((a, "tests_a"), (b, "tests_b"))]
    out = shape.crossJoin(pmax_summary(a["pmax"], b["pmax"])).crossJoin(sepset_mismatch_rate(a["sepsets"], b["sepsets"])).crossJoin(tests[0]).crossJoin(tests[1])  # one row each
    return out.select("added", "removed", "unchanged", "shd", F.struct("max_abs", "mean_abs", F.col("n").alias("pairs")).alias("pmax"), F.struct("mismatch_rate", "pairs").alias("sepsets"), (F.col("tests_b") - F.col("tests_a")).alias("tests_delta"))


def log_p_drift(p_a: Column, p_b: Column) -> Column:
    """How far two p-values are apart on the log scale; zeros count as the smallest normal double."""
    least = F.lit(2.2250738585072014e-308)
    return F.abs(F.log(F.greatest(p_b, least)) - F.log(F.greatest(p_a, least)))


def adjacency_faults(start: DataFrame, deletions: DataFrame, end: DataFrame) -> DataFrame:
    """Rows (x, y, fault): where the deletions of a trace do not lead from one edge table to another."""
    want = start.select("x", "y").join(deletions.select("x", "y"), ["x", "y"], "left_anti")
    tag = lambda df, s: df.select("x", "y").withColumn("fault", F.lit(s))
    gone = tag(want.join(end, ["x", "y"], "left_anti"), "lost without a deletion")
    kept = tag(end.join(want, ["x", "y"], "left_anti"), "kept though deleted")
    twice = tag(deletions.groupBy("x", "y").count().filter("count > 1"), "deleted twice")
    return gone.unionByName(kept).unionByName(twice)
