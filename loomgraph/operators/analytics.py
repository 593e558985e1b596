"""Workload and campaign analytics over tables of tests and runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def workload_stats(tasks: DataFrame) -> DataFrame:
    """By level: tests, distinct sets, sets with several targets, and quantiles of targets a set (rows level, s_key, target)."""
    per = tasks.groupBy("level", "s_key").agg(F.count(F.lit(1)).alias("tests"), F.count_distinct("target").alias("targets"))
    q = lambda p: F.percentile("targets", F.lit(p))
    return per.groupBy("level").agg(F.sum("tests").alias("n_tests"), F.count(F.lit(1)).alias("n_sets"), F.sum((F.col("targets") > 1).cast("int")).alias("shared_sets"), q(0.5).alias("p50_targets"), q(0.95).alias("p95_targets"), F.max("targets").alias("max_targets"))


def cache_stats(requests: DataFrame) -> DataFrame:
    """By setup: tests, requests, distinct targets, uncached requests and hit rate (rows setup, test_id, target, cache_hit)."""
    return requests.groupBy("setup").agg(F.count_distinct("test_id").alias("tests"), F.count(F.lit(1)).alias("requests"), F.count_distinct("target").alias("targets"), F.sum((~F.col("cache_hit")).cast("int")).alias("uncached"), F.avg(F.col("cache_hit").cast("double")).alias("hit_rate"))


def workload_census(tasks: DataFrame) -> DataFrame:
    """Residual requests of tests (rows task_id, x, y, s): key, hash identity, first and number of tests."""
    asked = tasks.select("task_id", F.explode(F.array("x", "y")).alias("target"), F.array_join("s", "|").alias("s_key"), F.size("s").alias("s_size"))
    out = asked.groupBy("target", "s_key", "s_size").agg(F.count(F.lit(1)).alias("tests"), F.min("task_id").alias("first_task"))
    risk = F.when(F.col("s_size") == 0, "direct").when(F.col("s_size") <= 2, "single_penalty").otherwise("multi_penalty")
    return out.withColumns({"identity": F.sha2(F.concat_ws("#", F.col("target").cast("string"), "s_key"), 256), "risk": risk})


def campaign_grid(spark: SparkSession, axes: Mapping[str, Sequence[object]]) -> DataFrame:
    """All combinations of some settings' values."""
    if not axes:
        raise ValueError("a grid needs an axis")
    return spark.createDataFrame(list(product(*axes.values())), list(axes))  # settings, a few each


def safe_runs(settings: Iterable[object], run: Callable[[object], Mapping[str, object]]) -> list[dict[str, object]]:
    """Run each setting; an error becomes the row's status."""
    rows = []
    for s in settings:
        try:
            rows.append({"setting": s, "status": "ok", **run(s)})
        except Exception as e:
            rows.append({"setting": s, "status": "error", "error": f"{type(e).__name__}: {e}"})
    return rows


def safe_map(settings: DataFrame, run: Callable[[Mapping[str, object]], Mapping[str, object]], columns: str) -> DataFrame:
    """``safe_runs`` on the executors: each row of settings with status, error and the columns that ``run`` gives (as DDL)."""
    schema = settings.sparkSession.createDataFrame([], f"status string, error string, {columns}").schema
    names = schema.names
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*settings.schema, *schema))
    arrow = to_arrow_schema(StructType([*settings.schema, *schema]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            done = [{**d["setting"], **{n: d.get(n) for n in names}} for d in safe_runs(rows, run)]
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return settings.mapInArrow(work, ddl)


def pairwise_runs(runs: DataFrame) -> DataFrame:
    """Pairs i < j of successful runs (rows run_id, status, value) with their difference.

    There are as many rows as pairs; both sides are dealt out, so that they are made in all tasks
    even where the table of runs is a single file.
    """
    ok = runs.filter("status = 'ok'")
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = ok.select(F.col("run_id").alias("i"), F.col("value").alias("a")), ok.select(F.col("run_id").alias("j"), F.col("value").alias("b"))
    return a.repartition(tasks, "i").join(b.repartition(tasks, "j"), F.col("i") < F.col("j")).select("i", "j", (F.col("b") - F.col("a")).alias("diff"))


def mode_summary(runs: DataFrame, baseline: str) -> DataFrame:
    """By mode: median, p90, p95, geometric mean, and the median's ratio to the baseline's (rows mode, sec); odd times are left out."""
    fine = runs.filter(F.col("sec").isNotNull() & ~F.isnan("sec") & (F.abs("sec") != float("inf")))
    q = lambda p: F.percentile("sec", F.lit(p))
    by = fine.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.95).alias("p95"), F.exp(F.avg(F.log(F.when(F.col("sec") > 0, F.col("sec"))))).alias("geomean"))
    base = by.filter(F.col("mode") == baseline).select(F.col("median").alias("base"))
    return by.join(F.broadcast(base), F.lit(True), "left").withColumn("ratio", F.col("median") / F.col("base")).drop("base")  # one row


def elect_baseline(runs: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: the first mode of an order that has a successful run."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("mode"))
    return runs.filter((F.col("status") == "ok") & (place > 0)).agg(F.min_by("mode", place).alias("baseline"))


def bottleneck(times: Mapping[str, Column]) -> Column:
    """The name of the largest time, or 'unclassified' if none is positive; of equal ones the first."""
    n = len(times)
    best = F.array_max(F.array(*(F.struct(F.coalesce(c, F.lit(0.0)).alias("t"), F.lit(n - i).alias("o"), F.lit(name).alias("name")) for i, (name, c) in enumerate(times.items()))))
    return F.when(best["t"] > 0, best["name"]).otherwise("unclassified")


def tau_by_scenario(rows: DataFrame) -> DataFrame:
    """By scenario the row with the fewest flips, then the largest speed-up, then the smallest tau."""
    w = Window.partitionBy("scenario").orderBy("flips", F.desc("speedup"), "tau")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def tau_select(rows: DataFrame, max_ratio: float = 2.0) -> DataFrame:
    """The tau that removes most flips, of those that do no harm to the graph and cost at most ``max_ratio`` times the time."""
    fine = rows.filter((F.col("shd_hybrid") <= F.col("shd_primary")) & (F.col("runtime_ratio") <= max_ratio))
    return fine.orderBy(F.desc("flip_reduction"), "verification_rate", "tau").limit(1)


def decision(rows: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """One row: the mean of each column, and 'go' if all are within their limits."""
    out = rows.agg(*(F.avg(c).alias(c) for c in limits))
    fine = F.lit(True)
    for c, limit in limits.items():
        fine &= F.coalesce(F.col(c) <= limit, F.lit(False))
    return out.withColumn("decision", F.when(fine, "go").otherwise("no-go"))


def fingerprint(parts: Sequence[Column]) -> Column:
    """A hash identity of some values."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def census_maps(tasks: DataFrame) -> DataFrame:
    """Rows (task_id, side, target, s_key, identity): which residual each side of each test asks for."""
    asked = tasks.select("task_id", F.array_join("s", "|").alias("s_key"), F.inline(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("target")) for c in ("x", "y")))))
    return asked.withColumn("identity", F.sha2(F.concat_ws("#", F.col("target").cast("string"), "s_key"), 256))


def request_counts(tasks: DataFrame) -> DataFrame:
    """By level: residuals that tests with a set ask for, distinct ones (what a cache fits), hits and hit rate."""
    asked = tasks.filter(F.size("s") > 0).select("level", F.explode(F.array("x", "y")).alias("target"), F.array_join("s", "|").alias("s_key"))
    per = asked.groupBy("level", "target", "s_key").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("level").agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("fits")).withColumn("hits", F.col("requests") - F.col("fits")).withColumn("hit_rate", F.col("hits") / F.col("requests"))


#: Limits of the two decisions below.
LINEAR_SHARE, TARGETS_P95, UNSUPPORTED_SHARE = 0.5, 4.0, 0.25
FLOOR_LEAST, ORACLE_LEAST, SHD_LEAST = 0.10, 0.05, 1.0


def batching_decision(timing: DataFrame, workload: DataFrame) -> DataFrame:
    """One row: whether solving many targets of a setup together is worth it.

    ``timing``: total_ms, linear_solve_ms, setup_ms, ci_ms, of which the longest run counts;
    ``workload``: targets_p95, supported, unsupported.  Without rows: 'defer'.
    """
    longest = timing.agg(F.max_by(F.struct("total_ms", "linear_solve_ms", "setup_ms", "ci_ms"), "total_ms").alias("t"))
    load = workload.agg(F.max("targets_p95").alias("p95"), F.sum("supported").alias("yes"), F.sum("unsupported").alias("no"))
    t = lambda c: F.col(f"t.{c}")
    share = t("linear_solve_ms") / F.greatest(t("total_ms"), F.lit(2.220446049250313e-16))
    refused = F.col("no") / F.greatest(F.lit(1.0), F.col("yes") + F.col("no"))
    why = (
        F.when(F.col("t").isNull() | F.col("p95").isNull(), "no evidence").when(t("setup_ms") >= F.greatest(t("linear_solve_ms"), t("ci_ms")), "setup takes longest")
        .when(t("ci_ms") >= F.greatest(t("linear_solve_ms"), t("setup_ms")), "tests take longest").when(share < LINEAR_SHARE, "solving takes too little")
        .when(F.col("p95") < TARGETS_P95, "too few targets a setup").when(refused > UNSUPPORTED_SHARE, "too many tests are unsupported")
    )
    return longest.crossJoin(load).select(F.when(why.isNull(), "proceed").otherwise("defer").alias("decision"), F.coalesce(why, F.lit("solving dominates")).alias("reason"), share.alias("linear_share"), F.col("p95").alias("targets_p95"), refused.alias("unsupported_share"))  # one row each


def approximation_decision(rows: DataFrame) -> DataFrame:
    """One row: 'investigate' if the basis limits fits, a better smoothing parameter would not help, and graphs differ (rows floor, oracle, flip, shd)."""
    m = rows.agg(*(F.avg(c).alias(c) for c in ("floor", "oracle", "flip", "shd")))
    over = lambda c, least: F.coalesce(F.col(c) >= least, F.lit(False))
    return m.withColumns({"basis_limits": over("floor", FLOOR_LEAST), "smoothing_helps": over("oracle", ORACLE_LEAST), "graphs_differ": over("shd", SHD_LEAST)}).withColumn("decision", F.when(F.col("basis_limits") & ~F.col("smoothing_helps") & F.col("graphs_differ"), "investigate").otherwise("defer"))


def flatten_list(runs: DataFrame, column: str, key: str = "run_id") -> DataFrame:
    """A row for each struct of a run's list (levels, batches, events, tests), with its place; runs without any give none."""
    return runs.select(key, F.posexplode(column).alias("nth", "item")).select(key, "nth", "item.*")


def flatten_map(runs: DataFrame, column: str, key: str = "run_id") -> DataFrame:
    """A row (key, name, value) for each entry of a run's map (timings, settings)."""
    return runs.select(key, F.explode(column).alias("name", "value"))


def flatten_struct(runs: DataFrame, column: str, key: str = "run_id") -> DataFrame:
    """A row for each run, with the fields of a struct (cache counters) as columns; runs without one give nulls."""
    return runs.select(key, f"{column}.*")
