"""Second opinions near the threshold: predicate, policy, join, router, provider."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

#: What a provider may tell of a test besides its p-value, and what is told of how that was come by.
RECORD = {"method": "string", "statistic": "double", "mean": "double", "variance": "double", "replicates": "int"}
LEDGER = {"source": "string", "attempts": "int"}
#: The smallest normal double, which a p-value of 0 stands for.
LEAST_P = 2.2250738585072014e-308
#: Ways to get residuals, from the cheapest.
EXECUTORS = ("direct", "linear", "fast_spline", "tprs_gcv")


def _odd(p: Column) -> Column:
    return p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))


def near_alpha(p: Column, alpha: float, tau: float, odd_is_near: bool = True, slack: float = 1e-12) -> Column:
    """Whether p lies within a factor exp(tau) of alpha."""
    near = F.abs(F.log(F.greatest(p, F.lit(LEAST_P)) / alpha)) <= tau + slack
    return F.when(_odd(p), F.lit(odd_is_near)).otherwise(near)


def hybrid_p(primary: Column, verifier: Column, alpha: float, tau: float) -> Column:
    """The verifier's p where it is called for and finite, else the primary."""
    return F.when(near_alpha(primary, alpha, tau) & ~_odd(verifier), verifier).otherwise(primary)


def verify(primary: DataFrame, verifier: DataFrame, alpha: float, tau: float, key: str = "task_id") -> DataFrame:
    """Primary rows (key, p) with the verifier's (key, p): source, p_final and the decisions before and after."""
    for df, name in ((primary, "primary"), (verifier, "verifier")):
        if missing := {key, "p"} - set(df.columns):
            raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
    v = verifier.select(key, F.col("p").alias("verifier_p"))
    out = primary.withColumnRenamed("p", "primary_p").join(v, key, "left")
    called = near_alpha(F.col("primary_p"), alpha, tau) & ~_odd(F.col("verifier_p"))
    return out.withColumns({"near_alpha": near_alpha(F.col("primary_p"), alpha, tau), "source": F.when(called, "verifier").otherwise("primary"), "p_final": hybrid_p(F.col("primary_p"), F.col("verifier_p"), alpha, tau)}).withColumns({"independent_before": F.coalesce(F.col("primary_p") >= alpha, F.lit(False)), "independent_after": F.coalesce(F.col("p_final") >= alpha, F.lit(False))})


def route(precision: Column, s: Column) -> Column:
    """Struct (primary, verifier, fallback) of residuals for a precision and a conditioning set."""
    size = F.size(s)
    exact = F.when(size == 0, "direct").otherwise("tprs_gcv")
    fast = F.when(size == 0, "direct").otherwise("fast_spline")
    primary = F.when(precision.isin("legacy", "compatible"), exact).otherwise(fast)
    verifier = F.when((precision == "hybrid") & (size > 0), "tprs_gcv")
    return F.struct(primary.alias("primary"), verifier.alias("verifier"), F.when(size > 0, "linear").alias("fallback"))


def formula_class(s: Column) -> Column:
    """How a conditioning set enters the regression: not at all, as one smooth, or as a sum of smooths."""
    return F.when(F.size(s) == 0, "direct").when(F.size(s) <= 2, "full").otherwise("additive")


def formula_text(target: str, given: list[str], additive: bool | None = None) -> str:
    """A regression formula: one smooth of all, or a sum of smooths (beyond two, unless said otherwise)."""
    if additive is None:
        additive = len(given) > 2
    return f"{target} ~ " + (" + ".join(f"s({g})" for g in given) if additive else f"s({','.join(given)})")


def record_columns(p: DataFrame, source: str | None = None, attempts: int | None = None) -> list[Column]:
    """The columns of ``RECORD`` and ``LEDGER``; what a provider does not tell is null, or as given."""
    said = {c: F.col(c) if c in p.columns else F.lit(None) for c in (*RECORD, *LEDGER)}
    given = {"source": F.lit(source), "attempts": F.lit(attempts)}
    return [(F.coalesce(v, given[c]) if c in given else v).cast({**RECORD, **LEDGER}[c]).alias(c) for c, v in said.items()]


def recorded(p: DataFrame, source: str | None = None, attempts: int | None = None) -> DataFrame:
    """Rows (task_id, p) with their records."""
    return p.select("task_id", "p", *record_columns(p, source, attempts))


def hybrid_provider(primary: Callable[[DataFrame], DataFrame], verifier: Callable[[DataFrame], DataFrame], alpha: float, tau: float) -> Callable[[DataFrame], DataFrame]:
    """All tasks by the primary; those near alpha with a conditioning set again by the verifier.

    A row tells the whole record of the test that counts, its source, and how many tests were made.
    """

    def provide(tasks: DataFrame) -> DataFrame:
        first = primary(tasks).persist()
        kept.append(first)
        again = tasks.join(first.select("task_id", "p"), "task_id").filter(near_alpha(F.col("p"), alpha, tau) & (F.size("s") > 0)).drop("p")
        one = recorded(first, "primary", 1)
        two = recorded(verifier(again), "verifier", 1).withColumnsRenamed({c: f"v_{c}" for c in ("p", *RECORD, *LEDGER)})
        both = one.join(two, "task_id", "left")
        called = near_alpha(F.col("p"), alpha, tau) & ~_odd(F.col("v_p"))
        pick = lambda c: F.when(called, F.col(f"v_{c}")).otherwise(F.col(c)).alias(c)
        return both.select("task_id", hybrid_p(F.col("p"), F.col("v_p"), alpha, tau).alias("p"), *map(pick, RECORD), pick("source"), (F.col("attempts") + F.coalesce("v_attempts", F.lit(0))).cast("int").alias("attempts"))

    def stats() -> dict[str, int]:
        told = [part.stats() for part in (primary, verifier) if hasattr(part, "stats")]
        return {k: sum(t[k] for t in told) for k in (told[0] if told else ())}

    def close() -> None:
        for df in kept:
            df.unpersist()
        kept.clear()
        for part in (primary, verifier):
            if hasattr(part, "close"):
                part.close()

    kept: list[DataFrame] = []
    provide.close, provide.stats = close, stats
    return provide


def fallback_chain(tasks: DataFrame, providers: list[Callable[[DataFrame], DataFrame]], names: list[str] | None = None) -> DataFrame:
    """Each task's first finite p with its record, by as few providers as that takes.

    Rows (task_id, p, the columns of ``RECORD``, source, attempts); ``names`` are the providers', by default
    their numbers from 1.  The last one's result counts whatever it is.  What a provider gave is written
    before the next is asked, so no test runs twice.
    """
    names = names or [str(i) for i in range(1, len(providers) + 1)]
    done: DataFrame | None = None
    left = tasks
    for i, (name, provider) in enumerate(zip(names, providers, strict=True), 1):
        got = stage(recorded(provider(left)).withColumns({"source": F.lit(name), "attempts": F.lit(i)}), "attempts")
        odd = _odd(F.col("p"))
        fine = got if i == len(providers) else got.filter(~odd)
        done = fine if done is None else done.unionByName(fine)
        left = tasks.join(got.filter(odd).select("task_id"), "task_id", "left_semi")
    return done if done is not None else recorded(tasks.select("task_id", F.lit(math.nan).alias("p")), None, 0)


#: What the exact regression is made for.
FORMULA_CLASSES, MOST_GIVEN, PENALTIES = ("direct", "full", "additive"), 2, 1


def envelope(family: Column, link: Column, formula: Column, given: Column, penalties: Column, version_known: Column, allow_canary: bool = False) -> Column:
    """Struct (status, action, failed): whether a fit lies within what the verifier supports, and which checks say no."""
    checks = {"version": version_known, "family": family == "gaussian", "link": link == "identity", "formula": formula.isin(*FORMULA_CLASSES), "given": given <= MOST_GIVEN, "penalties": penalties == PENALTIES}
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda n: n.isNotNull())
    fine = F.size(failed) == 0
    other = ("canary", "warn") if allow_canary else ("unsupported", "fall back")
    return F.struct(F.when(fine, "supported").otherwise(other[0]).alias("status"), F.when(fine, "run").otherwise(other[1]).alias("action"), failed.alias("failed"))


def formula_col(target: Column, given: Column) -> Column:
    """``formula_text`` of variable numbers, as x0, x1 and so on; one smooth of up to two, a sum beyond; a constant for none."""
    names = F.transform(given, lambda v: F.concat(F.lit("x"), v.cast("string")))
    each = F.array_join(F.transform(names, lambda n: F.concat(F.lit("s("), n, F.lit(")"))), " + ")
    right = F.when(F.size(given) == 0, "1").when(F.size(given) <= 2, F.concat(F.lit("s("), F.array_join(names, ","), F.lit(")"))).otherwise(each)
    return F.concat(F.lit("x"), target.cast("string"), F.lit(" ~ "), right)


def inject(provider: Callable[[DataFrame], DataFrame], broken: Column, value: float | None) -> Callable[[DataFrame], DataFrame]:
    """A provider that gives ``value`` (null, nan, infinity) where ``broken``, a condition on task_id, holds."""
    return lambda tasks: provider(tasks).withColumn("p", F.when(broken, F.lit(value).cast("double")).otherwise(F.col("p")))


def snapshot(consumed: DataFrame) -> DataFrame:
    """Rows (edge_x, edge_y, deleted, n_tests, identity) of a replay: what a later run must give again."""
    last = F.max(F.struct("task_id", F.array_join("s", "|").alias("s_key"), "p"))
    out = consumed.groupBy("edge_x", "edge_y").agg(F.max(F.coalesce(F.col("task_id") == F.col("first_hit"), F.lit(False))).alias("deleted"), F.count(F.lit(1)).alias("n_tests"), last.alias("last"))
    name = F.concat_ws("#", F.col("edge_x").cast("string"), F.col("edge_y").cast("string"), F.col("deleted").cast("string"), F.col("n_tests").cast("string"), F.col("last.task_id").cast("string"), F.col("last.s_key"))
    return out.select("edge_x", "edge_y", "deleted", "n_tests", F.sha2(name, 256).alias("identity"))
