"""Pairwise kernels and their centred sums as DataFrame operations.

A sample is a DataFrame (i, x...).  All pairs are formed by design: these are the
statistics' definitions, for samples of at most thousands of rows.  The skeleton
search does not use them; it sends the matrix out and distributes the tests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .special import gamma_upper


def pairs(sample: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (i, j, <c>_i, <c>_j...) of all ordered pairs."""
    a = sample.select("i", *(F.col(c).alias(f"{c}_i") for c in columns))
    b = sample.select(F.col("i").alias("j"), *(F.col(c).alias(f"{c}_j") for c in columns))
    return a.crossJoin(b)


def distance(columns: Sequence[str], index: float = 1.0, legacy_index: bool = True) -> Column:
    """Euclidean distance of a pair; to the power ``index`` unless the legacy form ignores it."""
    d = F.abs(F.col(f"{columns[0]}_i") - F.col(f"{columns[0]}_j")) if len(columns) == 1 else F.sqrt(sum(((F.col(f"{c}_i") - F.col(f"{c}_j")) * (F.col(f"{c}_i") - F.col(f"{c}_j")) for c in columns), F.lit(0.0)))
    return d if legacy_index or index == 1 else F.pow(d, F.lit(index))


def rbf(column: str, sig: float = 1.0) -> Column:
    d = F.col(f"{column}_i") - F.col(f"{column}_j")
    return F.exp(-(d * d) / sig)


def double_centre(pairwise: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``value`` less its row and column means plus its grand mean; means are aggregates, the grand one of the rows'."""
    rows = pairwise.groupBy("i").agg(F.avg(value).alias("_mi"))
    cols = pairwise.groupBy("j").agg(F.avg(value).alias("_mj"))
    grand = rows.agg(F.avg("_mi").alias("_m"))  # rows are equally long
    return pairwise.join(rows, "i").join(cols, "j").crossJoin(F.broadcast(grand)).withColumn(out, F.col(value) - F.col("_mi") - F.col("_mj") + F.col("_m")).drop("_mi", "_mj", "_m")


def off_diagonal_mean(pairwise: DataFrame, value: str) -> Column:
    return F.avg(F.when(F.col("i") != F.col("j"), F.col(value)))


def centred_sums(pairwise: DataFrame) -> DataFrame:
    """One row from columns k and l: n, sums, and the centred products ab, aa, bb, without centring a pair.

    Row sums are one aggregate by ``i``; the rest is algebra on them.
    """
    off = F.when(F.col("i") != F.col("j"), F.lit(1.0)).otherwise(F.lit(0.0))
    rows = pairwise.groupBy("i").agg(F.sum("k").alias("rk"), F.sum("l").alias("rl"), F.sum(F.col("k") * F.col("l")).alias("kl"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.sum(F.col("l") * F.col("l")).alias("ll"), F.sum(F.col("k") * off).alias("ok"), F.sum(F.col("l") * off).alias("ol"))
    return from_totals(row_totals(rows))


def row_totals(rows: DataFrame) -> DataFrame:
    """One row of totals from rows (i, rk, rl, kl, kk, ll, ok, ol): a row's sums of k, l and their products, and of k and l without its own."""
    return rows.agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(c).alias(c) for c in ("rk", "rl", "kl", "kk", "ll", "ok", "ol")), F.sum(F.col("rk") * F.col("rl")).alias("rr"), F.sum(F.col("rk") * F.col("rk")).alias("rrk"), F.sum(F.col("rl") * F.col("rl")).alias("rrl"))


def from_totals(t: DataFrame) -> DataFrame:
    """The columns of ``centred_sums`` from totals."""
    n = F.col("n")
    return t.select(
        "n", F.col("rk").alias("sk"), F.col("rl").alias("sl"), (F.col("ok") / (n * (n - 1))).alias("mu_k"), (F.col("ol") / (n * (n - 1))).alias("mu_l"),
        (F.col("kl") - 2 / n * F.col("rr") + F.col("rk") * F.col("rl") / (n * n)).alias("ab"),
        (F.col("kk") - 2 / n * F.col("rrk") + F.col("rk") * F.col("rk") / (n * n)).alias("aa"),
        (F.col("ll") - 2 / n * F.col("rrl") + F.col("rl") * F.col("rl") / (n * n)).alias("bb"),
    )


def _factor(n: Column) -> Column:
    return 2 * (n - 4) * (n - 5) / (n * (n - 1) * (n - 2) * (n - 3))


def dcov_gamma(pairwise: DataFrame) -> DataFrame:
    """One row (n, statistic, mean, variance, dcov, p_value) from pairs with distances k and l."""
    return dcov_tail(centred_sums(pairwise))


def dcov_tail(sums: DataFrame) -> DataFrame:
    """The same from ``centred_sums``."""
    n = F.col("n")
    t = sums.select("n", (F.col("ab") / n).alias("statistic"), (F.col("sk") / (n * n) * (F.col("sl") / (n * n))).alias("mean"), (_factor(n) * F.col("aa") * F.col("bb") / (n * n)).alias("variance"))
    return _with_tail(t).withColumn("dcov", F.sqrt(F.greatest(F.col("statistic"), F.lit(0.0)) / n))


def hsic_gamma(pairwise: DataFrame) -> DataFrame:
    """One row (n, statistic, mean, variance, p_value) from pairs with kernels k and l."""
    return hsic_tail(centred_sums(pairwise))


def hsic_tail(sums: DataFrame) -> DataFrame:
    """The same from ``centred_sums``."""
    n = F.col("n")
    mu = 1 + F.col("mu_k") * F.col("mu_l") - F.col("mu_k") - F.col("mu_l")
    return _with_tail(sums.select("n", (F.col("ab") / (n * n)).alias("statistic"), (mu / n).alias("mean"), (_factor(n) * F.col("aa") * F.col("bb") / F.pow(n, F.lit(4.0))).alias("variance")))


def _with_tail(t: DataFrame) -> DataFrame:
    shape = F.col("mean") * F.col("mean") / F.col("variance")
    return t.withColumn("p_value", F.when((F.col("mean") > 0) & (F.col("variance") > 0), gamma_upper(shape, F.col("statistic") / (F.col("variance") / F.col("mean")))).otherwise(F.lit(1.0)))


def permutations(sample: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Rows (rep, i, pi): for each replicate the rows in the order of md5(seed|rep|i)."""
    rep = sample.select("i", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    by = Window.partitionBy("rep")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("i").cast("string")))
    a = rep.withColumn("rn", F.row_number().over(by.orderBy("i")))
    b = rep.select("rep", F.col("i").alias("pi"), F.row_number().over(by.orderBy(key)).alias("rn"))
    return a.join(b, ["rep", "rn"]).select("rep", "i", "pi")
