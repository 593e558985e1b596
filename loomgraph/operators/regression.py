"""Linear residuals in closed form, for any number of rows: moments by one aggregate, residuals as a projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ols_residual_1(df: DataFrame, y: str, x: str) -> DataFrame:
    """``df`` with ``resid``: y less its regression on x and a constant (on the constant alone if x doesn't vary)."""
    fit = df.agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.avg(y).alias("my"), F.avg(x).alias("mx"))
    return df.crossJoin(F.broadcast(fit)).withColumn("resid", F.col(y) - F.col("my") - F.col("slope") * (F.col(x) - F.col("mx"))).drop("slope", "my", "mx")  # one row


def ols_residual_2(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """``df`` with ``resid``: y less its regression on a, b and a constant."""
    cov = F.covar_pop
    m = df.agg(F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), cov(a, a).alias("aa"), cov(b, b).alias("bb"), cov(a, b).alias("ab"), cov(a, y).alias("ay"), cov(b, y).alias("by"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    fit = m.select("my", "ma", "mb", ((F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det).alias("ca"), ((F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det).alias("cb"))
    return df.crossJoin(F.broadcast(fit)).withColumn("resid", F.col(y) - F.col("my") - F.col("ca") * (F.col(a) - F.col("ma")) - F.col("cb") * (F.col(b) - F.col("mb"))).drop("my", "ma", "mb", "ca", "cb")  # one row


def ols_residual(df: DataFrame, y: str, given: Sequence[str]) -> DataFrame:
    """``df`` with ``resid`` for any number of given columns: the Gram matrix comes from one aggregate."""
    cols: list[Column] = [F.lit(1.0), *(F.col(c).cast("double") for c in given), F.col(y).cast("double")]
    k = len(cols)
    row = df.agg(*(F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1))).first()
    g = np.array([[row[f"g{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    beta = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
    fitted = F.lit(float(beta[0]))
    for c, b in zip(given, beta[1:], strict=True):
        fitted = fitted + F.lit(float(b)) * F.col(c)
    return df.withColumn("resid", F.col(y) - fitted)


def ols_residuals(df: DataFrame, ys: Sequence[str], given: Sequence[str]) -> DataFrame:
    """``df`` with ``resid_<y>`` for several targets of one set: their moments come from one aggregate."""
    cols: list[Column] = [F.lit(1.0), *(F.col(c).cast("double") for c in given)]
    targets = [F.col(y).cast("double") for y in ys]
    k = len(cols)
    gram = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]
    row = df.agg(*gram, *(F.sum(cols[i] * t).alias(f"t{i}_{n}") for i in range(k) for n, t in enumerate(targets))).first()
    g = np.array([[row[f"g{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    right = np.array([[row[f"t{i}_{n}"] or 0.0 for n in range(len(ys))] for i in range(k)])
    beta = np.linalg.lstsq(g, right, rcond=None)[0]
    fits = {f"resid_{y}": F.col(y) - sum((F.lit(float(b)) * c for b, c in zip(beta[:, n], cols, strict=True)), F.lit(0.0)) for n, y in enumerate(ys)}
    return df.withColumns(fits)
