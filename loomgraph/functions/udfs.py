"""Tests as SQL aggregates, and subsets as a table function."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.ci import dcov_gamma, hsic_gamma


@F.pandas_udf("double")
def dcov_pvalue(x: pd.Series, y: pd.Series) -> float:
    """Aggregate: the distance-covariance p-value of two columns; null for fewer than six complete rows."""
    d = np.column_stack((x, y)).astype(float)
    d = d[np.isfinite(d).all(1)]
    return dcov_gamma(d[:, 0], d[:, 1]).p_value if len(d) > 5 else None


@F.pandas_udf("double")
def hsic_pvalue(x: pd.Series, y: pd.Series) -> float:
    """Aggregate: the HSIC p-value of two columns; null for fewer than six complete rows."""
    d = np.column_stack((x, y)).astype(float)
    d = d[np.isfinite(d).all(1)]
    return hsic_gamma(d[:, 0], d[:, 1]).p_value if len(d) > 5 else None


@F.udtf(returnType="nth int, s array<int>")
class Combos:
    """combos(items, k): the subsets of size k in lexicographic order."""

    def eval(self, items: list, k: int) -> Iterator[tuple[int, list]]:
        for i, s in enumerate(combinations(sorted(items or []), k)):
            yield i, list(s)


def register(spark: SparkSession) -> None:
    """Make dcov_pvalue, hsic_pvalue and combos known to SQL."""
    spark.udf.register("dcov_pvalue", dcov_pvalue)
    spark.udf.register("hsic_pvalue", hsic_pvalue)
    spark.udtf.register("combos", Combos)
