"""Reading observations, and the forms that operators take them in."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a matrix that may be sent to every executor.
BROADCAST_BYTES = 256 << 20


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its extension: csv (with header), json, orc, or else parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if kind == "tsv" else ",")
    return getattr(spark.read, kind if kind in ("json", "orc") else "parquet")(path)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def _whole(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None, *, order_by: str | None = None, rows: int | None = None, variables: int | None = None, min_rows: int = 20, min_variables: int = 3) -> DataFrame:
    """Numeric columns and rows without missing or infinite values; the first ``rows`` by a key if asked."""
    cols = list(columns or numeric_columns(df, [order_by] if order_by else []))[:variables]
    if len(cols) < min_variables:
        raise ValueError(f"needs {min_variables} numeric columns")
    keep = F.lit(True)
    for c in cols:
        keep &= _whole(c)
    out = df.filter(keep)
    if rows is not None:
        if order_by is None:
            raise ValueError("the first rows need a key to order by")
        out = out.orderBy(order_by).limit(rows)
    out = out.select(*([order_by] if order_by else []), *(F.col(f"`{c}`").cast("double").alias(c) for c in cols))
    if out.limit(min_rows).count() < min_rows:
        raise ValueError(f"needs {min_rows} complete rows")
    return out


def descriptor(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: n, p, labels, has_missing, all_finite, data_hash."""
    bad = lambda c: (~_whole(c)).cast("int")
    null = lambda c: (F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))).cast("int")
    total = sum((F.coalesce(F.sum(F.col(f"`{c}`").cast("double")), F.lit(0.0)) for c in columns), F.lit(0.0))
    out = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.lit(0), *map(null, columns))).alias("m"), F.max(F.greatest(F.lit(0), *map(bad, columns))).alias("b"), total.alias("total"))
    return out.select("n", F.lit(len(columns)).alias("p"), F.array(*map(F.lit, columns)).alias("labels"), (F.coalesce("m", F.lit(0)) == 1).alias("has_missing"), (F.coalesce("b", F.lit(0)) == 0).alias("all_finite"), F.concat_ws(":", F.col("n").cast("string"), F.lit(str(len(columns))), F.format_string("%.7e", "total")).alias("data_hash"))


def to_long(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Rows (row_id, var, value) of a wide table."""
    pairs = F.array(*(F.struct(F.lit(i).alias("var"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(columns)))
    return df.select(F.col(f"`{row_id}`").alias("row_id"), F.inline(pairs))


def to_vectors(long: DataFrame) -> DataFrame:
    """Rows (var, x): each variable as one array in row order."""
    return long.groupBy("var").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_id", "value"))), lambda s: s["value"]).alias("x"))


def to_numpy(df: DataFrame, columns: Sequence[str], order_by: Sequence[str] = ()) -> np.ndarray:
    """The matrix on the driver; refuses one that is larger than ``BROADCAST_BYTES``."""
    n = df.count()
    if n * len(columns) * 8 > BROADCAST_BYTES:
        raise ValueError("the matrix is too large to send to executors; use the moment-based test 'gauss', or fewer rows")
    picked = df.orderBy(*order_by) if order_by else df
    out = picked.select(*(F.col(f"`{c}`").cast("double") for c in columns)).toPandas().to_numpy(float)
    if not np.isfinite(out).all():
        raise ValueError("every value must be a finite number")
    return out


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """Row count and correlation matrix, by one aggregate over any number of rows."""
    cols = [F.col(f"`{c}`").cast("double") for c in columns]
    p = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i)]
    row = df.agg(*aggs).first()
    out = np.eye(p)
    for i in range(p):
        for j in range(i):
            v = row[f"c{i}_{j}"]
            out[i, j] = out[j, i] = np.nan if v is None else v
    return row.n, out
