"""Residuals as a table: each distinct request is fitted once, wherever it is asked from."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SplineConfig
from ..operators.residuals import residual
from ..sources.matrix import to_numpy


def residual_table(df: DataFrame, columns: Sequence[str], requests: DataFrame, *, order_by: Sequence[str], backend: str = "linear", spline: SplineConfig = SplineConfig()) -> DataFrame:
    """Rows (target, s_key, i, resid) for requests (target int, s array<int>); i counts rows in the order of a key.

    The matrix goes to the executors (its size is checked); requests of one set meet in one task.
    """
    data = to_numpy(df, columns, order_by)
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(data)
    once = requests.select("target", F.array_sort("s").alias("s")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        at = np.arange(len(x))
        for batch in batches:
            for target, s in zip(batch.column("target").to_pylist(), batch.column("s").to_pylist(), strict=True):
                r = residual(x[:, target], x[:, s], backend, spline)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), target, np.int32)), pa.array(["|".join(map(str, s))] * len(x)), pa.array(at), pa.array(r)], names=["target", "s_key", "i", "resid"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return once.repartition(n, "s").mapInArrow(run, "target int, s_key string, i long, resid double")
