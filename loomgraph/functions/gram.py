"""Sums of outer products over all rows, in one aggregate: rows stay where they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rows = Callable[[pa.RecordBatch], np.ndarray]


def gram(df: DataFrame, columns: Sequence[str], width: int, rows: Rows) -> np.ndarray:
    """The sum of r r' over all rows r, of ``width`` numbers, that ``rows`` makes from batches of ``columns``.

    A task sums its rows; the tasks' sums, ``width`` squared numbers each, are added up by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            r = rows(b)
            total += r.T @ r
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((width, width))
    for r in df.select(*columns).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # width^2 / 2 numbers
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out
