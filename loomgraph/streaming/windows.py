"""An extension: correlation graphs of time windows of a stream.

The search itself is a batch computation.  Here a stream's windows are reduced to
moments by a watermarked aggregation, which is all that the test 'gauss' needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_moments(stream: DataFrame, time: str, columns: Sequence[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows (start, end, n, c_i_j...) of each window's correlations; works on tables and on streams."""
    cols = [F.col(c).cast("double") for c in columns]
    w = F.window(time, length, slide) if slide else F.window(time, length)
    pairs = [F.corr(cols[i], cols[j]).alias(f"c_{j}_{i}") for i in range(len(cols)) for j in range(i)]
    src = stream.withWatermark(time, late) if stream.isStreaming else stream
    return src.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), *pairs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *(f"c_{j}_{i}" for i in range(len(cols)) for j in range(i)))
