"""Made-up observations with a known graph, as Spark expressions over ``range``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directed edges (0-based) of each scenario.
TRUTH = {
    "chain": ((0, 1), (1, 2)),
    "fork": ((0, 1), (0, 2)),
    "collider": ((0, 2), (1, 2)),
    "independent": (),
    "additive": ((0, 2), (1, 2), (2, 3)),
    "four": ((2, 0), (2, 1)),
}


def scenario(spark: SparkSession, name: str, n: int = 140, seed: int = 1) -> DataFrame:
    """Rows (row_id, x1..x4) of a named scenario."""
    base = spark.range(n, numPartitions=1).withColumnRenamed("id", "row_id")
    uni = lambda k: (F.rand(seed * 31 + k) * 2 - 1) * math.pi
    nor = lambda k, s=0.12: F.randn(seed * 31 + k) * s
    d = base.withColumns({"u1": uni(1), "u2": uni(2), "e1": nor(3, 1.0), "e2": nor(4, 1.0), "e3": nor(5, 1.0), "e4": nor(6, 1.0)})
    u1, u2, e1, e2, e3, e4 = (F.col(c) for c in ("u1", "u2", "e1", "e2", "e3", "e4"))
    if name == "chain":
        d = d.withColumn("x1", u1 + 0.08 * e1).withColumn("x2", F.sin("x1") + 0.12 * e2).withColumn("x3", F.pow("x2", F.lit(2)) + 0.12 * e3).withColumn("x4", e4)
    elif name == "fork":
        d = d.withColumn("x1", u1).withColumn("x2", F.sin("x1") + 0.12 * e2).withColumn("x3", F.cos("x1") + 0.12 * e3).withColumn("x4", e4)
    elif name == "collider":
        d = d.withColumns({"x1": u1, "x2": u2, "x3": F.sin(u1) + F.cos(u2) + 0.12 * e3, "x4": e4})
    elif name == "independent":
        d = d.withColumns({"x1": e1, "x2": e2, "x3": e3, "x4": e4})
    elif name == "additive":
        d = d.withColumns({"x1": u1, "x2": u2, "x3": F.sin(u1) + F.cos(u2) + 0.12 * e3}).withColumn("x4", F.col("x3") + 0.2 * e4)
    elif name == "four":
        z = (u1 / math.pi + 1) / 2
        d = d.withColumns({"x1": z + 0.1 * e1, "x2": z * z + 0.1 * e2, "x3": z, "x4": e4})
    else:
        raise ValueError(f"unknown scenario {name!r}; known: {', '.join(TRUTH)}")
    return d.select("row_id", "x1", "x2", "x3", "x4")


def truth(spark: SparkSession, name: str) -> DataFrame:
    """Rows (a, b, mark) of a scenario's directed edges."""
    return spark.createDataFrame([(a, b, 1) for a, b in TRUTH[name]], "a int, b int, mark int")


def shared_roots(spark: SparkSession, n: int, p: int, seed: int = 8600) -> DataFrame:
    """Rows (row_id, V1..Vp): smooth functions of two common roots, with noise."""
    d = spark.range(n, numPartitions=1).withColumnRenamed("id", "row_id").withColumns({"r1": F.randn(seed), "r2": F.randn(seed + 1)})
    cols = [(F.sin(F.col("r1") * (0.5 + j / p)) + 0.35 * F.cos("r2") + 0.15 * F.col("r1") * F.col("r2") + 0.25 * F.randn(seed + 1 + j)).alias(f"V{j}") for j in range(1, p + 1)]
    return d.select("row_id", *cols)


def linear_blocks(spark: SparkSession, n: int = 500, blocks: int = 10, seed: int = 1050050) -> DataFrame:
    """Rows (row_id, v01..): blocks of five variables, each a weighted sum of those before it plus noise."""
    d = spark.range(n, numPartitions=1).withColumnRenamed("id", "row_id")
    names = []
    for b in range(blocks):
        own: list[str] = []
        for j in range(5):
            name = f"v{b * 5 + j + 1:02d}"
            value = F.randn(seed + b * 5 + j)
            for w, before in zip((0.65, 0.55, 0.50, 0.45), reversed(own), strict=False):
                value = value + w * F.col(before)
            d = d.withColumn(name, value)
            own.append(name)
        names += own
    return d.select("row_id", *names)
