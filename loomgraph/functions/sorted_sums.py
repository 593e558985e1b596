"""Sums over all pairs of rows from sorted order, in O(n log n): nothing here forms a pair.

For one variable a row's distances to all others follow from running sums in its order.
The sum of products of two variables' distances is that of (x_i - x_j)(y_i - y_j) over
concordant pairs less that over discordant ones; concordant pairs are counted by dominance:
rows are cut into blocks by x, pairs inside a block are summed in its task, pairs of two blocks
at the level of the highest bit in which the blocks' numbers differ, by running sums
in the order of y.  A level is a range-partitioned sort; its running sums add what earlier
partitions hold, so no window and no task sees more than a partition.

Equal rows are one row with a weight, so copies do not make a partition larger.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage
from .kernels import from_totals

BLOCK = 1 << 16
#: Blocks that a caller may have of fewer rows than ``BLOCK``: a block is a partition, and each level of pairs of blocks a sort.
SMALL_BLOCKS = 16


def block_count(n: int, block: int = BLOCK) -> int:
    """Blocks for ``n`` rows: of ``block`` rows, as long as these are not many small ones, whose tasks would grow with the rows."""
    return max(1, min(-(-n // block), max(SMALL_BLOCKS, -(-n // BLOCK))))


def range_blocks(df: DataFrame, order: Sequence[str], count: int, name: str) -> DataFrame:
    """``df`` in blocks of consecutive rows by ``order``, numbered in the column ``name``; written, so that numbers hold."""
    return stage(df.repartitionByRange(max(1, count), *order).withColumn(name, F.spark_partition_id()), f"range-{name}")


def running_sums(df: DataFrame, block: str, order: Sequence[str], values: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Add sums of ``values`` up to and with each row, in the order (block, order), restarted for each of ``keys``.

    Rows of a block are summed in a window; what earlier blocks hold is a table of a row for each block and key.
    """
    held = df.select("*", *(v.alias(f"_{c}") for c, v in values.items()))
    here = Window.partitionBy(block, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(block, *keys).agg(*(F.sum(f"_{c}").alias(f"_{c}") for c in values))
    offsets = totals.select(block, *keys, *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0.0)).alias(f"o_{c}") for c in values))
    local = held.select("*", *(F.sum(f"_{c}").over(here).alias(f"s_{c}") for c in values))
    return local.join(offsets, [block, *keys]).select(*df.columns, *((F.col(f"s_{c}") + F.col(f"o_{c}")).alias(c) for c in values))


def concordant_in_block(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The weighted sum of (x_i - x_j)(y_i - y_j) over pairs of rows with x_j < x_i and y_j < y_i, by bits of the rank of y.

    From the highest bit down, rows stand in groups of equal higher bits and in the order of x inside of them. Ranks are
    all numbers below n, so a group begins at its smallest rank, and the next bit's order deals each group in two.
    """
    n = len(y)
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order]
    rank = np.empty(n, np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(n)
    places = np.arange(n)
    total = 0.0
    sums = np.zeros((4, n + 1))  # of w, wx, wy, wxy over the rows with a low bit before each place
    for bit in reversed(range(int(n - 1).bit_length())):
        up = np.flatnonzero(rank >> bit & 1)
        low = (rank >> bit & 1) ^ 1
        wl = w * low
        for row, terms in zip(sums, (wl, wl * x, wl * y, wl * x * y), strict=True):
            np.cumsum(terms, out=row[1:])
        first = rank >> (bit + 1) << (bit + 1)
        start = first[up]
        c, sx, sy, sxy = (row[up] - row[start] for row in sums)
        xi, yi = x[up], y[up]
        total += float((w[up] * (xi * yi * c - xi * sy - yi * sx + sxy)).sum())
        before = np.concatenate(([0], np.cumsum(low)))
        lows = before[:-1] - before[first]  # of the group's, before each place
        to = first + np.where(low, lows, (1 << bit) + places - first - lows)
        turned = np.empty((3, n))
        for row, v in zip(turned, (x, y, w), strict=True):
            row[to] = v
        x, y, w = turned
        moved = np.empty_like(rank)
        moved[to] = rank
        rank = moved
    return total


#: Rows up to which concordant pairs are summed in a grid of blocks, in n^(4/3) plain steps; beyond, bits of the rank take fewer.
GRID_ROWS = 1 << 17


def _concordant_inside(a: np.ndarray, b: np.ndarray, side: int, apart: np.ndarray | None = None) -> float:
    """The sum of (a_i - a_j)(b_i - b_j) over pairs of one block with b_j < b_i; a ascends, and blocks are ``side`` consecutive rows.

    Pairs with equal numbers in ``apart`` are left out.  A row of the turned arrays holds the rows of one place in all blocks.
    """
    count = -(-len(a) // side)
    fill = count * side - len(a)  # rows behind the last, with the smallest b: they are above none
    turn = lambda v, last: np.ascontiguousarray(np.concatenate((v, np.full(fill, last, v.dtype))).reshape(count, side).T)
    a, b = turn(a, a[-1]), turn(b, b.min())
    if apart is not None:
        apart = turn(apart, 0)
    total = 0.0
    for lag in range(1, side):
        over = b[lag:] - b[:-lag]
        np.maximum(over, 0, out=over)
        if apart is not None:
            over[apart[lag:] == apart[:-lag]] = 0
        total += float(np.vdot(a[lag:] - a[:-lag], over))
    return total


def concordant_in_grid(x: np.ndarray, y: np.ndarray, rank: np.ndarray, side: int | None = None) -> float:
    """``concordant_in_block`` of rows of weight 1 in the order of x, with the rank of y; equal values may rank in any order.

    Blocks of ``side`` consecutive rows by x, and by y, are a grid.  Pairs that differ in both blocks come from sums of cells
    below each cell, pairs of one block by x, or by y only, from the differences of its rows.
    """
    n = len(x)
    side = side or max(16, round(2.8 * n ** (1 / 3)))
    k = -(-n // side)
    block = np.arange(n, dtype=np.int32) // side
    cell = block * k + rank // side
    own = [np.bincount(cell, w, k * k).reshape(k, k) for w in (np.ones(n), x, y, x * y)]
    below = [v.cumsum(0) for v in own]
    c, sx, sy, sxy = (np.cumsum(v, 1, out=v)[:-1, :-1] for v in below)
    one, vx, vy, vxy = (v[1:, 1:] for v in own)
    total = sum(float(np.einsum("ij,ij", u, v)) for u, v in ((vxy, c), (one, sxy))) - sum(float(np.einsum("ij,ij", u, v)) for u, v in ((vx, sy), (vy, sx)))
    by_y = np.empty((2, n))
    by_y[0, rank], by_y[1, rank] = x, y
    blocks = np.empty(n, np.int32)
    blocks[rank] = block
    return total + _concordant_inside(x, y, side) + _concordant_inside(by_y[1], by_y[0], side, blocks)


class PermutedProducts:
    """Sums over all pairs of rows of |x_i - x_j| |y_i - y_j| for permutations of y; both are put in order once."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.by_x = np.argsort(x, kind="stable")
        self.x, self.y = x[self.by_x] - x.mean(), y - y.mean()
        self.sums = float(self.x.sum()) * float(self.y.sum())
        self.rank = np.empty(len(y), np.int32)
        self.rank[np.argsort(y, kind="stable")] = np.arange(len(y), dtype=np.int32)

    def __call__(self, order: np.ndarray | None = None) -> float:
        at = self.by_x if order is None else order[self.by_x]
        y, n = self.y[at], len(at)
        g = concordant_in_grid(self.x, y, self.rank[at]) if n <= GRID_ROWS else concordant_in_block(self.x, y, np.ones(n))
        return 2 * (2 * g - (n * float(self.x @ y) - self.sums))


def distance_sums(sample: DataFrame, x: str, y: str, block: int = BLOCK) -> DataFrame:
    """``kernels.centred_sums`` of the distances of two columns."""
    sample = stage(sample.select(F.col(x).alias(x), F.col(y).alias(y)), "distance-rows")
    m = sample.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y")).first()
    mean_x, mean_y = m.x or 0.0, m.y or 0.0
    rows = sample.select((F.col(x) - mean_x).alias("x"), (F.col(y) - mean_y).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    count = block_count(m.n, block)
    by_x = range_blocks(rows, ["x", "y"], count, "bx")
    w, wx, wy = F.col("w"), F.col("w") * F.col("x"), F.col("w") * F.col("y")
    t = by_x.agg(F.sum(w).alias("n"), F.sum(wx).alias("sx"), F.sum(wy).alias("sy"), F.sum(wx * F.col("x")).alias("sxx"), F.sum(wy * F.col("y")).alias("syy"), F.sum(wx * F.col("y")).alias("sxy"))

    def row_sum(v: str) -> Column:
        """A row's distances to all: what lies before it, and what behind, by running sums up to it."""
        return F.col(v) * (2 * F.col("up_to") - F.col("n")) - 2 * F.col("below") + F.col(f"s{v}")

    one = F.broadcast(t)  # a single row
    with_x = running_sums(by_x, "bx", ["x", "y"], {"up_to": w, "below": wx}).crossJoin(one).select("x", "y", "w", row_sum("x").alias("rk"))
    by_y = range_blocks(with_x, ["y", "x"], count, "by")
    with_y = running_sums(by_y, "by", ["y", "x"], {"up_to": w, "below": wy}).crossJoin(one).select("w", "rk", row_sum("y").alias("rl"))
    r = with_y.agg(*(F.sum(w * e).alias(n) for n, e in (("rk", F.col("rk")), ("rl", F.col("rl")), ("rr", F.col("rk") * F.col("rl")), ("rrk", F.col("rk") * F.col("rk")), ("rrl", F.col("rl") * F.col("rl")))))

    def inside(t: pa.Table) -> pa.Table:
        return pa.table({"g": [concordant_in_block(*(t[c].to_numpy() for c in ("x", "y", "w")))]})

    parts = by_x.groupBy("bx").applyInArrow(inside, "g double")
    levels = (count - 1).bit_length()
    if levels:
        low = F.expr("(shiftright(bx, level) & 1) = 0")
        spread = by_x.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")).select("level", F.expr("shiftright(bx, level + 1)").alias("half"), low.alias("low"), "x", "y", "w")
        placed = range_blocks(spread, ["level", "half", "y", "x"], count * levels, "p")
        only = lambda e: F.when(F.col("low"), e).otherwise(0.0)
        sums = running_sums(placed, "p", ["y", "x"], {"c": only(w), "cx": only(wx), "cy": only(wy), "cxy": only(wx * F.col("y"))}, ["level", "half"])
        over = F.col("w") * (F.col("x") * F.col("y") * F.col("c") - F.col("x") * F.col("cy") - F.col("y") * F.col("cx") + F.col("cxy"))
        parts = parts.unionByName(sums.filter(~F.col("low")).agg(F.sum(over).alias("g")))
    g = parts.agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("g"))
    n = F.col("n")
    pairs = n * F.col("sxy") - F.col("sx") * F.col("sy")  # over unordered pairs, (x_i - x_j)(y_i - y_j)
    totals = t.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(g)).select(  # single rows
        "n", "rk", "rl", "rr", "rrk", "rrl", (2 * (2 * F.col("g") - pairs)).alias("kl"), (2 * (n * F.col("sxx") - F.col("sx") * F.col("sx"))).alias("kk"), (2 * (n * F.col("syy") - F.col("sy") * F.col("sy"))).alias("ll"), F.col("rk").alias("ok"), F.col("rl").alias("ol"),
    )
    return from_totals(totals)


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """Linearly interpolated quantiles of all values, exactly: a range-partitioned sort, and only the asked places leave it."""
    values = df.select(F.col(column).cast("double").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    blocks = range_blocks(values, ["v"], df.sparkSession.sparkContext.defaultParallelism, "b")
    up_to = running_sums(blocks, "b", ["v"], {"up_to": F.col("w").cast("double")})
    n = int(blocks.agg(F.sum("w").alias("n")).first().n or 0)
    if not n:
        return []
    at = [p * (n - 1) for p in probabilities]
    places = sorted({int(f(a)) for a in at for f in (np.floor, np.ceil)})
    asked = F.explode(F.array(*map(F.lit, places))).alias("place")
    held = up_to.filter(F.exists(F.array(*map(F.lit, places)), lambda k: (k < F.col("up_to")) & (k >= F.col("up_to") - F.col("w")))).select("v", "w", "up_to", asked)
    found = {r.place: r.v for r in held.filter((F.col("place") < F.col("up_to")) & (F.col("place") >= F.col("up_to") - F.col("w"))).select("place", "v").collect()}  # two for each probability
    return [found[int(np.floor(a))] + (a - np.floor(a)) * (found[int(np.ceil(a))] - found[int(np.floor(a))]) for a in at]
