"""Sums over all pairs of rows, tile by tile: what tests of many rows need of their kernels.

Rows are dealt into blocks by a hash of their identifier; a task holds the rows of two blocks
and nothing of the n x n matrices but their tile.  A tile gives each of its rows the sums over
the rows of the other block, which an aggregate adds up.  Kernels are symmetric, so of two
blocks one tile is made, and inside of it matrices of some ``CELLS`` values at a time.  For ``n`` rows in b blocks there
are b^2 / 2 tiles, and a row travels to b of them: quadratic work, as the statistics ask for, in bounded memory.  Blocks
have at most ``GROUP`` rows, and there are no more than ``SMALL_BLOCKS`` smaller ones, however small a caller asks for them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .kernels import from_totals, permutations, row_totals
from .smooth import rbf_sums

TILE = 1024
GROUP, SMALL_BLOCKS = 1 << 14, 16
CELLS = 1 << 17


@dataclass(frozen=True)
class Kernel:
    """``distance`` (Euclidean, to the power ``index``) or ``rbf`` (exp(-d^2 / sig)) of one or more columns."""

    columns: tuple[str, ...]
    kind: str = "distance"
    index: float = 1.0
    sig: float = 1.0

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if a.shape[1] == 1:
            d = np.abs(a - b.T)
            if self.kind == "distance":
                return d if self.index == 1 else d**self.index
            return np.exp(-d * d / self.sig)
        square = np.zeros((len(a), len(b)))
        for c in range(a.shape[1]):
            square += (a[:, c, None] - b[None, :, c]) ** 2
        if self.kind == "rbf":
            return np.exp(-square / self.sig)
        return np.sqrt(square) if self.index == 1 else square ** (self.index / 2)


def _tiles(sample: DataFrame, blocks: int, *columns: str) -> DataFrame:
    """Each row once for each tile that it belongs to: (ta, tb) with ta <= tb."""
    block = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    return sample.select("i", *columns, block.alias("block"), other).select("i", *columns, "block", F.least("block", "o").alias("ta"), F.greatest("block", "o").alias("tb"))


def _split(t: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    ta, tb = t["ta"][0].as_py(), t["tb"][0].as_py()
    block = t["block"].to_numpy()
    return t.filter(pa.array(block == ta)), t.filter(pa.array(block == tb)), ta == tb


def _values(t: pa.Table, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([t[c].to_numpy() for c in columns]).astype(float)


def block_count(n: int, tile: int) -> int:
    return max(1, min(math.ceil(n / tile), max(SMALL_BLOCKS, math.ceil(n / GROUP))))


def blocks_of(sample: DataFrame, tile: int) -> int:
    return block_count(sample.count(), tile)


def _cells(rows: int, columns: int) -> Iterator[tuple[slice, slice]]:
    """Parts of a tile that a task holds at a time."""
    for i in range(0, rows, 128):
        for j in range(0, columns, CELLS // 128):
            yield slice(i, i + 128), slice(j, j + CELLS // 128)


def row_sums(sample: DataFrame, k: Kernel, l: Kernel, tile: int = TILE) -> DataFrame:
    """Rows (i, rk, rl, kl, kk, ll, ok, ol) for rows (i, columns...) with distinct i: see ``kernels.row_totals``."""
    columns = tuple(dict.fromkeys((*k.columns, *l.columns)))
    kind = sample.schema["i"].dataType.simpleString()

    def one(t: pa.Table) -> pa.Table:
        a, b, same = _split(t)
        (ka, la), (kb, lb) = ((_values(x, k.columns), _values(x, l.columns)) for x in (a, b))
        sums = np.zeros((5, len(a))), np.zeros((5, len(b)))
        for i, j in _cells(len(a), len(b)):
            km, lm = k.of(ka[i], kb[j]), l.of(la[i], lb[j])
            for side, axis, at, to in ((0, 1, i, "i"), (1, 0, j, "j"))[: 1 if same else 2]:
                sums[side][:, at] += km.sum(axis), lm.sum(axis), *(np.einsum(f"ij,ij->{to}", *m) for m in ((km, lm), (km, km), (lm, lm)))
        out = []
        for rows, got in zip((a, b)[: 1 if same else 2], sums, strict=False):
            # A row and itself lie in the tile of a block with itself: at distance 0, or with a kernel of 1.
            own = [float(same and of.kind == "rbf") for of in (k, l)]
            out.append(pa.table({"i": rows["i"], **dict(zip(("rk", "rl", "kl", "kk", "ll"), got, strict=True)), "ok": got[0] - own[0], "ol": got[1] - own[1]}))
        return pa.concat_tables(out)

    names = ("rk", "rl", "kl", "kk", "ll", "ok", "ol")
    sample = stage(sample.select("i", *columns), "tile-sample")  # counted, then dealt out
    made = _tiles(sample, blocks_of(sample, tile), *columns).groupBy("ta", "tb").applyInArrow(one, f"i {kind}, " + ", ".join(f"{c} double" for c in names))
    return made.groupBy("i").agg(*(F.sum(c).alias(c) for c in names))


def centred_sums(sample: DataFrame, k: Kernel, l: Kernel, tile: int = TILE) -> DataFrame:
    """``kernels.centred_sums`` of two kernels, without a table of pairs; RBF kernels of one column each need no pairs at all."""
    if k.kind == l.kind == "rbf" and len(k.columns) == len(l.columns) == 1:
        smooth = rbf_sums(sample, *k.columns, *l.columns, k.sig, l.sig)
        if smooth is not None:
            return smooth
    return from_totals(row_totals(row_sums(sample, k, l, tile)))


def permutation_test(sample: DataFrame, k: Kernel, l: Kernel, replicates: int, seed: int, scale: Callable[[Column], Column], include_observed: bool = True, strict: bool = False, tile: int = TILE) -> DataFrame:
    """One row (statistic, replicates, exceedances, p_value): replicates permute the rows of ``l``.

    A tile makes ``k`` once and ``l`` of the permuted values for each replicate.  Centring is algebra on row sums.
    """
    rows = stage(row_sums(sample, k, l, tile), "tile-rows")
    seen = from_totals(row_totals(rows)).select("n", "sk", "sl", F.col("ab").alias("s0"))
    perm = permutations(sample, replicates, seed)
    moved = perm.join(sample.select(F.col("i").alias("pi"), F.array(*l.columns).alias("v")), "pi").join(rows.select(F.col("i").alias("pi"), "rl"), "pi")
    # For each row the values that take its place, one for each replicate.
    turned = moved.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rep", "v", "rl"))).alias("m"))
    wide = sample.join(turned, "i").join(rows.select("i", "rk"), "i").select("i", *k.columns, "rk", F.flatten(F.col("m.v")).alias("v"), F.col("m.rl").alias("prl"))
    cross = wide.select("rk", F.posexplode("prl").alias("rep", "prl")).groupBy("rep").agg(F.sum(F.col("rk") * F.col("prl")).alias("rr"))
    dims = len(l.columns)

    def one(t: pa.Table) -> pa.Table:
        a, b, same = _split(t)
        if not a.num_rows or not b.num_rows:
            return pa.table({"rep": pa.array([], pa.int32()), "raw": pa.array([], pa.float64())})
        ka, kb = _values(a, k.columns), _values(b, k.columns)
        va, vb = (x["v"].combine_chunks() for x in (a, b))
        va, vb = (np.asarray(x.flatten() if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks).flatten()).reshape(len(x), replicates, dims) for x in (va, vb))
        raw = np.zeros(replicates)
        for i, j in _cells(len(a), len(b)):
            km = k.of(ka[i], kb[j]) * (1 if same else 2)
            raw += [float(np.vdot(km, l.of(va[i, r], vb[j, r]))) for r in range(replicates)]
        return pa.table({"rep": pa.array(range(replicates), pa.int32()), "raw": raw})

    reps = _tiles(wide, blocks_of(sample, tile), *k.columns, "v").groupBy("ta", "tb").applyInArrow(one, "rep int, raw double").groupBy("rep").agg(F.sum("raw").alias("raw")).join(cross, "rep")
    each = reps.crossJoin(F.broadcast(seen)).select("n", "s0", (F.col("raw") - 2 / F.col("n") * F.col("rr") + F.col("sk") * F.col("sl") / (F.col("n") * F.col("n"))).alias("s"))  # one row
    # Replicates that tie with the observed value up to rounding count as equal to it.
    near = F.abs(F.col("s") - F.col("s0")) <= 1e-9 * F.abs(F.col("s0"))
    over = ((F.col("s") > F.col("s0")) & ~near) if strict else ((F.col("s") >= F.col("s0")) | near)
    counted = each.agg(F.sum(over.cast("int")).alias("exceedances"), F.count(F.lit(1)).alias("replicates"), F.first("s0").alias("s0"), F.first("n").alias("n"))
    inc = int(include_observed and not strict)
    return counted.select(scale(F.col("n")).alias("f"), "*").select((F.col("s0") * F.col("f")).alias("statistic"), "replicates", "exceedances", ((F.col("exceedances") + inc) / (F.col("replicates") + inc)).alias("p_value"))
