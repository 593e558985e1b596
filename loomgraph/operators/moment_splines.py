"""Penalised spline residuals of any number of rows: fits need sums of products only, and residuals are made in the tasks.

Knots are exact quantiles by a range-partitioned sort; X'X, X'y and y'y are one aggregate; the
driver solves for coefficients, and scores smoothing parameters by RSS = y'y - 2 b'X'y + b'X'Xb.
What is collected does not grow with the rows.  Fits are those of ``residuals.fast_spline``, up
to rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..config import SplineConfig
from ..functions.gram import gram
from ..functions.sorted_sums import exact_quantiles
from ..functions.splines import additive_rows, lambda_grid, penalty_of, tensor_rows, tents
from ..sources.staging import stage


@dataclass
class MomentFit:
    beta: np.ndarray
    gcv: float
    edf: float
    smoothing: float


def fit_moments(n: float, xtx: np.ndarray, xty: np.ndarray, yty: np.ndarray, penalty: np.ndarray, cfg: SplineConfig = SplineConfig()) -> list[MomentFit]:
    """The fit of each target (a column of ``xty``, a number of ``yty``) that minimises GCV over the grid."""
    m = xty.shape[1]
    best: list[MomentFit | None] = [None] * m
    ridge = cfg.ridge
    while ridge <= 1e-4 * (1 + 1e-12):
        open_ = [j for j in range(m) if best[j] is None]
        for lam in lambda_grid(cfg):
            try:
                solved = np.linalg.solve(xtx + lam * penalty + ridge * np.eye(len(xtx)), np.column_stack((xty[:, open_], xtx)))
            except np.linalg.LinAlgError:
                continue
            b, edf = solved[:, : len(open_)], float(np.trace(solved[:, len(open_) :]))
            free = n - edf
            if not math.isfinite(edf) or free <= 1e-8:
                continue
            rss = np.maximum(0.0, yty[open_] - 2 * (b * xty[:, open_]).sum(0) + (b * (xtx @ b)).sum(0))
            gcv = n * rss / free**2
            for i, j in enumerate(open_):
                if math.isfinite(gcv[i]) and (best[j] is None or gcv[i] < best[j].gcv - 1e-14):
                    best[j] = MomentFit(b[:, i].copy(), float(gcv[i]), edf, float(lam))
        if all(f is not None for f in best):
            return best
        ridge *= 100
    raise RuntimeError("the spline could not be solved")


def design_rows(values: Sequence[np.ndarray], knots: Sequence[Sequence[float]]) -> np.ndarray:
    """Rows of the design of a conditioning set."""
    bases = [tents(v, np.array(k)) for v, k in zip(values, knots, strict=True)]
    return bases[0] if len(bases) == 1 else tensor_rows(*bases) if len(bases) == 2 else additive_rows(bases)


def spline_fits(df: DataFrame, targets: Sequence[str], given: Sequence[str], cfg: SplineConfig = SplineConfig()) -> tuple[list[MomentFit], list[list[float]]]:
    """Fits of all targets of one conditioning set, which share its sums, and the knots."""
    steps = np.linspace(0, 1, max(6, cfg.knots))
    knots = [exact_quantiles(df, c, steps) for c in given]
    if not knots[0]:
        raise ValueError("there are no rows")
    sizes = [len(k) for k in knots]
    width = sizes[0] if len(given) == 1 else sizes[0] * sizes[1] if len(given) == 2 else sum(sizes)

    def rows(b: pa.RecordBatch) -> np.ndarray:
        values = [b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(b.num_columns)]
        x = design_rows(values[: len(given)], knots)
        return np.column_stack((x, *values[len(given) :], np.ones(len(x))))

    m = gram(df, [f"`{c}`" for c in (*given, *targets)], width + len(targets) + 1, rows)
    t = slice(width, width + len(targets))
    return fit_moments(m[-1, -1], m[:width, :width], m[:width, t], m[t, t].diagonal(), penalty_of(sizes), cfg), knots


def spline_residuals(df: DataFrame, targets: Sequence[str], given: Sequence[str], cfg: SplineConfig = SplineConfig(), prefix: str = "resid_") -> DataFrame:
    """``df`` with a column of residuals for each target; nulls in a column of the set or a target raise in the fit."""
    df = stage(df, "spline-rows")  # quantiles, sums and residuals read it
    fits, knots = spline_fits(df, targets, given, cfg)
    beta = np.column_stack([f.beta for f in fits])
    places = [df.columns.index(c) for c in (*given, *targets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in places]
            left = np.column_stack(values[len(given) :]) - design_rows(values[: len(given)], knots) @ beta
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, left.T)], names=[*b.schema.names, *(f"{prefix}{t}" for t in targets)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(f"{prefix}{t}", T.DoubleType()) for t in targets)]))


def projection_floor(df: DataFrame, target: str, columns: Sequence[str]) -> float:
    """The part of a column's norm that no linear function of others explains, by one aggregate: ``residuals.projection_floor`` of all rows."""
    m = gram(df, [f"`{c}`" for c in (*columns, target)], len(columns) + 2, lambda b: np.column_stack([np.ones(len(b)), *(b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(b.num_columns))]))
    beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
    rss = m[-1, -1] - 2 * beta @ m[:-1, -1] + beta @ m[:-1, :-1] @ beta
    return float(math.sqrt(max(rss, 0.0)) / max(math.sqrt(m[-1, -1]), 1e-300))
