"""Spline bases and penalties, in numpy and as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SplineConfig
from .radial import leading_radial, thin_plate

#: Distinct places up to which thin plates take all eigenpairs of their matrix.
EIGEN_PLACES = 2048


def quantile_knots(x: np.ndarray, count: int) -> np.ndarray:
    """Linearly interpolated quantiles at equal steps, two at least."""
    return np.quantile(np.asarray(x, float), np.linspace(0, 1, max(2, count)))


def bump_width(knots: np.ndarray) -> float:
    gaps = np.diff(knots)
    gaps = gaps[gaps > 0]
    return 2.5 * (float(gaps.min()) if len(gaps) else 1.0)


def bump_basis(x: np.ndarray, cfg: SplineConfig = SplineConfig()) -> np.ndarray:
    """Cubed tents around the knots, rows scaled to sum 1; rows that no tent reaches go to the nearest knot."""
    x = np.asarray(x, float)
    cols = max(6, cfg.knots)
    if not len(x):
        return np.zeros((0, cols))
    return tents(x, quantile_knots(x, cols))


def is_flat(knots: Sequence[float]) -> bool:
    """Whether a column's knots, its ends among them, are one value."""
    return knots[-1] - knots[0] <= 1e-12 * max(1.0, abs(knots[0]), abs(knots[-1]))


def tents(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """``bump_basis`` of some values with knots from all."""
    if is_flat(knots):
        out = np.zeros((len(x), len(knots)))
        out[:, 0] = 1
        return out
    far = np.abs(x[:, None] - knots)
    out = np.clip(1 - far / bump_width(knots), 0, None) ** 3
    total = out.sum(1)
    alone = total <= 0
    out[alone] = 0
    out[alone, far[alone].argmin(1)] = 1
    total[alone] = 1
    return out / total[:, None]


def second_difference_penalty(k: int) -> np.ndarray:
    if k < 3:
        return np.eye(k)
    d = np.diff(np.eye(k), n=2, axis=0)
    return d.T @ d


def design(columns: Sequence[np.ndarray], cfg: SplineConfig = SplineConfig()) -> tuple[np.ndarray, np.ndarray]:
    """Basis and penalty of a conditioning set: one smooth, a tensor product for two, a sum of smooths beyond."""
    bases = [bump_basis(c, cfg) for c in columns]
    pen = penalty_of([b.shape[1] for b in bases])
    return (bases[0] if len(bases) == 1 else tensor_rows(*bases) if len(bases) == 2 else additive_rows(bases)), pen


def tensor_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)


def additive_rows(bases: Sequence[np.ndarray]) -> np.ndarray:
    return np.hstack(list(bases))


def penalty_of(sizes: Sequence[int]) -> np.ndarray:
    """The penalty of a design from bases of these sizes."""
    pens = [second_difference_penalty(k) for k in sizes]
    if len(pens) == 1:
        return pens[0]
    if len(pens) == 2:
        return np.kron(pens[0], np.eye(sizes[1])) + np.kron(np.eye(sizes[0]), pens[1])
    out = np.zeros((sum(sizes), sum(sizes)))
    at = 0
    for p in pens:
        out[at : at + len(p), at : at + len(p)] = p
        at += len(p)
    return out


def lambda_grid(cfg: SplineConfig = SplineConfig()) -> np.ndarray:
    """Smoothing parameters at equal steps of their logarithm."""
    if cfg.lambda_count <= 1:
        return np.array([cfg.lambda_min])
    t = np.arange(cfg.lambda_count) / (cfg.lambda_count - 1)
    return np.exp(math.log(cfg.lambda_min) * (1 - t) + math.log(cfg.lambda_max) * t)


def lambda_grid_col(cfg: SplineConfig = SplineConfig()) -> Column:
    n, lo, hi = cfg.lambda_count, math.log(cfg.lambda_min), math.log(cfg.lambda_max)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(F.lit(lo) * (1 - i / (n - 1)) + F.lit(hi) * (i / (n - 1))))


def bump_basis_col(x: Column, knots: Column) -> Column:
    """The row of ``bump_basis`` for one value, with the knots as an array column."""
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.get(knots, i) - F.get(knots, i - 1)), lambda g: g > 0)
    width = 2.5 * F.coalesce(F.array_min(gaps), F.lit(1.0))
    raw = F.transform(knots, lambda c: F.pow(F.greatest(F.lit(0.0), 1 - F.abs(x - c) / width), F.lit(3.0)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
    near = F.array_min(F.transform(knots, lambda c, i: F.struct(F.abs(x - c).alias("d"), i.alias("i"))))["i"]
    alone = F.transform(knots, lambda c, i: F.when(i == near, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when(total > 0, F.transform(raw, lambda v: v / total)).otherwise(alone)


# ---- Thin-plate regression splines -------------------------------------------------------------


def tprs(columns: Sequence[np.ndarray], k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A centred thin-plate regression basis of rank ``k`` (10 for one variable, 30 for two) and its penalty."""
    z = np.column_stack(columns)
    n, dim = z.shape
    z = z - z.mean(0)
    k = k or (10 if dim == 1 else 30)
    places, where = np.unique(z, axis=0, return_inverse=True)
    k = min(k, len(places))
    poly = np.column_stack((np.ones(len(places)), places))
    if k <= poly.shape[1]:
        x = poly[where.ravel()][:, 1:]
        return x - x.mean(0), np.zeros((x.shape[1], x.shape[1]))
    if len(places) > EIGEN_PLACES and dim <= 2:
        d, u = leading_radial(places, k)
    else:
        e = thin_plate(np.sqrt(((places[:, None, :] - places[None]) ** 2).sum(2)), dim)
        val, vec = np.linalg.eigh(e)
        top = np.argsort(-np.abs(val), kind="stable")[:k]
        u, d = vec[:, top], val[top]
    # Coefficients of the radial part have no polynomial component.
    q, _ = np.linalg.qr((poly.T @ u).T, mode="complete")
    free = q[:, poly.shape[1] :]
    x = np.column_stack(((u * d) @ free, poly))
    s = np.zeros((x.shape[1], x.shape[1]))
    s[: free.shape[1], : free.shape[1]] = (free.T * d) @ free
    x = x[where.ravel()]
    scale = np.sqrt((x**2).mean(0))
    scale[scale == 0] = 1
    x, s = x / scale, s / np.outer(scale, scale)
    norm = np.abs(x).sum(1).max() ** 2 / max(np.abs(s).sum(0).max(), 1e-300)
    s = s * norm
    q, _ = np.linalg.qr(x.sum(0)[:, None], mode="complete")  # sums to zero over the rows
    return x @ q[:, 1:], q[:, 1:].T @ s @ q[:, 1:]


def tprs_design(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Design with an intercept, and a penalty for each smooth: joint for up to two variables, additive beyond."""
    parts = [tprs(columns)] if len(columns) <= 2 else [tprs([c]) for c in columns]
    n = len(columns[0])
    width = 1 + sum(p[0].shape[1] for p in parts)
    x, pens, at = np.ones((n, width)), [], 1
    for b, s in parts:
        m = b.shape[1]
        x[:, at : at + m] = b
        full = np.zeros((width, width))
        full[at : at + m, at : at + m] = s
        pens.append(full)
        at += m
    return x, pens


def tensor_col(a: Column, b: Column) -> Column:
    """The row of a tensor product basis from two basis rows."""
    return F.flatten(F.transform(a, lambda u: F.transform(b, lambda v: u * v)))


def additive_col(*rows: Column) -> Column:
    """The row of a sum of smooths from their basis rows."""
    return F.concat(*rows)
