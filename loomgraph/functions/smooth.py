"""RBF kernels of one variable as polynomials: sums over all pairs of rows from one pass over the rows.

On a bounded range exp(-(x - y)^2 / sig) is a sum of products of Chebyshev polynomials in x and in y,
K = T C T', whose terms fall faster than any power.  ``terms`` takes so many that the bound on what is
left out lies below the rounding of a double, so sums are those over all pairs of rows; what a test
needs of n rows are sums of products of polynomials, of which there are some dozens.  The number grows with the range's
width in units of the root of sig; beyond ``MOST`` a caller takes pairs (``functions.tiles``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .gram import gram

#: Polynomials of a variable up to which a kernel is expanded; its range then is some 40 roots of sig wide.
MOST = 256
_LEFT_OUT = 1e-16


def terms(low: float, high: float, sig: float) -> int | None:
    """How many polynomials leave out less than ``_LEFT_OUT`` of the kernel anywhere on the range; nothing if over ``MOST``.

    On the ellipse with half axes (r + 1/r) / 2 and (r - 1/r) / 2 the kernel is at most exp(c b^2), b the second axis and
    c the squared half width over sig, so a series cut at m leaves at most 4 exp(c b^2) r^-m / (r - 1), in each variable.
    """
    c = ((high - low) / 2) ** 2 / sig
    if not math.isfinite(c):
        return None
    r = 1 + np.geomspace(1e-3, 1e6, 2000)
    # Interpolation in two variables doubles it twice, times the bound on the interpolation of the second.
    need = (math.log(16 * (1 + math.log(MOST)) / _LEFT_OUT) + c * ((r - 1 / r) / 2) ** 2 - np.log(r - 1)) / np.log(r)
    m = max(1, math.ceil(need.min()))
    return m if m <= MOST else None


def polynomials(x: np.ndarray, low: float, high: float, m: int) -> np.ndarray:
    """The first ``m`` Chebyshev polynomials of each value."""
    half = (high - low) / 2
    t = np.clip((x - low) / half - 1, -1, 1) if half > 0 else np.zeros(len(x))
    return np.cos(np.arccos(t)[:, None] * np.arange(m))


def coefficients(low: float, high: float, sig: float, m: int) -> np.ndarray:
    """C of the kernel on the range."""
    t = np.cos(np.pi * (np.arange(m) + 0.5) / m)
    k = np.exp(-(((t[:, None] - t) * (high - low) / 2) ** 2) / sig)
    to = np.cos(np.pi * np.arange(m)[:, None] * (np.arange(m) + 0.5) / m) * 2 / m
    to[0] /= 2
    out = to @ k @ to.T
    return (out + out.T) / 2


def products(c: np.ndarray, m: np.ndarray, d: np.ndarray) -> float:
    """The inner product of T C T' and U D U' from m = T'U."""
    return float(((c @ m) * (m @ d)).sum())


def rbf_sums(sample: DataFrame, x: str, y: str, sig_x: float = 1.0, sig_y: float = 1.0) -> DataFrame | None:
    """``kernels.centred_sums`` of two RBF kernels; nothing where a range is too wide for its sig."""
    rows = stage(sample.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "rbf-rows")
    at = rows.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max)))).first()
    if at.low_x is None:
        return None
    ends = [(at.low_x, at.high_x, sig_x), (at.low_y, at.high_y, sig_y)]
    m = [terms(*e) for e in ends]
    if None in m:
        return None

    def made(b: pa.RecordBatch) -> np.ndarray:
        # The first polynomial is 1.
        return np.column_stack([polynomials(b.column(j).to_numpy(zero_copy_only=False), *ends[j][:2], m[j]) for j in (0, 1)])

    g = gram(rows, ["x", "y"], m[0] + m[1], made)
    n, total = g[0, 0], g[0]
    centred = g - np.outer(total, total) / n
    p, q = slice(0, m[0]), slice(m[0], None)
    c, d = (coefficients(*e, k) for e, k in zip(ends, m, strict=True))
    sk, sl = float(total[p] @ c @ total[p]), float(total[q] @ d @ total[q])
    off = n * (n - 1)
    # A row's kernel with itself is 1.
    row = (n, sk, sl, (sk - n) / off if off else None, (sl - n) / off if off else None, products(c, centred[p, q], d), products(c, centred[p, p], c), products(d, centred[q, q], d))
    return sample.sparkSession.createDataFrame([tuple(None if v is None else float(v) for v in row)], "n double, sk double, sl double, mu_k double, mu_l double, ab double, aa double, bb double")
