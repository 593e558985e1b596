"""Leading eigenpairs of thin-plate matrices of many places, without the matrix.

Products with the matrix take time linear in the places.  In one dimension |x - y|^3 is a sum of products of powers on
either side of x, so running sums give them.  In two, values are spread on a grid by local polynomials of degree 5, and the
grid's kernel is a convolution; the grid is made finer until products agree with exact rows, and places that no
grid suits take exact products by blocks of rows.  Eigenpairs come from a block Krylov space, reorthogonalised in full.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Cells of the first grid and of the last one that is tried; points of a local polynomial.
CELLS, MOST_CELLS, POINTS = 1 << 18, 1 << 22, 6
#: Rows on which a grid is held against exact products, and the part of the smallest eigenvalue wanted that they may differ by.
CHECKED, AGREE = 128, 1e-6
_PAIRS = 1 << 21
#: Places up to which the matrix is made.
DENSE = 2048

Product = Callable[[np.ndarray], np.ndarray]


def thin_plate(r: np.ndarray, dim: int) -> np.ndarray:
    """The radial function of second-order thin plates, without its constant factor."""
    return r**3 / 12 if dim == 1 else np.where(r > 0, r**2 * np.log(np.where(r > 0, r, 1)), 0) / (8 * math.pi)


def exact_rows(places: np.ndarray, rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Some rows of the product, by blocks of them."""
    out = np.empty((len(rows), w.shape[1]))
    step = max(1, _PAIRS // len(places))
    for a in range(0, len(rows), step):
        at = places[rows[a : a + step]]
        square = sum((at[:, c, None] - places[None, :, c]) ** 2 for c in range(places.shape[1]))
        out[a : a + step] = thin_plate(np.sqrt(square), places.shape[1]) @ w
    return out


def line_product(x: np.ndarray) -> Product:
    """The product in one dimension."""
    order = np.argsort(x, kind="stable")
    scale = float(np.abs(x).max()) or 1.0
    v = (x[order] / scale)[:, None]
    back = np.argsort(order, kind="stable")

    def product(w: np.ndarray) -> np.ndarray:
        w = w[order]
        m = [np.cumsum(w * v**p, axis=0) for p in range(4)]
        # Twice the part below each value, less all of it.
        m = [2 * c - c[-1] for c in m]
        return ((v**3 * m[0] - 3 * v**2 * m[1] + 3 * v * m[2] - m[3]) * (scale**3 / 12))[back]

    return product


def grid_product(places: np.ndarray, cells: int) -> Product:
    """The product in two dimensions on a grid of about ``cells`` square cells."""
    low, width = places.min(0), np.ptp(places, axis=0)
    h = max(math.sqrt(width[0] * width[1] / cells), width.max() / (cells / 16))
    shape = [int(math.ceil(w / h)) + POINTS for w in width]
    at = (places - low) / h
    cell = np.minimum(np.floor(at).astype(np.int64), np.array(shape) - POINTS)
    weights = []
    for c in (0, 1):
        t = at[:, c] - cell[:, c] + (POINTS // 2 - 1)  # among the points 0, 1, ... of its polynomial
        weights.append([np.prod([(t - j) / (i - j) for j in range(POINTS) if j != i], axis=0) for i in range(POINTS)])
    # A place and itself are at distance 0, near which the kernel is no polynomial: that part is taken back.
    near = np.arange(POINTS)
    gap = (near[:, None] - near) * h
    own = thin_plate(np.sqrt(gap[:, None, :, None] ** 2 + gap[None, :, None, :] ** 2), 2).reshape(POINTS**2, POINTS**2)
    self_part = np.empty(len(places))
    for a in range(0, len(places), 1 << 15):
        both = (np.column_stack([w[a : a + (1 << 15)] for w in weights[0]])[:, :, None] * np.column_stack([w[a : a + (1 << 15)] for w in weights[1]])[:, None, :]).reshape(-1, POINTS**2)
        self_part[a : a + (1 << 15)] = ((both @ own) * both).sum(1)
    first = cell[:, 0] * shape[1] + cell[:, 1]
    full = [1 << (2 * s - 1).bit_length() for s in shape]
    gx, gy = (np.minimum(np.arange(f), f - np.arange(f)) * h for f in full)
    kernel = np.fft.rfft2(thin_plate(np.sqrt(gx[:, None] ** 2 + gy[None, :] ** 2), 2))

    def product(w: np.ndarray) -> np.ndarray:
        out = np.empty_like(w)
        for k in range(w.shape[1]):
            spread = np.zeros(shape[0] * shape[1])
            for i in range(POINTS):
                part = w[:, k] * weights[0][i]
                for j in range(POINTS):
                    spread += np.bincount(first + i * shape[1] + j, part * weights[1][j], len(spread))
            seen = np.fft.irfft2(np.fft.rfft2(spread.reshape(shape), full) * kernel, full)[: shape[0], : shape[1]].ravel()
            out[:, k] = sum(weights[0][i] * sum(weights[1][j] * seen[first + i * shape[1] + j] for j in range(POINTS)) for i in range(POINTS)) - self_part * w[:, k]
        return out

    return product


def leading(product: Product, n: int, count: int, block: int = 2, most: int = 1200) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of largest absolute value of a symmetric matrix, largest first."""
    rng = np.random.default_rng(0)
    q = np.empty((n, 0))
    new = np.linalg.qr(rng.normal(size=(n, block)))[0]
    t = np.zeros((0, 0))
    while True:
        q = np.column_stack((q, new))
        w = product(new)
        side = q.T @ w
        size = q.shape[1]
        grown = np.zeros((size, size))
        grown[: size - block, : size - block] = t
        grown[:, size - block :] = side
        grown[size - block :, :] = side.T
        t = grown
        w -= q @ side
        w -= q @ (q.T @ w)
        new, rest = np.linalg.qr(w)
        if size >= 2 * count and (size // block) % 8 == 0 or size + block > min(n, most):
            val, vec = np.linalg.eigh((t + t.T) / 2)
            top = np.argsort(-np.abs(val), kind="stable")[:count]
            error = np.linalg.norm(rest @ vec[size - block :, top], axis=0).max()
            if error <= 1e-8 * abs(val[top[-1]]):
                return val[top], q @ vec[:, top]
            if size + block > min(n, most):
                raise RuntimeError("the eigenpairs of the thin plates could not be found")
        new -= q @ (q.T @ new)
        new = np.linalg.qr(new)[0]


def leading_radial(places: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` leading eigenpairs of the thin-plate matrix of distinct, centred places.

    Places that agree up to rounding (2^-40 of the range) are one with a weight.
    """
    key = np.round((places - places.min(0)) / max(float(np.ptp(places, axis=0).max()), 1e-300) * 2.0**40)
    _, first, where, weight = np.unique(key, axis=0, return_index=True, return_inverse=True, return_counts=True)
    at, root = places[first], np.sqrt(weight)[:, None]
    n, dim = at.shape
    spread = lambda vec: (vec / root)[where.ravel()]
    if n <= DENSE:
        e = root * thin_plate(np.sqrt(((at[:, None, :] - at[None]) ** 2).sum(2)), dim) * root.T
        val, vec = np.linalg.eigh(e)
        top = np.argsort(-np.abs(val), kind="stable")[:count]
        if len(top) == count:
            return val[top], spread(vec[:, top])
    weighted = lambda product: lambda w: root * product(root * w)
    if dim == 1:
        val, vec = leading(weighted(line_product(at[:, 0])), n, count)
        return val, spread(vec)
    rows = np.unique(np.linspace(0, n - 1, CHECKED).astype(np.int64))
    cells = CELLS
    while cells <= MOST_CELLS and np.ptp(at, axis=0).min() > 0:
        product = weighted(grid_product(at, cells))
        val, vec = leading(product, n, count)
        off = np.linalg.norm(root[rows] * exact_rows(at, rows, root * vec) - vec[rows] * val, axis=0) * math.sqrt(n / len(rows))
        if off.max() <= AGREE * abs(val[-1]):
            return val, spread(vec)
        cells *= 4
    val, vec = leading(weighted(lambda w: exact_rows(at, np.arange(n), w)), n, count)
    return val, spread(vec)
