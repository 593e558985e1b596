"""Centroid clustering of integer vectors with adaptive bounds.

Each vector keeps an upper bound of the distance to its centroid, lower bounds of the
distances to its next nearest centroids, one each, and one remainder bound for all others.
When centroids move, bounds move by at most as much.  While the upper bound is below all
lower ones, the vector stays where it is and no distance is computed.  Where only some of
the near centroids could be nearer, those are measured; where the remainder can't be
excluded, all are.  How many bounds are kept adapts: a round keeps as many as the round
before it has used, between an eighth and a quarter of the number of centroids.

Distances are compared as exact integers, equal ones by the smaller number of the
centroid; bounds are doubles with a margin, and only a strict order is certified.

A round is a map over the vectors, written to the shared folder with its bounds (the
state before it is deleted then), and an aggregate of sums.  The driver holds centroids
only: ``k`` times ``dims`` integers.

Edge cases: vectors that are null, of another length, or with a null or non-finite
component are left out; null identifiers hash as empty ones; of vectors with one
identifier each is a vector of its own, in order of components where their hash is equal;
with fewer than ``k`` vectors there are as many centroids; an empty table gives an empty
one; extra columns are ignored.  Components beyond ``vectors.LARGEST`` raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import drop_tree, release_memory, stage
from .vectors import as_integers, folder_of, is_finite, matrix

MARGIN = 1e-9


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c, as integers."""
    largest = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * largest * largest < 2**53:
        return np.rint((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    xi, ci = x.astype(np.int64), c.astype(np.int64)
    return (xi * xi).sum(1)[:, None] - 2 * (xi @ ci.T) + (ci * ci).sum(1)[None, :]


def _some_squares(x: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The same for the centroids that each row names."""
    out = np.empty(which.shape, np.int64)
    xi, ci = x.astype(np.int64), c.astype(np.int64)
    for at in range(0, len(x), 4096):
        d = xi[at : at + 4096, None, :] - ci[which[at : at + 4096]]
        out[at : at + 4096] = (d * d).sum(2)
    return out


def _down(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 - MARGIN)


def _up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 + MARGIN)


def first_bounds(x: np.ndarray, c: np.ndarray, keep: int) -> dict[str, np.ndarray]:
    """Every vector's centroid and bounds, by measuring all distances."""
    d = _squares(x, c)
    order = np.argsort(d, axis=1, kind="stable")
    near = order[:, 1 : keep + 1]
    rows = np.arange(len(x))
    beyond = order[:, keep + 1] if keep + 1 < len(c) else None
    return {
        "cluster": order[:, 0], "upper": _up(d[rows, order[:, 0]]), "near": near, "low": _down(np.take_along_axis(d, near, 1)),
        "rest": _down(d[rows, beyond]) if beyond is not None else np.full(len(x), np.inf), "used": np.full(len(x), near.shape[1]),
    }


def moved_bounds(s: dict[str, np.ndarray], x: np.ndarray, c: np.ndarray, moves: np.ndarray, keep: int) -> dict[str, np.ndarray]:
    """The state after centroids have moved to ``c``, each by ``moves`` at most; ``used`` is the last bound that was not enough."""
    near, low = s["near"].copy(), s["low"] - moves[s["near"]]
    upper, rest = s["upper"] + moves[s["cluster"]], s["rest"] - moves.max(initial=0.0)
    cluster = s["cluster"].copy()
    used = np.zeros(len(x), np.int64)
    if near.shape[1] > keep:  # bounds that are no longer kept join the remainder
        rest = np.minimum(rest, low[:, keep:].min(1))
        near, low = near[:, :keep], low[:, :keep]
    least = np.minimum(low.min(1, initial=np.inf), rest)
    open_ = np.flatnonzero(~(upper < least))
    if len(open_):  # the upper bound made exact
        own = _some_squares(x[open_], c, cluster[open_, None])[:, 0]
        upper[open_] = _up(own)
        open_ = open_[~(upper[open_] < least[open_])]
    if len(open_):
        whole = ~(upper[open_] < rest[open_])
        part = open_[~whole]
        if len(part):  # the remainder is farther: an order among the kept ones
            used[part] = ((low[part] <= upper[part, None]) * np.arange(1, low.shape[1] + 1)).max(1)
            names = np.concatenate((cluster[part, None], near[part]), axis=1)
            d = _some_squares(x[part], c, names)
            order = np.lexsort((names, d), axis=1)
            names, d = np.take_along_axis(names, order, 1), np.take_along_axis(d, order, 1)
            cluster[part], upper[part] = names[:, 0], _up(d[:, 0])
            near[part], low[part] = names[:, 1:], _down(d[:, 1:])
        again = open_[whole]
        if len(again):
            found = first_bounds(x[again], c, near.shape[1])
            for name, into in (("cluster", cluster), ("upper", upper), ("near", near), ("low", low), ("rest", rest), ("used", used)):
                into[again] = found[name]
    return {"cluster": cluster, "upper": upper, "near": near, "low": low, "rest": rest, "used": used}


def _lists(a: np.ndarray) -> pa.Array:
    n, m = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(np.ascontiguousarray(a).ravel()))


def cluster(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, prefix: str = "2:") -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark: SparkSession = df.sparkSession
    vec = F.col(f"`{vec_col}`")
    kept = df.filter(is_finite(vec) & (F.size(vec) == dims)).select(F.col(f"`{id_col}`").alias("id"), as_integers(vec, scale).alias("q"))
    kind = kept.schema["id"].dataType.simpleString()
    rows = stage(kept, "centroid-vectors")
    name = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    c = np.array([r.q for r in rows.orderBy(name, "id", "q").limit(k).select("q").collect()], float).reshape(-1, dims)  # k rows
    k = len(c)
    keep = max(1, min(k - 1, -(-k // 4))) if k > 1 else 0
    schema = f"id {kind}, q array<int>, cluster int, upper double, near array<int>, low array<double>, rest double, used int"

    def packed(ids: pa.Array, q: pa.Array, s: dict[str, np.ndarray]) -> pa.RecordBatch:
        cols = [ids, q, pa.array(s["cluster"].astype(np.int32)), pa.array(s["upper"]), _lists(s["near"].astype(np.int32)), _lists(s["low"]), pa.array(s["rest"]), pa.array(s["used"].astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["id", "q", "cluster", "upper", "near", "low", "rest", "used"])

    def begin(batches: Iterator[pa.RecordBatch], c=c, keep=keep) -> Iterator[pa.RecordBatch]:
        release_memory()
        for b in batches:
            if len(b):
                yield packed(b.column(0), b.column(1), first_bounds(matrix(b.column(1), dims), c, keep))

    def follow(c: np.ndarray, moves: np.ndarray, keep: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                s = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "upper", "rest")}
                m = len(b.column("near")[0])
                s |= {n: b.column(n).flatten().to_numpy(zero_copy_only=False).reshape(len(b), m) for n in ("near", "low")}
                yield packed(b.column("id"), b.column("q"), moved_bounds(s, matrix(b.column("q"), dims), c, moves, keep))

        return run

    if not k:
        empty = spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        return empty
    state = stage(rows.mapInArrow(begin, schema), "centroid-state")
    for _ in range(rounds):
        sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("used").alias("used"), *(F.sum(F.col("q")[i].cast("long")).alias(f"s{i}") for i in range(dims))).collect()  # k rows
        new = c.copy()
        for r in sums:
            new[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
        moves = _up(_some_squares(new, c, np.arange(k)[:, None])[:, 0])
        keep = min(keep, max(-(-k // 8), max(r.used for r in sums)))
        before, c = state, new
        state = stage(before.mapInArrow(follow(c, moves, keep), schema), "centroid-state")
        if old := folder_of(before):
            drop_tree(spark, old)
    last = c

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column("cluster").to_numpy(zero_copy_only=False)
            d = _some_squares(matrix(b.column("q"), dims), last, a[:, None])[:, 0] if len(b) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cluster"), pa.array(d)], names=["id", "cluster", "distance"])

    found = stage(state.select("id", "q", "cluster").mapInArrow(measure, f"id {kind}, cluster int, distance long"), "centroid-found")
    spread = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in c]
    total = sum(spread.values())
    named = spark.createDataFrame([(i, spread.get(i, 0), total, digest[i]) for i in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
