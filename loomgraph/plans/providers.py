"""Sources of p-values for the skeleton search: tasks in, (task_id, p) out, and from tests of the matrix their whole records."""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CIConfig, SplineConfig
from ..operators.ci import TestResult, fisher_z, paired, paired_bounded, prepare, prepare_bounded, run_test, settled
from ..operators.precision import RECORD
from ..operators.residuals import residuals

Provider = Callable[[DataFrame], DataFrame]


#: Bytes of residuals and of test parts that a task keeps.
KEPT_BYTES = 256 << 20


def _alone(ci: CIConfig, backend: str) -> bool:
    """Whether tests are dealt out one by one, in more tasks than run at a time: those of replicates, where residuals cost little beside them."""
    return ci.method == "dcc.perm" and backend == "linear"


class _Kept:
    """A cache of arrays, least recently used first to go; counts requests and makes."""

    def __init__(self, make: Callable, size: Callable[[object], int]) -> None:
        self.make, self.size, self.held, self.bytes, self.asked, self.made = make, size, OrderedDict(), 0, 0, 0

    def get(self, *key):
        self.asked += 1
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        self.made += 1
        value = self.held[key] = self.make(*key)
        self.bytes += self.size(value)
        while self.bytes > KEPT_BYTES and len(self.held) > 1:
            self.bytes -= self.size(self.held.popitem(last=False)[1])
        return value


#: What a worker keeps between tasks, by provider.
_WORKER: dict[str, tuple[_Kept, _Kept, _Kept]] = {}


def _all_residuals(x: np.ndarray, s: tuple[int, ...], backend: str, spline: SplineConfig) -> np.ndarray:
    """Residuals of all columns given some, whose own places stay empty."""
    out = np.full(x.shape, np.nan, order="F")
    others = [j for j in range(x.shape[1]) if j not in s]
    out[:, others] = residuals(x[:, others], x[:, list(s)], backend, spline)
    return out


def matrix_provider(data: np.ndarray, ci: CIConfig, backend: str = "linear", spline: SplineConfig = SplineConfig(), partitions: int | None = None, alpha: float | None = None) -> Provider:
    """Tests on the matrix, which every executor gets once (its size is checked where it is read).

    Tasks are dealt out by conditioning set, and by x where there are fewer sets than tasks to
    run at a time; tests of many replicates each alone.  A worker fits a set's residuals once (all
    columns' together) and makes a residual's part of the test (its distances or kernel) once,
    as far as ``KEPT_BYTES`` hold them.  ``provide.stats()`` tells residuals asked for and fitted, so
    far, and ``provide.close()`` frees the matrix.

    With ``alpha``, p-values count for the side of it that they lie on: tests of ``dcc.lowrank`` on many rows
    then take eigenpairs only where bounds leave that open, and else tell the p-value of the matrix that is not cut.
    """
    x = np.asarray(data, float)
    p = x.shape[1]
    uid = uuid.uuid4().hex
    state: dict = {}

    def provide(tasks: DataFrame) -> DataFrame:
        spark = tasks.sparkSession
        if not state:
            sc = spark.sparkContext
            state.update(held=sc.broadcast(x), asked=sc.accumulator(0), made=sc.accumulator(0))
        held, asked, made = state["held"], state["asked"], state["made"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = held.value
            if uid not in _WORKER:
                _WORKER.clear()  # one provider's at a time
                _WORKER[uid] = (_Kept(lambda s: _all_residuals(x, s, backend, spline), lambda r: r.nbytes), _Kept(lambda t, s: prepare(of(t, s), ci), lambda part: part.matrix.nbytes), _Kept(lambda t, s: prepare_bounded(of(t, s), ci), lambda part: part.matrix.nbytes if part else 0))
            sets, parts, bounded = _WORKER[uid]

            def of(target: int, s: tuple[int, ...]) -> np.ndarray:
                if not s:
                    return x[:, target]
                return sets.get(s)[:, target]

            def one(a: int, b: int, key: tuple[int, ...], cfg: CIConfig) -> TestResult:
                if ci.method == "hsic.clust" and key:
                    return run_test(x[:, a], x[:, b], cfg, x[:, list(key)])
                if ci.method == "gauss":
                    r = float(np.corrcoef(of(a, key), of(b, key))[0, 1])
                    return TestResult("gauss", fisher_z(r, len(x), len(key)), r)
                if alpha is not None and bounded.get(a, key) and bounded.get(b, key):
                    found = paired_bounded(bounded.get(a, key), bounded.get(b, key))
                    if settled(found, alpha):
                        return found
                return paired(parts.get(a, key), parts.get(b, key), cfg)

            seen = (sets.asked, sets.made)
            for batch in batches:
                tests: list[TestResult] = []
                for t, a, b, s in zip(*(batch.column(c).to_pylist() for c in ("task_id", "x", "y", "s")), strict=True):
                    try:
                        tests.append(one(a, b, tuple(sorted(s)), replace(ci, seed=(ci.seed + 1000003 * t) % 2147483647)))
                    except (ValueError, ArithmeticError, np.linalg.LinAlgError, RuntimeError) as e:
                        if ci.on_error == "raise":
                            raise
                        tests.append(TestResult(ci.method, math.nan, reason=str(e)))
                told = [[r.p_value for r in tests], [r.method for r in tests], *([getattr(r, c) for r in tests] for c in ("statistic", "mean", "variance")), [len(r.replicates) for r in tests]]
                yield pa.RecordBatch.from_arrays([batch.column("task_id"), *map(pa.array, told, (pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int32()))], names=["task_id", "p", *RECORD])
            asked.add(sets.asked - seen[0])
            made.add(sets.made - seen[1])

        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Pieces of a set, by its size: there are at most C(p, size) sets.
        pieces = F.element_at(F.array(*(F.lit(max(1, -(-4 * n // math.comb(p, k)))) for k in range(p + 1))), F.size("s") + 1)
        # Tests of hsic.clust share nothing that is dear, so each is dealt out alone.
        by = F.xxhash64("x", "y") if ci.method == "hsic.clust" else F.xxhash64(F.least("x", "y"))
        tasks = tasks.select("task_id", "x", "y", "s")
        dealt = tasks.repartition(4 * n, "task_id") if _alone(ci, backend) else tasks.repartition(n, F.array_join("s", "|"), F.pmod(by, pieces))
        return dealt.mapInArrow(run, "task_id long, p double, " + ", ".join(f"{c} {t}" for c, t in RECORD.items()))

    provide.stats = lambda: {"requests": state["asked"].value, "fits": state["made"].value} if state else {"requests": 0, "fits": 0}
    provide.close = lambda: state.pop("held").destroy() if "held" in state else None
    return provide


def regression_provider(data: np.ndarray, ci: CIConfig, backend: str = "linear", spline: SplineConfig = SplineConfig(), partitions: int | None = None, alpha: float | None = None) -> Provider:
    """Tests of a column's residual given a set against another column as it is: rows (task_id, target, s, other) in, (task_id, p) out.

    Tasks are dealt out by set, or alone where replicates make them dear; a task fits a set once for all its targets.  ``provide.close()`` frees the matrix.
    ``alpha``: see ``matrix_provider``.
    """
    x = np.asarray(data, float)
    state: dict = {}

    def provide(tasks: DataFrame) -> DataFrame:
        spark = tasks.sparkSession
        if not state:
            state["held"] = spark.sparkContext.broadcast(x)
        held = state["held"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = held.value
            sets = _Kept(lambda s: _all_residuals(x, s, backend, spline), lambda r: r.nbytes)
            for batch in batches:
                ps = []
                for v, s, m in zip(*(batch.column(c).to_pylist() for c in ("target", "s", "other")), strict=True):
                    r = sets.get(tuple(s))[:, v] if s else x[:, v]
                    a, b = (prepare_bounded(v, ci) if alpha is not None else None for v in (r, x[:, m]))
                    found = paired_bounded(a, b) if a and b else None
                    ps.append((found if found and settled(found, alpha) else run_test(r, x[:, m], ci)).p_value)
                yield pa.RecordBatch.from_arrays([batch.column("task_id"), pa.array(ps, pa.float64())], names=["task_id", "p"])

        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = tasks.repartition(4 * n, "task_id") if _alone(ci, backend) else tasks.repartition(n, F.array_join("s", "|"))
        return dealt.mapInArrow(run, "task_id long, p double")

    provide.close = lambda: state.pop("held").destroy() if "held" in state else None
    return provide


def gauss_provider(n: int, corr: np.ndarray) -> Provider:
    """Partial-correlation tests from a correlation matrix: for any number of rows, as only p x p numbers are kept."""
    corr = np.asarray(corr, float)

    def provide(tasks: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
                given = batch.column("s")
                size = np.diff(given.offsets.to_numpy())
                ps = np.full(len(batch), np.nan)
                for k in np.unique(size):  # sets of one size at a time
                    rows = np.flatnonzero(size == k)
                    s = given.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), k)
                    at = np.column_stack((x[rows], y[rows], s)).astype(int)
                    inv = np.linalg.pinv(corr[at[:, :, None], at[:, None, :]], hermitian=True)
                    d = inv[:, 0, 0] * inv[:, 1, 1]
                    fine = d > 0
                    r = -inv[fine, 0, 1] / np.sqrt(d[fine])
                    ps[rows[fine]] = [fisher_z(float(v), n, int(k)) for v in r]
                yield pa.RecordBatch.from_arrays([batch.column("task_id"), pa.array(ps, pa.float64())], names=["task_id", "p"])

        return tasks.select("task_id", "x", "y", "s").mapInArrow(run, "task_id long, p double")

    return provide


def table_provider(p_table: DataFrame) -> Provider:
    """Given p-values: rows (x, y, s_key, p); a test of (y, x) finds the entry of (x, y), and a missing one is null."""
    known = p_table.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "s_key", "p")

    def provide(tasks: DataFrame) -> DataFrame:
        asked = tasks.select("task_id", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), F.array_join("s", "|").alias("s_key"))
        return asked.join(known, ["lo", "hi", "s_key"], "left").select("task_id", "p")

    return provide


def formula_provider(formula: Callable) -> Provider:
    """p as a column expression of x, y and s."""
    return lambda tasks: tasks.select("task_id", formula(F.col("x"), F.col("y"), F.col("s")).alias("p"))


def callback_provider(test: Callable[[int, int, Sequence[int]], float], partitions: int = 8) -> Provider:
    """A user's function of (x, y, s)."""

    def provide(tasks: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ps = [float(test(a, b, s)) for a, b, s in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "s")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("task_id"), pa.array(ps, pa.float64())], names=["task_id", "p"])

        return tasks.select("task_id", "x", "y", "s").repartition(partitions, "task_id").mapInArrow(run, "task_id long, p double")

    return provide
