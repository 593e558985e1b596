"""The whole search over a table, and its result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CIConfig, DiscoverConfig
from ..operators import precision
from ..operators.ci import fisher_z, run_test
from ..operators.residuals import residual
from ..sources.matrix import descriptor, moments, numeric_columns, to_numpy
from .orientation import Orientation, orient, orient_in_waves, unfaithful_triples
from .providers import Provider, gauss_provider, matrix_provider, regression_provider
from .skeleton import Skeleton, search


@dataclass
class Discovery:
    config: DiscoverConfig
    labels: tuple[str, ...]
    found: Skeleton
    orientation: Orientation | None
    info: DataFrame
    cache: dict[str, int] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        spark = self.info.sparkSession
        out = {**self.found.tables(spark), "info": self.info}
        return {**out, **(self.orientation.tables(spark) if self.orientation else {})}

    def skeleton(self) -> DataFrame:
        """Rows (x, y) by label."""
        return self.info.sparkSession.createDataFrame([(self.labels[x], self.labels[y]) for x, y in sorted(self.found.edges)], "x string, y string")

    def pdag(self) -> DataFrame:
        """Rows (a, b, mark) by label."""
        if self.orientation is None:
            raise ValueError("the search stopped at the skeleton")
        g = self.orientation.pdag
        return self.info.sparkSession.createDataFrame([(self.labels[i], self.labels[j], int(g[i, j])) for i, j in zip(*np.nonzero(g), strict=True)], "a string, b string, mark int")

    def summary(self) -> dict[str, object]:
        return {"variables": len(self.labels), "edges": len(self.found.edges), "levels": len(self.found.levels), "tests": sum(x[1] for x in self.found.levels), "oriented": self.orientation is not None, "regression_step": bool(self.orientation) and all(e[2] != "skipped" for e in self.orientation.events), "evaluated": sum(self.found.evaluated), "residual_cache": self.cache, "settings": asdict(self.config)}


def discover(df: DataFrame, columns: Sequence[str] | None = None, config: DiscoverConfig = DiscoverConfig(), *, order_by: Sequence[str] = (), provider: Provider | None = None, labels: Sequence[str] | None = None) -> Discovery:
    """Skeleton and orientation of numeric columns.

    With the test 'gauss' and linear residuals only a correlation matrix leaves the
    table, so any number of rows will do; other tests send the matrix to the
    executors, within ``sources.matrix.BROADCAST_BYTES``.
    """
    spark = df.sparkSession
    cols = list(columns or numeric_columns(df))
    if len(cols) < 2:
        raise ValueError("needs two variables at least")
    names = tuple(labels or cols)
    if len(names) != len(cols):
        raise ValueError("as many labels as variables are needed")
    cfg = config
    data = None
    backend = cfg.verifier if cfg.precision in ("compatible", "legacy") else cfg.residual
    if provider is None:
        if cfg.ci.method == "gauss" and cfg.residual == "linear":
            n, corr = moments(df.dropna(subset=cols), cols)
            provider = gauss_provider(n, corr)
        else:
            data = to_numpy(df, cols, order_by)
            # Where all that counts of a p-value is its side of alpha.
            decide = None if cfg.trace or cfg.precision == "hybrid" else cfg.alpha
            provider = matrix_provider(data, cfg.ci, backend, cfg.spline, alpha=decide)
            if cfg.precision == "hybrid":
                provider = precision.hybrid_provider(provider, matrix_provider(data, cfg.ci, cfg.verifier, cfg.spline), cfg.alpha, cfg.tau)
    # Tests on the matrix are dear, so they go in waves; moments are not worth it.
    waves = (128, 1024, 8192) if data is not None else ()
    found = search(spark, len(cols), provider, alpha=cfg.alpha, max_size=cfg.max_conditioning_size, na_delete=cfg.na_delete, gaps=cfg.fixed_gaps, fixed=cfg.fixed_edges, method=cfg.skeleton_method, waves=waves, trace=cfg.trace)
    oriented = None
    if cfg.graph_stage == "wanpdag":
        odd: frozenset = frozenset()
        if cfg.conservative or cfg.majority:
            odd = unfaithful_triples(spark, found, provider, cfg.alpha, cfg.majority, cfg.na_delete)
        # The regression step tests residuals against plain columns, with the residuals that the skeleton's tests use.
        ci = cfg.ci if cfg.ci.method != "hsic.clust" else replace(cfg.ci, method="hsic.gamma")
        settings = {"alpha": cfg.alpha, "ci": ci, "backend": backend, "spline": cfg.spline, "rules": cfg.rules, "orient_collider": cfg.orient_collider, "solve_confl": cfg.solve_confl, "unfaithful": odd}
        if data is None:
            oriented = orient(found, None, **settings)
        else:
            ask = regression_provider(data, ci, backend, cfg.spline, alpha=None if cfg.trace else cfg.alpha)
            oriented, _ = orient_in_waves(spark, found, ask, **settings)
            ask.close()
    cache = provider.stats() if hasattr(provider, "stats") else {}
    if data is not None:
        provider.close()
    return Discovery(cfg, names, found, oriented, descriptor(df, cols), cache)


def _test_of(data: np.ndarray, cfg: DiscoverConfig) -> Callable[[int, int, tuple[int, ...]], float]:
    def test(x: int, y: int, s: tuple[int, ...]) -> float:
        a, b = (residual(data[:, v], data[:, list(s)], cfg.residual, cfg.spline) if s else data[:, v] for v in (x, y))
        if cfg.ci.method == "gauss":
            return fisher_z(float(np.corrcoef(a, b)[0, 1]), len(a), len(s))
        return run_test(a, b, cfg.ci, data[:, list(s)] if s else None).p_value

    return test


#: Settings of a single test where none are given: permutations of distances, and tenths of the rows for ranks and clusters.
SINGLE = DiscoverConfig(ci=CIConfig("dcc.perm", index=1.0, replicates=100, sig=1.0, eps=0.1))


def kernel_ci_test(data: np.ndarray, x: int, y: int, s: Sequence[int] = (), config: DiscoverConfig = SINGLE) -> float:
    """p-value of one conditional-independence test."""
    return _test_of(np.asarray(data, float), config)(x, y, tuple(s))


def long_matrix(df: DataFrame, order_by: str, columns: Sequence[str]) -> DataFrame:
    """Rows (i, columns...) with a gapless row number by a key."""
    from pyspark.sql import Window

    return df.select((F.row_number().over(Window.orderBy(order_by)) - 1).alias("i"), *columns)
