"""Settings of tests, residuals and searches."""

from __future__ import annotations

from dataclasses import dataclass, field

CI_METHODS = ("dcc.gamma", "dcc.perm", "hsic.gamma", "hsic.perm", "hsic.clust", "dcc.lowrank", "gauss")
RESIDUALS = ("linear", "fast_spline", "tprs_gcv")


@dataclass(frozen=True)
class SplineConfig:
    """Penalised spline regression: basis size, smoothing grid and ridge."""

    knots: int = 10
    lambda_min: float = 1e-4
    lambda_max: float = 1e4
    lambda_count: int = 25
    ridge: float = 1e-8


@dataclass(frozen=True)
class CIConfig:
    """One conditional-independence test.  ``num_col`` and ``num_cluster`` of None mean a tenth of the rows.

    A test that fails raises, or with ``on_error`` 'na' has no p-value (and ``na_delete`` decides).
    """

    method: str = "dcc.gamma"
    index: float = 1.0
    legacy_index: bool = True
    sig: float = 1.0
    replicates: int = 100
    include_observed: bool = True
    seed: int = 1
    num_col: int | None = None
    num_cluster: int | None = None
    eps: float = 0.1
    on_error: str = "raise"

    def __post_init__(self) -> None:
        if self.method not in CI_METHODS:
            raise ValueError(f"unknown test {self.method!r}; known: {', '.join(CI_METHODS)}")
        if self.sig <= 0:
            raise ValueError("sig must be positive")
        if self.on_error not in ("raise", "na"):
            raise ValueError("on_error is 'raise' or 'na'")
        if self.replicates < 0:
            raise ValueError("replicates must not be negative")


@dataclass(frozen=True)
class DiscoverConfig:
    """A whole search: skeleton, then orientation unless ``graph_stage`` is 'skeleton'."""

    alpha: float = 0.2
    max_conditioning_size: float = 2
    ci: CIConfig = field(default_factory=CIConfig)
    residual: str = "linear"
    spline: SplineConfig = field(default_factory=SplineConfig)
    na_delete: bool = True
    skeleton_method: str = "stable"
    fixed_gaps: tuple[tuple[int, int], ...] = ()
    fixed_edges: tuple[tuple[int, int], ...] = ()
    graph_stage: str = "wanpdag"
    orient_collider: bool = True
    solve_confl: bool = False
    rules: tuple[bool, bool, bool] = (True, True, True)
    conservative: bool = False
    majority: bool = False
    precision: str = "fast"
    verifier: str = "tprs_gcv"
    tau: float = 0.6931471805599453
    trace: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must lie in [0, 1]")
        if self.residual not in RESIDUALS or self.verifier not in RESIDUALS:
            raise ValueError(f"unknown residuals; known: {', '.join(RESIDUALS)}")
        if self.conservative and self.majority:
            raise ValueError("conservative and majority exclude each other")
        if self.graph_stage not in ("skeleton", "wanpdag") or self.skeleton_method not in ("stable", "stable.fast", "original"):
            raise ValueError("unknown graph stage or skeleton method")
        if self.precision not in ("fast", "compatible", "hybrid", "legacy"):
            raise ValueError("unknown precision")


def resolve_max_size(m: float, p: int) -> int:
    """The largest conditioning set that a search over ``p`` variables tries."""
    if m != m or m < 0:
        raise ValueError("the largest conditioning size must be a number from 0")
    return max(0, p - 2 if m == float("inf") else min(int(m), p - 2))
