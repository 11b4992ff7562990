"""Validated settings for every workflow.

Every class checks its arguments on construction, before any Spark job starts.
The default numbers are fixed values: results depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class ScoreWindow:
    """Full score up to ``green`` ppm, linear decay to zero at ``yellow`` ppm."""

    green: float = 0.5
    yellow: float = 2.0

    def __post_init__(self) -> None:
        _require(0 <= self.green < self.yellow, "green must be non-negative and below yellow")


@dataclass(frozen=True)
class FineRange:
    """A score window valid for library shifts in ``[low, high]``."""

    low: float
    high: float
    green: float
    yellow: float

    def __post_init__(self) -> None:
        _require(self.low < self.high, "range low must be below high")
        _require(0 <= self.green < self.yellow, "green must be non-negative and below yellow")


@dataclass(frozen=True)
class LibraryFilter:
    """Inclusive molecule ranges; an unset bound is not applied."""

    carbon_min: int = 5
    carbon_max: int = 30
    fw_min: float = 100.0
    fw_max: float = 500.0
    missing_fraction: float = 0.10

    def __post_init__(self) -> None:
        _require(0 < self.carbon_min <= self.carbon_max, "carbon range is empty")
        _require(0 < self.fw_min <= self.fw_max, "weight range is empty")

    def max_carbons(self, n_query: int) -> int:
        """Query size plus ten percent, rounded half up."""
        return n_query + math.floor(self.missing_fraction * n_query + 0.5)


@dataclass(frozen=True)
class CarbonSearch:
    """13C library search."""

    window: ScoreWindow | None = ScoreWindow()
    fine_ranges: tuple[FineRange, ...] = ()
    typed: bool = False
    merge_equivalent: bool = False
    env_level: int = 1
    self_weight: float = 0.7
    env_weight: float = 0.3
    top_n: int = 20

    def __post_init__(self) -> None:
        _require((self.window is None) != (not self.fine_ranges), "give a global window or at least one fine range")
        _require(self.env_level in (1, 2, 3), "environment level must be 1, 2 or 3")
        _require(self.top_n > 0, "top_n must be positive")
        check_weights(self.self_weight, self.env_weight)


@dataclass(frozen=True)
class HsqcSearch:
    """HSQC library search; mode 1 pools all points, 2 separates CH2, 3 separates every type."""

    mode: int = 1
    c_tol: float = 1.0
    h_tol: float = 0.2
    merge_equivalent: bool = False
    top_n: int = 20

    def __post_init__(self) -> None:
        _require(self.mode in (1, 2, 3), "mode must be 1, 2 or 3")
        _require(self.c_tol > 0 and self.h_tol > 0, "tolerances must be positive")


def check_weights(first: float, second: float) -> None:
    _require(0 <= first <= 1 and 0 <= second <= 1, "weights must lie in [0, 1]")
    _require(abs(first + second - 1.0) <= 1e-6, "weights must sum to 1")


@dataclass(frozen=True)
class Region:
    """Half-open ppm region with an alignment tolerance."""

    low: float
    high: float
    tol: float

    def __post_init__(self) -> None:
        _require(self.low < self.high and self.tol > 0, "region bounds or tolerance invalid")


# Default alignment regions (low, high, tolerance in ppm).
DEFAULT_REGIONS = (
    Region(0.0, 50.0, 0.20),
    Region(50.0, 110.0, 0.30),
    Region(110.0, 165.0, 0.20),
    Region(165.0, 220.0, 0.50),
)


@dataclass(frozen=True)
class AlignConfig:
    regions: tuple[Region, ...] = DEFAULT_REGIONS
    span_limit: float = 0.50
    residual_gate: float = 0.15
    max_per_sample: int = 3
    top_k_per_seed: int = 6
    min_samples: int = 2

    def __post_init__(self) -> None:
        _require(len(self.regions) > 0, "at least one region is needed")
        _require(self.span_limit > 0 and self.residual_gate > 0, "tolerances must be positive")
        _require(self.max_per_sample > 0 and self.top_k_per_seed > 0, "search limits must be positive")


@dataclass(frozen=True)
class PackConfig:
    """Set packing: exact up to ``exact_limit`` tracks, beam search above it."""

    model_cost: float = 1.10
    high_mask_bonus: float = 0.0
    singleton_weight: float = 0.02
    exact_limit: int = 12
    beam_width: int = 120
    node_limit: int = 100_000
    stratify_by_mask: bool = True
    # Optional replacement for the track weight: (score column, size column) -> Column.
    weight: Callable | None = None

    def __post_init__(self) -> None:
        _require(self.exact_limit >= 0 and self.beam_width > 0 and self.node_limit > 0, "search limits must be positive")


@dataclass(frozen=True)
class ClusterConfig:
    """Cluster model; the two maps are keyed by the number of samples."""

    model: str = "qg_pmtc"
    max_tracks: Mapping[int, int] = field(default_factory=lambda: {3: 32, 4: 28, 5: 26})
    size_fraction: Mapping[int, float] = field(default_factory=lambda: {3: 0.55, 4: 0.47, 5: 0.41})
    min_cluster_size: int = 3
    merge_threshold: float = 0.80
    hac_threshold: float = 1.00
    max_cluster_rise: int = 4
    residual_mode: str = "one_to_one"
    residual_tol: float = 0.50
    residual_min_remaining: int = 5
    residual_cover_ratio: float = 1.50
    pool_singles: bool = True

    MODELS = ("pmtc", "qg_pmtc", "mask_only")
    RESIDUAL_MODES = ("off", "full", "one_to_one", "residual")

    def __post_init__(self) -> None:
        _require(self.model in self.MODELS, f"model must be one of {self.MODELS}")
        _require(self.residual_mode in self.RESIDUAL_MODES, f"residual mode must be one of {self.RESIDUAL_MODES}")
        _require(self.min_cluster_size >= 1, "minimum cluster size must be at least 1")

    def track_limit(self, n_samples: int) -> int:
        return self.max_tracks.get(n_samples, 26)

    def fraction_limit(self, n_samples: int) -> float:
        return self.size_fraction.get(n_samples, 0.41)


@dataclass(frozen=True)
class ThresholdGraphConfig:
    """Cuts of the threshold graph and the costs of the score that chooses among them."""

    mask_weight: float = 0.38
    # Cuts at these shares of all distances of a series, beside the fixed ones.
    quantiles: tuple[float, ...] = (0.02, 0.05, 0.09, 0.14, 0.22, 0.32)
    cuts: tuple[float, ...] = (0.24, 0.36, 0.52, 0.80, 1.0)
    part_cost: float = 0.045
    tiny_cost: float = 0.45
    largest_cost: float = 1.20
    largest_share: float = 0.55
    least_size: int = 3
    alone_limit: int = 12

    def __post_init__(self) -> None:
        _require(len(self.cuts) > 0, "at least one fixed cut is needed")
        _require(all(0 <= q <= 1 for q in self.quantiles), "quantiles must lie between 0 and 1")


@dataclass(frozen=True)
class CalibrationConfig:
    mode: str = "height_stabilize"
    use_area: bool = True
    use_type: bool = False
    shrink: float = 1.235
    delta_clip: float | None = 0.63
    ppm_bin_width: float = 9.75
    width_bin_width: float = 0.35

    def __post_init__(self) -> None:
        _require(self.mode in ("area_match", "height_stabilize"), "unknown calibration mode")
        _require(math.isfinite(self.shrink) and self.shrink >= 0, "shrink must be finite and non-negative")
        _require(self.delta_clip is None or self.delta_clip > 0, "delta_clip must be positive or None")


@dataclass(frozen=True)
class MixtureConfig:
    min_components: int = 1
    max_components: int = 4
    use_log: bool = True
    max_iter: int = 100
    tol: float = 1e-3

    def __post_init__(self) -> None:
        _require(1 <= self.min_components <= self.max_components, "component range is empty")


@dataclass(frozen=True)
class HsqcTrackConfig:
    c_tol: float = 1.0
    h_tol: float = 0.1
    c_span_tol: float = 1.0
    h_span_tol: float = 0.1
    min_track_size: int = 2
    min_score: float = 0.40
    pair_weight: float = 1.20
    reciprocal_bonus: float = 0.18
    keep_singletons: bool = True

    def __post_init__(self) -> None:
        _require(min(self.c_tol, self.h_tol, self.c_span_tol, self.h_span_tol) > 0, "tolerances must be positive")


@dataclass(frozen=True)
class AssignConfig:
    """Structure assignment tolerances and status thresholds."""

    use_hsqc: bool = False
    c_tol: float = 1.5
    h_tol: float = 0.15
    c_yellow: float = 1.5
    c_red: float = 3.0
    h_yellow: float = 0.15
    h_red: float = 0.30
    ambiguity_window: float = 1.5
    ambiguity_mean_error: float = 1.0
    local_window: float = 5.0
    equivalence_tol: float = 0.03

    def __post_init__(self) -> None:
        _require(self.c_yellow <= self.c_red and self.h_yellow <= self.h_red, "yellow must not exceed red")
