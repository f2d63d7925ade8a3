"""Run parameters, one frozen dataclass.

The twelve positional arguments of a clustering run (source, eta, max
iterations, warm start, min k, max k, from, to, new-centre method,
silhouette threshold, samples per cluster, series length) plus the knobs
that make every random choice repeatable and select compatibility mode.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values of the clustering runs (defaults of the original runs).
DEFAULT_ETA = 1e-7
DEFAULT_MAX_ITER = 200
DEFAULT_MIN_K = 5
DEFAULT_MAX_K = 10
DEFAULT_SIL_THRESHOLD = 0.05
DEFAULT_N_SAMPLES = 100
DEFAULT_SERIES_LENGTH = 12
DEFAULT_WINDOW = 15
SOFT_DTW_GAMMA = 0.01
NEW_CENTRE_METHODS = ("random", "furthest", "furthest_in_cluster", "mean_of_previous_mean")


@dataclass(frozen=True)
class RunConfig:
    source: str = ""
    eta: float = DEFAULT_ETA
    max_iter: int = DEFAULT_MAX_ITER
    warm_start: bool = False
    min_k: int = DEFAULT_MIN_K
    max_k: int = DEFAULT_MAX_K
    from_tp: int = 0
    to_tp: int | None = None  # all that the series hold
    new_centre_method: str = "random"
    sil_threshold: float = DEFAULT_SIL_THRESHOLD
    n_samples: int = DEFAULT_N_SAMPLES
    series_length: int = DEFAULT_SERIES_LENGTH
    # extensions: distance, determinism, compatibility
    distance: str = "dtw"  # "dtw" | "soft_dtw"
    gamma: float = SOFT_DTW_GAMMA
    band: int | None = None
    seed: int = 42
    init: str = "random"  # "random" | "lowest_ids"
    compat: bool = False

    @property
    def run_kind(self) -> str:
        return "history" if self.warm_start else "random"

    def with_(self, **kw) -> "RunConfig":
        return replace(self, **kw)

    @staticmethod
    def from_args(args: list[str]) -> "RunConfig":
        """Parse the twelve positional arguments of a run."""
        return RunConfig(
            source=args[0],
            eta=float(args[1]),
            max_iter=int(args[2]),
            warm_start=args[3].strip().lower() == "true",
            min_k=int(args[4]),
            max_k=int(args[5]),
            from_tp=int(args[6]),
            to_tp=int(args[7]),
            new_centre_method=args[8],
            sil_threshold=float(args[9]),
            n_samples=int(args[10]),
            series_length=int(args[11]),
        )
