"""Prepared inputs of the clustering runs: fixture -> dense -> windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewarp.operators.reshape import dense_series, sliding_windows
from tidewarp.sources.tables import panel, positions


def fixture_series(spark: SparkSession, sf_dir: str, fixture: str = "fx1", tp_from: int | None = None,
                   tp_to: int | None = None, length: int = 12) -> DataFrame:
    """``(time_point INT, id BIGINT, series_full, series_raw, series_norm)`` for a fixture."""
    p, spec = panel(spark, sf_dir, fixture)
    n_pos = positions(spark, sf_dir, fixture)
    d = dense_series(p, n_pos)
    lo = 0 if tp_from is None else tp_from
    hi = n_pos - spec.window if tp_to is None else tp_to
    return sliding_windows(d, spec.window, lo, hi, length)
