"""All distances to the centres (D4), nearest centre (C1/J3) and the
per-row silhouette parts (E1/E2).

Centres are a driver dict ``{model key tuple: ndarray (k, L)}``. Their size
is k x L doubles per model, fixed by the run parameters and never by the
data; the table travels as a Spark broadcast, one copy an executor, and every row gets one
``dists ARRAY<DOUBLE>`` column: at most k doubles per row, no row blow-up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarp.config import RunConfig
from tidewarp.functions.arrowbatch import length_groups, ragged_rows, stack_centres
from tidewarp.functions.dtw import dtw_to_row_centres

Centres = dict  # {tuple: np.ndarray (k, L)}


def model_key(key_cols: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])


def key_str(key: tuple) -> str:
    return "|".join(str(k) for k in key)


def _dists_map(centres, cfg: RunConfig, kmax_all: int):
    """mapInArrow body: append ``dists`` to every row (NULL when the row's
    model has no centres). ``centres``: a broadcast of {model string: (k, L)}."""
    gamma = cfg.gamma if cfg.distance == "soft_dtw" else None
    band = cfg.band
    mode = "prefix" if cfg.compat and cfg.distance == "dtw" else "full"

    def run(batches):
        table = centres.value
        for rb in batches:
            n_rows = rb.num_rows
            Dfull = np.full((n_rows, kmax_all), np.inf)
            kk = np.zeros(n_rows, dtype=np.int64)
            if n_rows:
                for n, rows, X, codes, names in length_groups(rb.column("_mk"), rb.column("_sx")):
                    stack, kval = stack_centres(table, names)
                    if stack is None:
                        continue
                    kr = kval[codes]
                    use = np.flatnonzero(kr > 0)
                    if len(use) == 0:
                        continue
                    D = dtw_to_row_centres(X[use], stack, codes[use], gamma=gamma, band=band, mode=mode)
                    Dfull[rows[use], :D.shape[1]] = D
                    kk[rows[use]] = kr[use]
            cols = [rb.column(i) for i in range(rb.num_columns) if rb.schema.names[i] not in ("_mk", "_sx")]
            names_out = [nm for nm in rb.schema.names if nm not in ("_mk", "_sx")]
            yield pa.RecordBatch.from_arrays(cols + [ragged_rows(Dfull, kk, kk == 0)], names=names_out + ["dists"])

    return run


def with_dists(series: DataFrame, centres: Centres, key_cols: list[str], cfg: RunConfig,
               series_col: str = "series_norm") -> DataFrame:
    """Add ``dists`` (distance to each centre of the row's model)."""
    s = series.withColumn("_mk", model_key(key_cols)).withColumn("_sx", F.col(series_col))
    out_schema = T.StructType([f for f in s.schema.fields if f.name not in ("_mk", "_sx")] + [T.StructField("dists", T.ArrayType(T.DoubleType()))])
    sent = series.sparkSession.sparkContext.broadcast({key_str(k): np.asarray(v, dtype=np.float64) for k, v in centres.items()})
    kmax = max((np.asarray(v).shape[0] for v in centres.values()), default=0)
    return s.mapInArrow(_dists_map(sent, cfg, kmax), out_schema)


def nearest(dists: Column | str = "dists") -> Column:
    """Index of the smallest distance, lowest index on ties."""
    d = F.col(dists) if isinstance(dists, str) else dists
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def assign(series: DataFrame, centres: Centres, key_cols: list[str], cfg: RunConfig,
           series_col: str = "series_norm") -> DataFrame:
    """Dists, cluster_id and the own-centre distance ``dist``. Under soft-DTW the cluster is the nearest by
    that; ``dists`` and ``dist``, which quality is measured with, are always DTW."""
    a = with_dists(series, centres, key_cols, cfg, series_col)
    a = a.withColumn("cluster_id", nearest("dists"))
    if cfg.distance == "soft_dtw":
        a = with_dists(a.drop("dists"), centres, key_cols, cfg.with_(distance="dtw", compat=False), series_col)
    return a.withColumn("dist", F.element_at("dists", F.col("cluster_id") + 1))


def other_min(dists: str = "dists", cluster: str = "cluster_id") -> Column:
    """Distance to the nearest other centre (NULL with one centre)."""
    return F.array_min(F.filter(F.col(dists), lambda d, i: i != F.col(cluster)))


def silhouette_value(dists: str = "dists", cluster: str = "cluster_id", compat: bool = False) -> Column:
    """E1 per row: (b - a) / max(a, b); 0 when both are 0 (NaN in compat)."""
    a = F.element_at(F.col(dists), F.col(cluster) + 1)
    b = other_min(dists, cluster)
    s = F.try_divide(b - a, F.greatest(a, b))
    if compat:
        return F.when(b.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(s, F.lit(float("nan"))))
    return F.when(b.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(s, F.lit(0.0)))
