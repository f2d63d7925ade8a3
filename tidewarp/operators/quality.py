"""Quality measures (E1-E5) and PCA.

Everything derives from the one ``dists`` column of a final assignment:
no distance is recomputed for silhouettes or mean distances.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.operators.assign import other_min, silhouette_value


def row_silhouettes(assigned: DataFrame, compat: bool = False) -> DataFrame:
    """E1/E2 per row: own distance a, nearest other b, silhouette s."""
    return (assigned.withColumn("nearest_other", other_min())
            .withColumn("silhouette", silhouette_value(compat=compat)))


def cluster_silhouettes(assigned: DataFrame, key_cols: list[str], compat: bool = False) -> DataFrame:
    """Mean row silhouette per non-empty cluster."""
    return (row_silhouettes(assigned, compat).groupBy(*key_cols, "cluster_id")
            .agg(F.avg("silhouette").alias("silhouette")))


def run_silhouette(cluster_sil: DataFrame, key_cols: list[str], k_col: str = "k") -> DataFrame:
    """Sum of cluster silhouettes / k (empty clusters count 0, Q10)."""
    return (cluster_sil.groupBy(*key_cols)
            .agg(F.try_divide(F.sum("silhouette"), F.first(F.col(k_col)).cast("double")).alias("run_silhouette"))
            if k_col in key_cols else
            cluster_sil.groupBy(*key_cols).agg(F.sum("silhouette").alias("sil_sum")))


def mean_distance(assigned: DataFrame, key_cols: list[str]) -> DataFrame:
    """Mean distance to the own centre per cluster."""
    return assigned.groupBy(*key_cols, "cluster_id").agg(F.avg("dist").alias("mean_distance"))


# --------------------------------------------------------------------------
# PCA
# --------------------------------------------------------------------------

def _fix_signs(pc: np.ndarray) -> np.ndarray:
    """Make the largest-magnitude loading of every component positive."""
    pc = pc.copy()
    for j in range(pc.shape[1]):
        i = int(np.argmax(np.abs(pc[:, j])))
        if pc[i, j] < 0:
            pc[:, j] = -pc[:, j]
    return pc


def pca_fit(df: DataFrame, k: int = 3, series_col: str = "series_norm"):
    """Fit once with k components (the first two are the k=2 fit).

    The covariance is a distributed tree aggregate (L x L); the
    decomposition of that small matrix runs on the driver.
    Returns (components L x k with fixed signs, explained variance).
    """
    vec = df.select(array_to_vector(F.col(series_col)).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(vec)
    pc = _fix_signs(model.pc.toArray())
    return pc, np.asarray(model.explainedVariance.toArray())


def project_by_group(df: DataFrame, fits: dict, group_col: str, length: int, k: int, series_col: str = "series_norm") -> DataFrame:
    """Adds ``pca``, x . the ``k`` components of the row's group (no centring, as the library transform does).
    ``fits``: what ``pca_by_group`` returns, one row a group (broadcast)."""
    tbl = df.sparkSession.createDataFrame([(int(g), pc[:, :k].T.flatten().tolist()) for g, (pc, _) in fits.items()],
                                          f"{group_col} int, _w array<double>")
    dots = [F.aggregate(F.zip_with(F.col(series_col), F.slice("_w", c * length + 1, length), lambda a, b: a * b),
                        F.lit(0.0), lambda a, b: a + b) for c in range(k)]
    return df.join(F.broadcast(tbl), group_col).withColumn("pca", F.array(*dots)).drop("_w")


def pca_by_group(df: DataFrame, group_col: str, k: int, series_col: str = "series_norm",
                 length: int | None = None) -> dict:
    """P2 for many populations at once (e.g. one per time point).

    One aggregation job returns, per group, the count, the L sums and the
    L(L+1)/2 cross-product sums (the Gramian route of the library PCA);
    the covariance and its eigen-decomposition (L x L) are formed on the
    driver. Output size is groups x L^2, bounded by the run parameters.
    """
    if length is None:
        length = df.select(F.max(F.size(series_col))).first()[0]
    x = F.col(series_col)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(x[i]).alias(f"s{i}") for i in range(length)]
    aggs += [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(length) for j in range(i, length)]
    out = {}
    for r in df.groupBy(group_col).agg(*aggs).collect():
        n = r["n"]
        s = np.array([r[f"s{i}"] for i in range(length)])
        g = np.zeros((length, length))
        for i in range(length):
            for j in range(i, length):
                g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        cov = (g - np.outer(s, s) / n) / max(n - 1, 1)
        vals, vecs = np.linalg.eigh(cov)
        order = np.argsort(vals)[::-1]
        vals, vecs = np.clip(vals[order], 0, None), vecs[:, order]
        total = vals.sum()
        ev = vals[:k] / total if total > 0 else np.zeros(k)
        out[r[group_col]] = (_fix_signs(vecs[:, :k]), ev)
    return out


def to_array(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, vector_to_array(F.col(col)))
