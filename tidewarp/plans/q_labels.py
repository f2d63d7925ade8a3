"""Registered queries on FX-4: embeddings with a given clustering (label).

The label is taken as the cluster: centres are the label column means (A3),
every vector gets its DTW distances to all label centres (D4), then sizes,
mean own distance (E4) and the silhouette of the given labelling (E1).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewarp.config import RunConfig
from tidewarp.operators import profile as A
from tidewarp.operators.assign import with_dists
from tidewarp.operators.quality import row_silhouettes
from tidewarp.plans import oracle as O
from tidewarp.plans.catalog import r6, register
from tidewarp.sources.tables import FX4_DIM, fx4_vectors

def label_centres(vectors, dim: int) -> dict:
    """Label means as the centre table of one model (labels x dim doubles, like any model's k x L)."""
    means = A.cluster_mean_vector(vectors.withColumnRenamed("label", "cluster_id").withColumn("m", F.lit(0)),
                                  ["m"], dim, "series").collect()
    k = max(r["cluster_id"] for r in means) + 1
    mat = np.full((k, dim), np.inf)
    for r in means:
        mat[r["cluster_id"]] = r["center"]
    return {(0,): mat}


def _sql_fx4():
    q = O.Sql()
    v = q.add("v", "SELECT CAST(vec_id AS BIGINT) AS id, CAST(label AS INTEGER) AS cluster_id, "
                   "CAST(embedding AS DOUBLE[]) AS series_norm FROM embeddings")
    c = q.add("c", f"""SELECT cluster_id, [{", ".join(f"avg(series_norm[{i + 1}])" for i in range(FX4_DIM))}] AS center
FROM {v} GROUP BY cluster_id""")
    d = q.add("d", f"""SELECT v.id, v.cluster_id AS label, c.cluster_id AS c, {O.dtw('v.series_norm', 'c.center')} AS d
FROM {v} v, {c} c""")
    r = q.add("r", """SELECT id, any_value(label) AS label, list(d ORDER BY c) AS dists FROM d GROUP BY id""")
    s = q.add("s", f"SELECT label, dists[label + 1] AS dist, {O.silhouette_row('dists', 'label')} AS sil FROM {r}")
    return q.render(f"""SELECT label, CAST(count(*) AS BIGINT) AS size, round(avg(dist), 6) AS mean_distance,
  round(avg(sil), 6) AS silhouette FROM {s} GROUP BY label""")


@register("fx4_given_label_profile", _sql_fx4())
def fx4(spark, sf_dir):
    v = fx4_vectors(spark, sf_dir)
    centres = label_centres(v, FX4_DIM)
    d = with_dists(v.withColumn("m", F.lit(0)), centres, ["m"], RunConfig(series_length=FX4_DIM), "series")
    d = d.withColumnRenamed("label", "cluster_id")
    d = d.withColumn("dist", F.element_at("dists", F.col("cluster_id") + 1))
    s = row_silhouettes(d)
    return (s.groupBy(F.col("cluster_id").alias("label"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("size"), r6(F.avg("dist")).alias("mean_distance"),
                 r6(F.avg("silhouette")).alias("silhouette")))
