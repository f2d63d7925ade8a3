"""End-to-end runs: save every result table of a clustering run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarp.config import RunConfig
from tidewarp.operators import drift as J
from tidewarp.operators import kmeans as km
from tidewarp.operators import profile as A
from tidewarp.operators import quality as Q
from tidewarp.sources import sinks as W

TABLES = ("customer_clustered", "clustered_result", "cluster_balances", "cluster_statistic", "cluster_monitor",
          "cluster_distance", "cluster_samples", "cluster_member_count")


def save_result(spark: SparkSession, base: str, assigned: DataFrame, centres: dict, cfg: RunConfig,
                seconds: dict | None = None, key_cols=("time_point", "k"), with_monitor: bool = True) -> dict:
    """Write the result tables of one run under ``base/<table>``.

    ``assigned`` is the final assignment (with dists); ``centres`` the
    driver-side centre table of the chosen models; ``seconds`` the task
    seconds of each (``KMeansFit.seconds``). Every table is written
    with dynamic partition overwrite, so a re-run replaces its partitions.
    """
    key_cols = list(key_cols)
    run = dict(run_kind=cfg.run_kind, new_mean_method=cfg.new_centre_method, balance_length=cfg.series_length)
    length = cfg.series_length
    full = assigned.agg(F.max(F.size("series_full"))).first()[0] or length
    cs = Q.cluster_silhouettes(assigned, key_cols, cfg.compat)
    centres_df = km.centres_frame(spark, centres, key_cols)
    spent = spark.createDataFrame([(*map(int, k), float((seconds or {}).get(k, 0.0))) for k in centres],
                                  ", ".join(f"{c} int" for c in key_cols) + ", spent_time double")
    samples = Q.project_by_group(A.nearest_samples(assigned, key_cols, cfg.n_samples), Q.pca_by_group(assigned, "time_point", 3),
                                 "time_point", length, 3)
    models = centres_df.select(*key_cols).distinct()  # one row a model
    tables = {
        "customer_clustered": W.customer_clustered(assigned, key_cols),
        "clustered_result": A.result_per_centre(centres_df, cs, key_cols).join(F.broadcast(spent), key_cols),
        "cluster_balances": A.cluster_total_vector(assigned, key_cols, full),
        "cluster_statistic": A.cluster_statistic(assigned, key_cols, length),
        "cluster_distance": Q.mean_distance(assigned, key_cols),
        "cluster_samples": samples.select(*key_cols, "cluster_id", "dist", F.col("series_norm").alias("member"),
                                          F.slice("pca", 1, 2).alias("p2"), F.col("pca").alias("p3")),
        "cluster_member_count": A.cluster_size(assigned, key_cols),
    }
    if with_monitor:
        # consecutive periods are compared whatever the number of clusters of each; k comes along as an attribute
        tables["cluster_monitor"] = J.migration(assigned.select("time_point", "id", "cluster_id"), ["time_point"]).join(
            F.broadcast(models), "time_point").select(*key_cols, "cluster_previous", "cluster_current", "number_cus", "change_proportion")
    paths = {}
    for name, df in tables.items():
        path = f"{base.rstrip('/')}/{name}"
        W.write_entity(W.with_run_columns(df, **run), path)
        paths[name] = path
    members = A.member_lists(assigned, key_cols)
    W.write_member_text(W.with_run_columns(members, **run), f"{base.rstrip('/')}/cluster_members_text")
    paths["cluster_members_text"] = f"{base.rstrip('/')}/cluster_members_text"
    return paths
