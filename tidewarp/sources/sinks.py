"""Sinks (W1-W14).

Entity tables are Parquet, partitioned by
``run_kind / new_mean_method / balance_length / time_point`` and written
with dynamic partition overwrite: a retried task or a re-run replaces its
own partitions instead of duplicating rows (Q16), and failures propagate.
Text writers keep the original line shapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.functions.vec import pair_encode, series_to_text

PARTITION_COLS = ["run_kind", "new_mean_method", "balance_length", "time_point"]


def with_run_columns(df: DataFrame, run_kind: str, new_mean_method: str, balance_length: int) -> DataFrame:
    return (df.withColumn("run_kind", F.lit(run_kind)).withColumn("new_mean_method", F.lit(new_mean_method))
            .withColumn("balance_length", F.lit(int(balance_length))))


def write_entity(df: DataFrame, path: str) -> None:
    """Idempotent partitioned write of one entity table.

    ``rebalance`` on the partition columns clusters each time point into few
    files while adaptive execution splits a skewed time point into
    advisory-sized tasks (no tasks x time points small files, no whole time
    point in one task).
    """
    (df.hint("rebalance", *PARTITION_COLS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITION_COLS).parquet(path))


def customer_clustered(assigned: DataFrame, key_cols=("time_point", "k")) -> DataFrame:
    """Id, cluster and the per-month (norm, raw) pairs."""
    return assigned.select(*key_cols, "id", "cluster_id",
                           pair_encode("series_norm", "series_raw").alias("pairs"))


def write_text_lines(df: DataFrame, text_col: str, path: str, partition_col: str | None = None) -> None:
    out = df.select(*([partition_col] if partition_col else []), F.col(text_col).alias("value"))
    if partition_col:
        out = out.hint("rebalance", partition_col)
    w = out.write.mode("overwrite")
    if partition_col:
        # replace only the folders this write produces (W10 and W11 share a base)
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(partition_col)
    w.text(path)


def write_member_text(members: DataFrame, path: str) -> None:
    """``(cluster,id;id;...)`` lines, one per id block, in a folder per run kind, method, length and time point."""
    line = F.format_string("(%d,%s)", F.col("cluster_id"), F.col("members"))
    (members.select(*PARTITION_COLS, line.alias("value")).hint("rebalance", *PARTITION_COLS).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION_COLS).text(path))


def write_clustering_result_text(assigned: DataFrame, run_sil: DataFrame, path: str) -> None:
    """``cluster,id,v...`` under one folder per run,
    ``run_dir={time point}_{k}_{round(1000 * silhouette)}`` (what S6 reads)."""
    sil = run_sil.select("time_point", "k", F.floor(F.col("run_silhouette") * 1000 + 0.5).cast("bigint").alias("_s"))
    lines = (assigned.join(F.broadcast(sil), ["time_point", "k"])
             .withColumn("run_dir", F.concat_ws("_", F.col("time_point").cast("string"), F.col("k").cast("string"),
                                                F.col("_s").cast("string")))
             .withColumn("_line", F.concat_ws(",", F.col("cluster_id").cast("string"),
                                              series_to_text("id", "series_norm"))))
    write_text_lines(lines, "_line", path, "run_dir")


def write_pca_text(pca: DataFrame, path: str) -> None:
    """``id,pc1,pc2`` under ``run_dir={time point}_pca``."""
    lines = pca.withColumn("run_dir", F.concat(F.col("time_point").cast("string"), F.lit("_pca"))).withColumn(
        "_line", F.concat_ws(",", F.col("id").cast("string"), F.col("pca")[0].cast("string"),
                             F.col("pca")[1].cast("string")))
    write_text_lines(lines, "_line", path, "run_dir")


def write_window_files(series: DataFrame, path: str) -> None:
    """One ``id,v0..v14`` text file set per time point
    (``time_point=i`` folders; S4 prunes them by range)."""
    write_text_lines(series.withColumn("_line", series_to_text("id", "series_full")), "_line", path, "time_point")


def write_samples(series: DataFrame, path: str, series_col: str = "series_norm") -> None:
    """``id,v0..v11`` lines of a sample (X6 output)."""
    write_text_lines(series.withColumn("_line", series_to_text("id", series_col)), "_line", path)
