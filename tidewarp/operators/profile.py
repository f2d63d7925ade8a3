"""Cluster profiles: aggregations (A1-A10) and ranked members (K1-K4).

All cluster-level aggregates are algebraic (count/sum/avg/max_by), so they
run as partial + final aggregation and a cluster holding a third of all
rows costs no more than a small one. Member lists are emitted in chunks of
at most ``chunk`` consecutive ids, never as one unbounded string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarp.config import RunConfig
from tidewarp.functions.dtw import distance_column
from tidewarp.functions.vec import series_mean, series_sd
from tidewarp.operators.reshape import dense_index

MEMBER_CHUNK = 10_000


def cluster_size(assigned: DataFrame, key_cols: list[str]) -> DataFrame:
    """A1."""
    return assigned.groupBy(*key_cols, "cluster_id").agg(F.count(F.lit(1)).cast("bigint").alias("cluster_count"))


def member_lists(assigned: DataFrame, key_cols: list[str], chunk: int = MEMBER_CHUNK) -> DataFrame:
    """``;``-joined sorted ids per cluster, one row per id block.

    Block = floor(id / chunk): ids are distinct within a model, so a block
    holds at most ``chunk`` ids whatever the cluster size.
    """
    return (assigned.withColumn("block", F.floor(F.col("id") / chunk).cast("bigint"))
            .groupBy(*key_cols, "cluster_id", "block")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ";")
                 .alias("members")))


def cluster_mean_vector(assigned: DataFrame, key_cols: list[str], length: int,
                        series_col: str = "series_norm", name: str = "center") -> DataFrame:
    """A3: mean vector per cluster, one ``avg`` per position over the series that have it (null if none)."""
    return (assigned.groupBy(*key_cols, "cluster_id")
            .agg(*[F.avg(F.get(F.col(series_col), F.lit(i))).alias(f"_m{i}") for i in range(length)])
            .select(*key_cols, "cluster_id", F.array(*[F.col(f"_m{i}") for i in range(length)]).alias(name)))


def cluster_total_vector(assigned: DataFrame, key_cols: list[str], length: int,
                         series_col: str = "series_full") -> DataFrame:
    """A4: element-wise total per cluster over the full series (raw + horizon); shorter series add what they have."""
    return (assigned.groupBy(*key_cols, "cluster_id")
            .agg(*[F.sum(F.get(F.col(series_col), F.lit(i))).alias(f"_t{i}") for i in range(length)])
            .select(*key_cols, "cluster_id", F.array(*[F.col(f"_t{i}") for i in range(length)]).alias("total")))


def cluster_statistic(assigned: DataFrame, key_cols: list[str], length: int) -> DataFrame:
    """A5: mean raw vector per cluster, then its mean and sample sd (Q9: sd)."""
    m = cluster_mean_vector(assigned, key_cols, length, "series_raw", "mean_raw")
    return m.select(*key_cols, "cluster_id", series_mean("mean_raw").alias("mean"), series_sd("mean_raw").alias("sd"))


def centre_spine(models: DataFrame, key_cols: list[str], k_col: str = "k") -> DataFrame:
    """Every (model, cluster_id) of 0..k-1, empty clusters included."""
    return models.select(*key_cols, F.explode(F.sequence(F.lit(0), F.col(k_col) - 1)).alias("cluster_id"))


def result_per_centre(centres: DataFrame, cluster_sil: DataFrame, key_cols: list[str]) -> DataFrame:
    """Every centre with its silhouette, -1 when the cluster is empty."""
    return (centres.join(cluster_sil, [*key_cols, "cluster_id"], "left")
            .withColumn("silhouette", F.coalesce("silhouette", F.lit(-1.0))))


def centres_by_column_means(assigned: DataFrame, models: DataFrame, key_cols: list[str], length: int,
                            empty_length: int | None = None) -> DataFrame:
    """Centre of every cluster by column means; empty -> vector of -1."""
    means = cluster_mean_vector(assigned, key_cols, length)
    fill = F.array_repeat(F.lit(-1.0), empty_length or length)
    return (centre_spine(models, key_cols).join(means, [*key_cols, "cluster_id"], "left")
            .withColumn("center", F.coalesce("center", fill)))


def member_sets(assigned: DataFrame, key_cols: list[str], chunk: int = MEMBER_CHUNK) -> DataFrame:
    """Distinct members per cluster: the count, and the set in id blocks."""
    sizes = assigned.groupBy(*key_cols, "cluster_id").agg(F.count_distinct("id").cast("bigint").alias("n_distinct"))
    return sizes, member_lists(assigned.dropDuplicates([*key_cols, "cluster_id", "id"]), key_cols, chunk)


def argmax_by(df: DataFrame, group_cols: list[str], value: str, score) -> DataFrame:
    """A10: per group, the value with the highest score; lowest id on ties."""
    s = F.col(score) if isinstance(score, str) else score
    return df.groupBy(*group_cols).agg(F.max_by(value, F.struct(s.alias("s"), (-F.col("id")).alias("i"))).alias(value),
                                       F.max(s).alias("score"))


# --------------------------------------------------------------------------
# ranked members
# --------------------------------------------------------------------------

LEAVES = 16  # parts of a cluster that are cut to their first members apart


def nearest_samples(assigned: DataFrame, key_cols: list[str], n: int, series_col: str = "series_norm") -> DataFrame:
    """K1: the n members nearest to their centre per cluster, identical
    vectors counted once (ascending distance, then lowest id).

    De-duplication is a partial/final aggregation on (cluster, vector);
    ``row_number() <= n`` becomes a map-side window group limit, so a hot
    cluster sends at most n rows per map task to its final sort.
    """
    dedup = (assigned.groupBy(*key_cols, "cluster_id", series_col)
             .agg(F.min("dist").alias("dist"), F.min("id").alias("id")))
    w = Window.partitionBy(*key_cols, "cluster_id").orderBy("dist", "id")
    return dedup.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str], name: str = "rank",
                broadcast_starts: bool = False) -> DataFrame:
    """1-based rank inside each group without a per-group window.

    A range-partitioned global sort spreads a hot group over many tasks
    (X11's distributed positions); a group's first position is a small
    min-aggregate (one row per group) joined back.
    """
    pos = dense_index(df, [*group_cols, *order_cols], "_gpos")
    starts = pos.groupBy(*group_cols).agg(F.min("_gpos").alias("_start"))
    return (pos.join(F.broadcast(starts) if broadcast_starts else starts, group_cols)
            .withColumn(name, (F.col("_gpos") - F.col("_start") + 1).cast("int"))
            .drop("_gpos", "_start"))


def rank_by_own_mean(assigned: DataFrame, key_cols: list[str], length: int, cfg: RunConfig,
                     series_col: str = "series_norm") -> DataFrame:
    """K2: all members ranked by distance to their cluster's column mean.

    The mean table (A3) is k x L per model, joined back on the cluster key;
    the distance is computed row-wise, the rank by :func:`rank_within`.
    """
    d = own_mean_distances(assigned, key_cols, length, cfg, series_col)
    return rank_within(d, [*key_cols, "cluster_id"], ["mean_dist", "id"], broadcast_starts=True)


def own_mean_distances(assigned: DataFrame, key_cols: list[str], length: int, cfg: RunConfig, series_col: str = "series_norm") -> DataFrame:
    """Each member's distance ``mean_dist`` to its cluster's column mean."""
    # one row per (model, cluster): bounded by models x k, broadcast so a hot
    # cluster is never a single join partition
    means = cluster_mean_vector(assigned, key_cols, length, series_col, "own_mean")
    return assigned.join(F.broadcast(means), [*key_cols, "cluster_id"]).withColumn(
        "mean_dist", distance_column(F.col(series_col), F.col("own_mean"), cfg.distance, cfg.gamma, cfg.band))


def first_by_own_mean(assigned: DataFrame, key_cols: list[str], length: int, cfg: RunConfig, n: int, series_col: str = "series_norm") -> DataFrame:
    """K3: the first ``n`` of K2 per cluster without ranking the rest. A task sends at most n members of a cluster and leaf, a leaf
    at most n of a cluster: two window group limits, so the last task of a cluster reads n x LEAVES rows whatever its size."""
    d = own_mean_distances(assigned, key_cols, length, cfg, series_col)
    group = [*key_cols, "cluster_id"]
    leaves = d.withColumn("_leaf", F.pmod(F.xxhash64("id"), F.lit(LEAVES)))
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "_leaf").orderBy("mean_dist", "id"))).where(F.col("rank") <= n)
    return leaves.drop("_leaf").withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("mean_dist", "id")).cast("int")).where(F.col("rank") <= n)


def every_sixth(df: DataFrame, tp_col: str = "time_point") -> DataFrame:
    """K4: months whose 1-based position i satisfies (i + 11) % 6 == 0."""
    return df.where(F.pmod(F.col(tp_col) + 1 + 11, 6) == 0)
