"""Migration between time points and companion stability.

Co-membership is never materialised as pairs. One shuffle by id gathers each id's trajectory, its cluster at every time point
(at most T entries); every lag is read from it. Companion counts are

* ``remain``: ids per (lag, time point, cluster now, cluster later), and
* ``companions``: ids per (lag, time point, cluster now),

combined in the map before they shuffle; their row counts are bounded by lags x T x k^2 (run parameters, not
data). They are staged and joined back to the ids' rows, so the work is O(N), and no row shuffles by a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.session import staged

BROADCAST_ROWS = 1_000_000  # counts that are sent to the tasks; more are joined by shuffle


def migration(assigned: DataFrame, key_cols: list[str] = ("time_point",), tp_col: str = "time_point") -> DataFrame:
    """J1 (W5): customers moving from cluster p at t-1 to cluster c at t.

    Non-empty pairs only; ``change_proportion`` = overlap / size of the
    *current* cluster (``share_of_current``); ``share_of_previous`` divides
    by the earlier cluster's size instead (Q13).
    """
    key_cols = list(key_cols)
    other = [c for c in key_cols if c != tp_col]
    prev = assigned.select(*other, "id", (F.col(tp_col) + 1).alias(tp_col), F.col("cluster_id").alias("cluster_previous"))
    cur = assigned.select(*key_cols, "id", F.col("cluster_id").alias("cluster_current"))
    moved = (prev.join(cur, [*key_cols, "id"])
             .groupBy(*key_cols, "cluster_previous", "cluster_current")
             .agg(F.count(F.lit(1)).cast("bigint").alias("number_cus")))
    cur_size = (assigned.groupBy(*key_cols, F.col("cluster_id").alias("cluster_current"))
                .agg(F.count(F.lit(1)).alias("_n_cur")))
    prev_size = (assigned.groupBy(*other, (F.col(tp_col) + 1).alias(tp_col), F.col("cluster_id").alias("cluster_previous"))
                 .agg(F.count(F.lit(1)).alias("_n_prev")))
    return (moved.join(cur_size, [*key_cols, "cluster_current"]).join(prev_size, [*key_cols, "cluster_previous"])
            .withColumn("change_proportion", F.col("number_cus") / F.col("_n_cur"))
            .withColumn("share_of_previous", F.col("number_cus") / F.col("_n_prev"))
            .drop("_n_cur", "_n_prev"))


def companion_ratios(assigned: DataFrame, lags, key_cols: list[str] = ("time_point",), tp_col: str = "time_point") -> DataFrame:
    """J5 core, for all ``lags``: per id at t, the share of its companions at t (same cluster,
    self included) that share its cluster again at t + lag.

    Ids absent at t + lag get a NULL ratio but still count in the
    denominator of the others (alignment by id, Q14). Only time points with
    a t + lag present in the data are reported.
    """
    key_cols = list(key_cols)
    other = [c for c in key_cols if c != tp_col]
    entry = F.struct(F.col(tp_col).cast("int").alias("t"), F.col("cluster_id").alias("c"))
    path = assigned.groupBy(*other, "id").agg(F.map_from_entries(F.collect_list(entry)).alias("path"))
    steps = path.select(*other, "id", "path", F.explode(F.map_entries("path")).alias("e")).select(
        *other, "id", "path", F.col("e.key").alias(tp_col), F.col("e.value").alias("c_now"),
        F.explode(F.array(*[F.lit(int(lag)) for lag in lags])).alias("lag"))
    rows = steps.select(*key_cols, "lag", "id", "c_now", F.try_element_at("path", F.col(tp_col) + F.col("lag")).alias("c_later"))
    counts = rows.groupBy(*key_cols, "lag", "c_now", "c_later").agg(F.count(F.lit(1)).alias("n"))
    periods = assigned.select(F.col(tp_col).cast("int").alias("_t")).distinct()
    counts = staged(counts.join(periods, F.col(tp_col) + F.col("lag") == F.col("_t"), "left_semi"), "companions")
    sizes = counts.groupBy(*key_cols, "lag", "c_now").agg(F.sum("n").alias("companions"))
    known = counts.join(sizes, [*key_cols, "lag", "c_now"]).select(
        *[F.col(c).alias(f"_{c}") for c in (*key_cols, "lag", "c_now", "c_later")], "companions",
        F.when(F.col("c_later").isNotNull(), F.col("n")).alias("remain"))
    known = F.broadcast(known) if counts.count() <= BROADCAST_ROWS else known
    same = F.col("c_later").eqNullSafe(F.col("_c_later"))
    for c in (*key_cols, "lag", "c_now"):
        same = same & (F.col(c) == F.col(f"_{c}"))
    return rows.join(known, same).select(*key_cols, "lag", "id", "c_now", "c_later", "remain", "companions", (F.col("remain") / F.col("companions")).alias("ratio"))


def companion_ratio(assigned: DataFrame, lag: int, key_cols: list[str] = ("time_point",), tp_col: str = "time_point") -> DataFrame:
    """J5 core for one lag."""
    return companion_ratios(assigned, [lag], key_cols, tp_col)


def changed_customers(assigned: DataFrame, lag: int, threshold: float, key_cols: list[str] = ("time_point",),
                      tp_col: str = "time_point") -> DataFrame:
    """Ids whose ratio is <= threshold (at the threshold counts as changed)."""
    return changed_over_lags(assigned, [lag], threshold, key_cols, tp_col)


def changed_over_lags(assigned: DataFrame, lags=(1, 3, 6, 12), threshold: float = 0.8,
                      key_cols: list[str] = ("time_point",), tp_col: str = "time_point") -> DataFrame:
    """J5 for several lags, from one trajectory shuffle."""
    return companion_ratios(assigned, lags, key_cols, tp_col).where(F.col("ratio") <= threshold)


def change_between(assigned: DataFrame, t_now: int, t_next: int, threshold: float,
                   key_cols: list[str] = ("time_point",), tp_col: str = "time_point") -> DataFrame:
    """J5 for one given pair of time points."""
    two = assigned.where(F.col(tp_col).isin(t_now, t_next))
    return changed_customers(two, t_next - t_now, threshold, key_cols, tp_col).where(F.col(tp_col) == t_now)


def core_members(assigned: DataFrame, changed: DataFrame, key_cols: list[str] = ("time_point",)) -> DataFrame:
    """Members not in the changed list (anti-join) ..."""
    return assigned.join(changed.select(*key_cols, "id"), [*list(key_cols), "id"], "left_anti")


def core_flag(assigned: DataFrame, changed: DataFrame, key_cols: list[str] = ("time_point",)) -> DataFrame:
    """... and every member with a core flag (left join + isNull)."""
    ch = changed.select(*key_cols, "id", F.lit(True).alias("_changed")).dropDuplicates([*list(key_cols), "id"])
    return (assigned.join(ch, [*list(key_cols), "id"], "left")
            .withColumn("is_core", F.col("_changed").isNull()).drop("_changed"))


def companions_of(assigned: DataFrame, customer_id: int, key_cols: list[str] = ("time_point",)) -> DataFrame:
    """The companion mask of one customer: at every time point, the
    members of its cluster (itself included). The customer's cluster per
    time point is one row per model (broadcast); members are a semi-join on
    it, so no pairs are formed."""
    key_cols = list(key_cols)
    mine = (assigned.where(F.col("id") == customer_id)
            .select(*key_cols, "cluster_id", F.lit(int(customer_id)).cast("bigint").alias("of_id")))
    return assigned.join(F.broadcast(mine), [*key_cols, "cluster_id"]).select(*key_cols, "of_id", "id", "cluster_id")


def co_membership_counts(assigned: DataFrame, key_cols: list[str] = ("time_point",)) -> DataFrame:
    """The size of the co-membership relation per time point
    (sum of squared cluster sizes, self pairs included), from sizes only."""
    sizes = assigned.groupBy(*key_cols, "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*key_cols).agg(F.sum(F.col("n") * F.col("n")).cast("bigint").alias("co_member_pairs"),
                                        F.sum("n").cast("bigint").alias("members"))


def attach_pca(assigned: DataFrame, pca: DataFrame, key_cols: list[str] = ("time_point",)) -> DataFrame:
    """Left join of the PCA coordinates by (time point, id)."""
    return assigned.join(pca, [*list(key_cols), "id"], "left")
