"""Panel reshaping, projection, filter and sampling.

The dense series of an entity is built from its own (pos, value) entries,
which are bounded by the number of positions, so no id x position spine
(and no cross join) is ever materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.session import staging_path
from tidewarp.functions.vec import minmax_normalise, series_sum, uniform01


def dense_series(panel: DataFrame, n_pos: int, fill: float = 0.0) -> DataFrame:
    """X1 (transpose): long panel -> ``(id, series ARRAY<DOUBLE>)`` of length ``n_pos``.

    Positions outside 0..n_pos-1 are dropped; missing positions get ``fill``.
    """
    p = panel.where((F.col("pos") >= 0) & (F.col("pos") < n_pos))
    grouped = p.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("m"))
    return grouped.select(
        "id",
        F.transform(F.sequence(F.lit(0), F.lit(n_pos - 1)),
                    lambda q: F.coalesce(F.element_at("m", q), F.lit(float(fill)))).alias("series"))


def head_positions(panel: DataFrame, length: int) -> DataFrame:
    """X2 on a long panel: keep the first ``length`` positions."""
    return panel.where(F.col("pos") < length)


def sliding_windows(series: DataFrame, window: int, tp_from: int, tp_to: int, length: int,
                    series_col: str = "series") -> DataFrame:
    """X3 + X4 + F1: one row per (time_point, id) for windows ``tp_from..tp_to``.

    ``series_full`` is the window (raw + horizon), ``series_raw`` its first
    ``length`` points, ``series_norm`` the min-max normalised raw part.
    Windows that run past the end are truncated, as slicing does.
    """
    s = series.select("id", F.explode(F.sequence(F.lit(tp_from), F.lit(tp_to))).alias("time_point"), series_col)
    s = s.select(F.col("time_point").cast("int"), "id",
                 F.slice(series_col, F.col("time_point") + 1, window).alias("series_full"))
    return with_raw_norm(s, length)


def with_raw_norm(s: DataFrame, length: int) -> DataFrame:
    """raw = first ``length`` points of ``series_full``; F1 on raw."""
    s = s.withColumn("series_raw", F.slice("series_full", 1, length))
    s = s.withColumn("_least", F.array_min("series_raw")).withColumn("_most", F.array_max("series_raw"))
    return s.withColumn("series_norm", minmax_normalise("series_raw", "_least", "_most")).drop("_least", "_most")


def horizon(series_full, length: int, h: int):
    """The ``h`` points after the raw part."""
    return F.slice(series_full, length + 1, h)


def drop_dead(s: DataFrame, col: str = "series_norm") -> DataFrame:
    """Drop series whose normalised sum is 0 (constant series)."""
    return s.where(series_sum(col) != 0)


def sample_exact(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """Exactly ``min(n, count)`` rows of distinct keys without replacement, seeded and independent of partitioning:
    the ``n`` smallest md5 uniforms of the key. Only keys are ranked (a top-n of a narrow scan); their rows follow by a
    semi-join."""
    u = uniform01(F.lit(seed), F.col(key), F.lit(0))
    chosen = df.select(key, u.alias("_u")).orderBy("_u", key).limit(n).select(key)
    return df.join(chosen, key, "left_semi")


def non_empty_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """X7."""
    return lines.where(F.length(col) > 0)


def members_of(assign: DataFrame, cluster_id: int) -> DataFrame:
    """Id and series of one cluster."""
    return assign.where(F.col("cluster_id") == cluster_id)


def lookup_ids(df: DataFrame, ids: DataFrame | list[int], key: str = "id") -> DataFrame:
    """Rows of the given ids; a list becomes a pushed-down IN filter, a
    DataFrame a semi-join."""
    if isinstance(ids, list):
        return df.where(F.col(key).isin(ids))
    return df.join(ids.select(key).distinct(), key, "left_semi")


def round4(col) -> F.Column:
    """Round half-even to 4 places."""
    return F.bround(col, 4)


def dense_index(df: DataFrame, order_cols: list[str], name: str = "row_pos", start: int = 1) -> DataFrame:
    """X11: consecutive positions ``start..`` along ``order_cols``, distributed.

    Range-partition, sort and stage the rows once; the files' names are in the order of the partitions. Counts (one number
    a file) and positions (a row's place in its file) both come from the staged files, so a task that is run again, or an
    executor that is lost, cannot move rows, and nothing stays persisted. No single-task window.
    """
    path = staging_path(df.sparkSession, "positions")
    df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols).write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = sorted(rows.groupBy("_file").count().collect())
    offsets, at = [], start
    for file, n in counts:
        offsets.append((file, at))
        at += n
    offsets = df.sparkSession.createDataFrame(offsets, "_file string, _first long")  # a row a partition
    return rows.join(F.broadcast(offsets), "_file").withColumn(name, F.col("_first") + F.col("_row")).drop("_file", "_row", "_first")


def month_projection(panel: DataFrame, t: int, n_cols: int | None = None) -> DataFrame:
    """The values of one position; with ``n_cols`` the position cycles."""
    pos = t % n_cols if n_cols else t
    return panel.where(F.col("pos") == pos)


def inspect_head(df: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    """First rows by key."""
    return df.orderBy(key).limit(n)


def inspect_shape(df: DataFrame, series_col: str = "series_full") -> DataFrame:
    """Row count and widest series."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size(series_col)).cast("int").alias("n_cols"))
