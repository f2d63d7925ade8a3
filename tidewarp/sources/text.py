"""Text sources (S1-S8): window files, result directories, PCA directories.

Lines are parsed with built-in expressions (``split`` + ``try_cast``); a bad
number does not fail the job but diverts the line, with a count (Q20).
Time points come from the path: Spark's ``time_point=i`` partition folders
(pruned by a range predicate) or, for the original layout, ``month_{i}``
file names via ``_metadata.file_path``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewarp.functions.vec import minmax_normalise
from tidewarp.operators.reshape import non_empty_lines
from tidewarp.session import staged


def _fields(col: str = "value"):
    return F.split(F.col(col), ",")


def parse_series(lines: DataFrame, length: int, col: str = "value", compat: bool = False) -> DataFrame:
    """``id,v0,v1,...`` -> id, series_full (all values), series_raw
    (first ``length``), series_norm. Ragged lines keep their own length.

    Adds ``bad`` = true when the id or any value does not parse; compat
    mode casts strictly, so a bad number fails the job as it did.
    """
    parts = _fields(col)
    def cast(c, t):
        return c.cast(t) if compat else c.try_cast(t)

    vals = F.transform(F.slice(parts, 2, F.size(parts)), lambda v: cast(F.trim(v), "double"))
    out = lines.select("*", cast(F.trim(F.element_at(parts, 1)), "bigint").alias("id"), vals.alias("series_full"))
    bad = F.col("id").isNull() | F.exists("series_full", lambda v: v.isNull())
    out = out.withColumn("bad", bad)
    out = out.withColumn("series_raw", F.slice("series_full", 1, length))
    return out.withColumn("series_norm", F.when(~F.col("bad"), minmax_normalise("series_raw")))


def parse_vector(lines: DataFrame, col: str = "value") -> DataFrame:
    """S3: every field of the line as a double (no id)."""
    return lines.withColumn("vector", F.transform(_fields(col), lambda v: F.trim(v).try_cast("double")))


def load_time_point(spark: SparkSession, path: str, length: int, time_point: int | None = None,
                    compat: bool = False) -> DataFrame:
    """Read one time point's text, drop empty lines (X7), parse.
    Bad lines are diverted (see :func:`bad_lines`)."""
    lines = non_empty_lines(spark.read.text(path))
    s = parse_series(lines, length, compat=compat)
    if time_point is not None:
        s = s.withColumn("time_point", F.lit(int(time_point)))
    return s.where(~F.col("bad")).drop("value", "bad")


def bad_lines(spark: SparkSession, path: str, length: int) -> DataFrame:
    """S2's diverted lines, with their text, for counting and inspection."""
    lines = non_empty_lines(spark.read.text(path))
    return parse_series(lines, length).where(F.col("bad")).select("value")


def load_time_point_range(spark: SparkSession, base: str, tp_from: int, tp_to: int, length: int,
                          layout: str = "partitioned") -> DataFrame:
    """All time points from..to in one scan.

    ``partitioned``: ``base/time_point=i/`` folders; the range predicate
    prunes partitions before any file is opened.
    ``month_files``: ``base/month_{i}.csv`` files; the time point is read
    from the file name.
    """
    if layout == "partitioned":
        lines = spark.read.option("basePath", base).text(base)
        lines = lines.where((F.col("time_point") >= tp_from) & (F.col("time_point") <= tp_to))
    else:
        lines = spark.read.text(f"{base}/month_*.csv").withColumn(
            "time_point", F.regexp_extract(F.col("_metadata.file_path"), r"month_(\d+)", 1).cast("int"))
        lines = lines.where((F.col("time_point") >= tp_from) & (F.col("time_point") <= tp_to))
    s = parse_series(non_empty_lines(lines), length)
    return s.where(~F.col("bad")).select(F.col("time_point").cast("int"), "id", "series_full", "series_raw",
                                         "series_norm")


WIDE_CELLS = "file string, block long, row long, col long, value string"


def _wide_cells(batches):
    """Fields of a wide matrix in the order of its bytes -> WIDE_CELLS: ``row`` counts the line starts seen in the block, ``col`` the fields
    since the last one, or since the block's start. Blank lines, which are one blank field, are no line.

    A record ends at a comma, so a line break is inside one: what precedes it is the last field of a line, what follows it begins the next.
    A blank first line is left out here; the blank after a file's last line break is one field, left out by the caller."""
    file = block = None
    rows = cols = 0
    for b in batches:
        out = []
        for f, at, value in zip(*(c.to_pylist() for c in b.columns)):
            if (f, at) != (file, block):
                file, block, rows, cols = f, at, 0, 0
            parts = [p.strip() for p in value.split("\n")]
            first, ends = at == 0 and rows == 0, len(parts) - 1
            for i, p in enumerate(parts):
                if not p and (0 < i < ends or (i == 0 and first and ends)):
                    continue
                if i > 0 or (first and rows == 0):
                    rows, cols = rows + 1, 0
                out.append((file, block, rows, cols, p))
                cols += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                         ["file", "block", "row", "col", "value"])


def read_wide_matrix(spark: SparkSession, path: str) -> DataFrame:
    """S5 (+X1, X11): a headerless matrix, rows = time positions, columns =
    entities, to the long panel ``(id, pos, value)``; ids are the 1-based
    column positions, positions follow the files in the order of their paths.

    The comma is the record separator, so a file is split by bytes like any text and a line may lie in many tasks. A task numbers the
    fields of its byte ranges; what lines and fields precede a range is added up over the ranges (a row each) and joined back.
    """
    meta = F.col("_metadata")
    fields = spark.read.option("lineSep", ",").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value")
    cells = staged(fields.mapInArrow(_wide_cells, WIDE_CELLS), "wide-cells")
    order = Window.orderBy("file", "block")  # one row a byte range
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = cells.groupBy("file", "block").agg(F.max(F.struct("row", "col", "value")).alias("last"))
    # the blank after the last line break of a file
    ends = ~F.coalesce(F.lead("file").over(order) == F.col("file"), F.lit(False)) & (F.col("last.value") == "") & (F.col("last.col") == 0)
    ranges = ranges.withColumn("blank", F.when(ends, F.col("last.row")))
    ranges = ranges.withColumn("rows", F.coalesce(F.sum(F.col("last.row") - F.col("blank").isNotNull().cast("long")).over(before), F.lit(0)))
    # fields since the last line start before a range: all of the ranges since the one that holds it, from that start on
    ranges = ranges.withColumn("seen", F.sum(F.col("last.col") + 1).over(order))
    mark = F.when(F.col("last.row") > 0, F.col("seen") - F.col("last.col") - 1)
    ranges = ranges.withColumn("cols", F.coalesce(F.lag("seen").over(order) - F.last(mark, ignorenulls=True).over(before), F.lit(0)))
    base = staged(ranges.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "rows", "cols", "blank"), "wide-ranges")
    own = cells.join(base, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))).where("not (blank <=> row and col = 0)")
    col = F.col("col") + F.when(F.col("row") == 0, F.col("cols")).otherwise(0)
    return own.select((col + 1).cast("bigint").alias("id"), (F.col("rows") + F.col("row") - 1).cast("int").alias("pos"), F.col("value").try_cast("double").alias("value"))


def read_clustering_results(spark: SparkSession, base: str) -> DataFrame:
    """S6 + S7: result lines ``cluster,id,v...`` under run folders named
    ``{time point}_{k}_{round(1000 * silhouette)}``; PCA folders are skipped,
    ``_SUCCESS`` markers are ignored by the reader."""
    lines = spark.read.text(f"{base}/*/part-*").withColumn("_path", F.col("_metadata.file_path"))
    lines = lines.where(~F.col("_path").rlike(r"_pca/[^/]*$"))
    run = F.regexp_replace(F.element_at(F.split("_path", "/"), -2), "^run_dir=", "")
    parts = F.split(run, "_")
    fields = F.split("value", ",")
    return lines.select(
        F.element_at(parts, 1).cast("int").alias("time_point"),
        F.element_at(parts, 2).cast("int").alias("k"),
        (F.element_at(parts, 3).cast("double") / 1000).alias("run_silhouette"),
        F.element_at(fields, 1).cast("int").alias("cluster_id"),
        F.element_at(fields, 2).cast("bigint").alias("id"),
        F.transform(F.slice(fields, 3, F.size(fields)), lambda v: v.try_cast("double")).alias("series_norm"))


def decode_run_dir(path_col) -> list:
    """S7 alone: (time point, k, silhouette) from a run folder name."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(path_col, "/"), -2), "^run_dir=", ""), "_")
    return [F.element_at(parts, 1).cast("int").alias("time_point"), F.element_at(parts, 2).cast("int").alias("k"),
            (F.element_at(parts, 3).cast("double") / 1000).alias("run_silhouette")]


def read_pca_results(spark: SparkSession, base: str) -> DataFrame:
    """``id,pc1,pc2`` lines under ``{time point}_pca`` folders."""
    lines = spark.read.text(f"{base}/*_pca/part-*").withColumn("_path", F.col("_metadata.file_path"))
    tp = F.regexp_extract(F.element_at(F.split("_path", "/"), -2), r"(\d+)_pca", 1).cast("int")
    f = F.split("value", ",")
    return lines.select(tp.alias("time_point"), F.element_at(f, 1).cast("bigint").alias("id"),
                        F.element_at(f, 2).cast("double").alias("pc1"), F.element_at(f, 3).cast("double").alias("pc2"))
