"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from tidewarp.session import ensure_checkpoint_dir, read_table, ship_package, staging_path

#: white space of the corpus contracts: space and the controls 9 to 13
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder and package shipping, once per context."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor can reach, so a lost executor costs no recomputation.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return read_table(spark, sf_dir, name)


def sliced(batches, rows: int = 1024):
    """The rows of Arrow batches, ``rows`` at a time, so that what a task makes of them never has the size of a whole batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def power_of_two_at_least(x: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, x))))


__all__ = ["SPACES", "WORD", "prepare", "sliced", "stage", "table", "power_of_two_at_least"]
