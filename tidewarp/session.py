"""Spark session and shared-folder helpers.

Staging data (reliable checkpoints, derived text files) always goes under
the folder the cluster names in ``spark.checkpoint.dir``. Only when that is
unset (tests, a laptop) do we pick one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "tidewarp", shuffle_partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a local one is set only where it is unset and the master is local."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get(_CKPT_KEY, None) or sc.getConf().get(_CKPT_KEY, None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="tidewarp-ckpt-")
        spark.conf.set(_CKPT_KEY, current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/staging/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, reliable: bool = False) -> DataFrame:
    """Materialise ``df`` for iterative reuse.

    ``reliable=True`` writes it to the shared checkpoint folder (survives
    executor loss without recomputation); otherwise it is persisted and a
    lost block is recomputed from its (short) lineage.
    """
    if reliable:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: what follows starts from files every executor can reach."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def session_key(spark: SparkSession) -> str:
    """Cache key of a session: its application id (unique per context, unlike
    ``id()`` which Python may reuse after a session is stopped)."""
    return f"{spark.sparkContext.applicationId}:{spark.sparkContext.startTime}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tidewarp`` importable in every Python worker.

    The package is zipped once per Spark context on the driver and handed to
    ``addPyFile`` (the programmatic ``--py-files``); Spark's file server then
    distributes it to each executor, so workers need no shared path.
    """
    import zipfile

    sc = spark.sparkContext
    key = session_key(spark)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tidewarp-pyfiles-"), "tidewarp.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
