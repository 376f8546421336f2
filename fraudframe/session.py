"""Spark session helpers and the shared scratch location.

Everything that must survive an executor loss (materialised rank tables,
CSV round trips, saved models in tests) is written under the folder the
cluster names in ``spark.checkpoint.dir``.  We only invent a folder when the
setting is absent *and* the master is local (tests, the bench); on a real
cluster a missing setting is an error, never a machine-local temp folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "fraudframe", driver_memory: str | None = None) -> SparkSession:
    """Session tuned for the engine: AQE with skew-join splitting, UTC, no UI.

    Master and driver memory are left to the submit configuration unless given here: settings
    made in code would win over ``spark-submit``.
    """
    builder = (
        SparkSession.builder
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    if driver_memory is not None:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable for Python workers of a local master; a cluster gets it as any package (``--py-files``)."""
    sc = spark.sparkContext
    if sc.master.split("[")[0] == "local" and sc.applicationId not in _SHIPPED:
        sc.addFile(str(Path(__file__).resolve().parent), recursive=True)
        _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for materialised intermediates.

    Read from the session (``spark.checkpoint.dir`` or the SparkContext's
    checkpoint dir).  Only a local master may fall back to a fresh temp folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; fraudframe needs a shared folder for "
            "materialised intermediates on a cluster")
    key = sc.applicationId
    if key not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[key] = tempfile.mkdtemp(prefix="fraudframe-ckpt-")
        sc.setCheckpointDir(_LOCAL_SCRATCH[key])
    return _LOCAL_SCRATCH[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/fraudframe/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    Cuts lineage (so a non-deterministic step such as range sampling is run
    exactly once) and survives executor loss, unlike caching.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete the folder behind a :func:`materialize` result that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder made by :func:`scratch_path` through Spark's own file system layer."""
    if "/fraudframe/" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
