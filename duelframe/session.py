"""Spark session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job here relies on: UTC event time, ANSI arithmetic, AQE for runtime
# re-planning (partition coalescing, skew-join splitting, runtime broadcast choice).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def default_driver_memory(cap_gb: int = 16, share: float = 0.6) -> str:
    """A local driver heap that fits the machine: ``share`` of physical RAM, at most ``cap_gb``."""
    try:
        with open("/proc/meminfo") as fh:
            kb = next(int(line.split()[1]) for line in fh if line.startswith("MemTotal:"))
        gb = max(1, min(cap_gb, int(kb / 1024 / 1024 * share)))
    except (OSError, StopIteration, ValueError):
        gb = 4
    return f"{gb}g"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "duelframe", extra: dict | None = None) -> SparkSession:
    """Local/test session builder. On a cluster use the cluster's session instead."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("DUELFRAME_DRIVER_MEMORY") or default_driver_memory())
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_runtime_conf(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Runtime-settable SQL options (safe to call on a session someone else built)."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(k, BASE_CONF[k])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is read, never replaced; it
    must be set there.  Only a ``local`` master, whose executors are the driver, gets a
    fresh local folder when it is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir and not re.fullmatch(r"local(\[.*\])?", sc.master or ""):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="duelframe-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on any storage."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package's code to the executors, once for each application: their Python workers
    import what a function that runs there refers to."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="duelframe-code-"), "duelframe_core.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)          # Spark's own file server hands it to executors
    _SHIPPED.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write a DataFrame as parquet under the shared checkpoint folder and read it back.

    Cuts lineage in one job (a reliable ``checkpoint()`` computes its input twice unless
    cached) and gives later joins real size statistics and column pruning.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
