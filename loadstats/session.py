"""Spark session settings and the shared scratch location.

Everything here is plain configuration; the library itself never creates a
session implicitly except through :func:`get_spark`.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session zone (timestamp_ntz data is read as
# wall-clock time), AQE with skew splitting, no UI server.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "loadstats", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")   # local mode: the driver JVM is the executor
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is only read here.
    When it is unset on a local master (tests) a private folder is created and
    registered so ``DataFrame.checkpoint()`` works too; anywhere else that folder
    would be one machine's own, so the setting has to be given.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="loadstats-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath)) or bool(fs.globStatus(hpath))


__all__ = ["get_spark", "checkpoint_root", "scratch_path", "path_exists", "BASE_CONF"]


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``loadstats`` importable in Python workers (pandas UDFs pickle
    module functions by reference): zip the package once and register it
    with ``addPyFile``, which distributes it to every executor."""
    import zipfile
    sc = spark.sparkContext
    key = id(sc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="loadstats-pkg-")
    zpath = os.path.join(out_dir, "loadstats.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def materialize(df):
    """Write a derived table once to the shared checkpoint folder and read it back.

    For work that scans its input several times (a statistics job plus the row
    pass, a position pass plus a carry pass), the upstream plan then runs once
    instead of once per branch. The checkpoint is reliable storage, so a lost
    executor only re-reads it (never a machine-local checkpoint).
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
