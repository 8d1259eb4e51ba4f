"""Session construction and the shared scratch location.

Scratch data (materialised range partitions, round-trip files, model
artefacts written by registered queries) lives under the cluster's
``spark.checkpoint.dir``. The setting is read from the session; only when it
is unset (local runs, tests) do we create one, so that a cluster never gets
a machine-local temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "attrition",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """A session with the engine's settings. What ``spark-submit`` (or the
    caller) has set stays: master, memory and partition counts are chosen here
    only for a local run that names none."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    given = SparkConf()
    builder = SparkSession.builder.appName(app)
    if master or not given.contains("spark.master"):
        builder = builder.master(master or f"local[{cpus}]")
        builder = builder.config("spark.driver.memory", os.environ.get("ATTRITION_DRIVER_MEMORY", "16g"))
        shuffle_partitions = shuffle_partitions or (None if given.contains("spark.sql.shuffle.partitions") else int(cpus))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # prefix sums write reliable checkpoints; delete them once unreferenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint directory; created under /tmp only when unset
    and the master is local (one machine). Elsewhere an unset directory is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="attrition-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint directory."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/attrition-scratch/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a path that ``scratch_path`` gave, when nothing reads it any more."""
    root = f"{checkpoint_root(spark).rstrip('/')}/attrition-scratch/"
    if not path.startswith(root):
        raise ValueError(f"{path} is not scratch data")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


_SHIPPED: set = set()
_SHIPPING = threading.Lock()  # fold fits run in threads


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers on every executor.

    Pandas UDFs and ``mapInPandas`` closures refer to code in this package;
    like ``--py-files``, the package's sources are zipped once per
    SparkContext and distributed with ``addPyFile`` (code only — no data
    passes through this archive).
    """
    with _SHIPPING:
        _ship(spark.sparkContext)


def _ship(sc) -> None:
    import zipfile

    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="attrition-pkg-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
