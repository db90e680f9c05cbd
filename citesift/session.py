"""Spark session and shared-storage helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans joins and partition counts from runtime sizes, skew-join
# splitting is on, timestamps are read in UTC (the driver tables carry timestamp_ntz), and Arrow carries
# the few pandas batches we use.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "citesift", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without one gets a private folder: on a cluster every executor would write to its own
    disk, so there the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master or "").startswith("local") or (sc.master or "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="citesift-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediate tables, placed next to the checkpoint folder.

    Each call gets a new unique sub-folder so reruns never overwrite a path that is being read.
    """
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
        base = os.path.dirname(base.rstrip("/")) if os.path.basename(base).count("-") == 4 else base
        return os.path.join(base, "citesift-work", f"{name}-{uuid.uuid4().hex[:12]}")
    # remote file systems: keep the scheme, sit beside the checkpoint data
    parent = base.rstrip("/").rsplit("/", 1)[0]
    return f"{parent}/citesift-work/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of queries that are done.

    Spark deletes them once the driver's JVM has found that nothing refers to them, which may be long after where its heap
    fills slowly; until then they lie on the executors' disks beside those of the steps that follow.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``citesift`` importable in the Python workers of this Spark context (once per application).

    Code that runs inside tasks and refers to classes or functions of the package (registered providers and
    embedding models) needs the package on the workers.  A deployment normally passes it with ``--py-files``;
    this adds the same zip through ``addPyFile`` when the driver imported the package from source.  The
    zip holds only the package's ``.py`` files; Spark serves it to the executors.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="citesift-pyfiles-"), "citesift.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(app)
