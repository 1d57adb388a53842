"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ranklane") -> SparkSession:
    """Session tuned for the library: AQE on (coalescing, skew-join splitting),
    UI off, UTC, ANSI semantics kept (the library guards divisions itself).
    Settings given from outside (spark-submit, defaults file) are kept; master,
    memory and shuffle partitions are chosen for a local run alone."""
    from pyspark import SparkConf, SparkContext
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit: its JVM knows what was set
        SparkContext._ensure_initialized()
    given = SparkConf()
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app_name)
    if master is not None or not given.contains("spark.master"):
        builder = builder.master(master or f"local[{cpus}]")
    local = (master or given.get("spark.master", "local")).split("[")[0] == "local"
    wanted = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
              "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
              "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
              "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if local:
        wanted |= {"spark.sql.shuffle.partitions": str(cpus),
                   "spark.driver.memory": os.environ.get("RANKLANE_DRIVER_MEMORY", "8g")}
    wanted = {k: v for k, v in wanted.items() if not given.contains(k)}
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = builder.config(map=wanted).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised stages.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system); the library never invents a machine-local one there. Only
    when the setting is absent (local tests) a fresh scratch folder is set.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="ranklane-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    import uuid

    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
