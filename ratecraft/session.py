"""Session helpers: a local session for tests/bench, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale as well as locally: AQE re-plans joins from
# runtime sizes (broadcast only what turns out small, split skewed
# partitions), and coalesces the many shuffle partitions a big cluster needs.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "ratecraft", extra: dict | None = None) -> SparkSession:
    """A ``local[cpus]`` session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions",
                             str(shuffle_partitions or cpus))
    builder = builder.config("spark.driver.memory", "16g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when a local session has none (a bare test session) do we create one. A
    folder that is named is taken as it is: a ``file:`` path may well be a mount
    that all machines share, and only the cluster's owner knows.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        # A folder of our own would be on this machine alone: executors could
        # not write to it, nor read it back.
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/a mount all machines share)")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="ratecraft-ckpt-"))
    return sc.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    return checkpoint_root(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (for models, sinks)."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/ratecraft/{name}-{uuid.uuid4().hex[:12]}"


def env_cpus(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
