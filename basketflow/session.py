"""SparkSession construction and shared-storage locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "basketflow", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with UTC time, AQE (runtime re-planning, partition coalescing,
    skew-join splitting) and Arrow for the few pandas paths.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor; its heap must hold
        # the shuffle and aggregation buffers of all task threads
        b = b.config("spark.driver.memory", os.environ.get("BASKETFLOW_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 << 20,
                  min_partitions: int = 200) -> int:
    """Size ``spark.sql.shuffle.partitions`` for the input at hand: about one
    partition per ``target_partition_bytes`` of input (AQE then coalesces
    small ones and splits skewed ones), never fewer than ``min_partitions``.
    At 100 TB this gives ~400k partitions of 256 MB, which fit executor memory
    without spilling the aggregation buffers."""
    n = max(min_partitions, int(input_bytes // target_partition_bytes) + 1)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_partition_bytes // 2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(target_partition_bytes, 512 << 20)))
    return n


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent and the master is ``local*`` (a laptop or a
    test) is a private folder created and registered; on a cluster a missing
    setting is an error, so no job writes to a machine-local path.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="basketflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 - sessions without a SparkContext (Spark Connect) use the conf
        pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
