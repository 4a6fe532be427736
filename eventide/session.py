"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "eventide") -> SparkSession:
    """Session with the settings the operators rely on.

    UTC session time zone, AQE on (runtime coalescing, skew splitting and
    size-checked broadcast conversion), RocksDB state store (required by
    ``transformWithStateInPandas``), a cache for the generated code of all of a stream's plans
    (a micro-batch of the window operator has more than the 100 that Spark keeps by default), no web UI. On a cluster also set
    ``spark.checkpoint.dir`` (shared folder) and size
    ``spark.sql.shuffle.partitions`` / ``spark.sql.files.maxPartitionBytes`` for
    the data (see README, "Cluster settings").
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_LOCAL_FALLBACK: str | None = None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a folder every executor and the driver can
    reach); without it the call fails. Only in local mode, as in tests, a fresh
    local folder is made and registered for the rest of the process.
    """
    global _LOCAL_FALLBACK
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():  # one process: as in tests
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder shared by the driver and all executors; "
            "a machine-local folder cannot hold checkpoints or intermediate tables on a cluster"
        )
    if _LOCAL_FALLBACK is None:
        _LOCAL_FALLBACK = tempfile.mkdtemp(prefix="eventide-ckpt-")
        spark.sparkContext.setCheckpointDir(_LOCAL_FALLBACK)
    return _LOCAL_FALLBACK


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the checkpoint root for one job's files (made by its first writer)."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
