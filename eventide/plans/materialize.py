"""Computing a shared intermediate once.

Several outputs of the window operator consume the same watermarked rows;
left lazy, Spark would recompute the watermark scan (the largest shuffle) for
each consumer. The rows are written once as a parquet table below the shared
folder named by ``spark.checkpoint.dir`` and read back: one computation, a
columnar compressed copy, and a cut lineage, so a lost executor re-reads files
instead of recomputing the scan. (An eager ``checkpoint()`` of an unpersisted
plan would run the lineage twice: once to count, once to write.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from eventide.session import scratch_dir

MODES = ("table", "checkpoint", "none")


def materialize(df: DataFrame, mode: str = "table", name: str = "rows", folder: str | None = None,
                made: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    folder: a fixed place to (over)write the table, e.g. a stream's work folder
    reused by every micro-batch; by default a new folder below the checkpoint root,
    which is noted in ``made`` so that its owner can ``delete`` it.
    """
    if mode not in MODES:
        raise ValueError(f"materialize mode must be one of {MODES}, not {mode!r}")
    if mode == "none":
        return df
    spark = df.sparkSession
    if mode == "checkpoint":
        scratch_dir(spark, name)  # makes sure a checkpoint folder is registered
        return df.checkpoint(eager=True)
    path = f"{folder.rstrip('/')}/{name}" if folder else scratch_dir(spark, name)
    if made is not None and not folder:
        made.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folders: Sequence[str]) -> None:
    """Delete folders on whatever file system they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
