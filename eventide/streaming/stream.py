"""Spark's own windowed stream (T3), and a sink with one folder per micro-batch.

The window operator and the late split as streams are in ``streaming/carried.py``.
All file locations live below the shared folder named by ``spark.checkpoint.dir``
(see :func:`eventide.session.checkpoint_root`), so a restarted driver or a
lost executor resumes from the same checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def native_windowed_agg(stream: DataFrame, event_time: str, delay: str, size: str, slide: str | None,
                        key: str, aggs: Sequence) -> DataFrame:
    """Spark's own watermark (``withWatermark``) and ``window`` aggregation, append mode.

    Differences from the reference's operators: the watermark is global and
    moves per micro-batch; append mode emits each window once (no allowed
    lateness, refires or side output); a window closes at ``end <= wm``.
    """
    w = F.window(event_time, size, slide) if slide else F.window(event_time, size)
    return stream.withWatermark(event_time, delay).groupBy(key, w).agg(*aggs)


def batch_writer(base: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: each micro-batch to ``<base>/batch=<id>``. Overwriting per
    batch id makes a retried batch replace its own files: exactly-once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={batch_id:09d}")

    return write


def read_sink(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """Read back what :func:`batch_writer` wrote, also if no micro-batch had a row."""
    return spark.read.schema(f"{schema}, batch INT").parquet(base).drop("batch")
