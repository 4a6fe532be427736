"""Splitting a stream into in-time and late rows against a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.int64 import lit_long, min_long_or
from eventide.operators.watermark import as_list, with_watermarks
from eventide.plans.prefix import prefix_scans
from eventide.plans.reach import null_safe_join
from eventide.plans.spec import WatermarkSpec

IN_TIME = "in_time"
LATE = "late"


def late_split(
    df: DataFrame,
    spec: WatermarkSpec,
    key: str | Sequence[str],
    ts: str,
    order: Sequence[str],
    start_watermark: int | None = None,
    start_watermarks: DataFrame | None = None,
) -> DataFrame:
    """Tag every row ``late`` iff ``ts <= wm_before`` of its strategy, else ``in_time``.

    The decision uses the watermark *before* the row; the row moves the
    watermark afterwards. ``start_watermark`` continues a global watermark from
    earlier input (a stream's previous micro-batches), ``start_watermarks`` (keys and
    ``wm``) the watermarks of keys. ``wm_seen`` is the watermark the row saw with "none"
    as Long.MIN_VALUE (the reference's projection, C3). Sinks filter on ``tag``.
    """
    if spec.strategy == "column":
        raise ValueError("late_split takes the 'key' or 'global' strategy")
    if start_watermark is not None and spec.strategy != "global":
        raise ValueError("a start watermark continues a global watermark (micro-batches of a stream)")
    if start_watermarks is not None and spec.strategy != "key":
        raise ValueError("a table of start watermarks continues per-key watermarks")
    out = with_watermarks(df, spec, key, ts, order)
    wm0 = lit_long(start_watermark) if start_watermark is not None else None
    if start_watermarks is not None:
        known = start_watermarks.select(*as_list(key), F.col("wm").alias("_wm0"))
        out, wm0 = null_safe_join(out, known, as_list(key), "left"), F.col("_wm0")
    if wm0 is not None:
        out = out.withColumn("wm_before", F.greatest(wm0, F.col("wm_before"))).withColumn(
            "wm_after", F.greatest(wm0, F.col("wm_after"))).drop("_wm0")
    return out.withColumn(
        "tag", F.when(F.col(ts) <= F.col("wm_before"), F.lit(LATE)).otherwise(F.lit(IN_TIME))
    ).withColumn("wm_seen", min_long_or(F.col("wm_before")))


def compare_watermarks(
    df: DataFrame,
    key: str | Sequence[str],
    ts: str,
    order: Sequence[str],
    bounds: Sequence[int],
    start: int | None = None,
    start_of_keys: DataFrame | None = None,
) -> DataFrame:
    """How many rows each strategy declares late, for several bounds at once (C4).

    ``start`` and ``start_of_keys`` (keys and ``wm``) are the largest event times of earlier input, over
    all rows and of each key: a stream's previous micro-batches.

    ``wm_before - bound`` is monotone in the bound, so one running max of the
    event time per strategy (exclusive of the row) serves every bound:
    a row is late under bound b iff ``ts <= max_before - b``. One scan per
    strategy, one global partial aggregate, then ``stack`` into rows.
    """
    bounds = [int(b) for b in bounds]
    if not bounds or any(b < 0 for b in bounds):
        raise ValueError(f"bounds must be a non-empty list of non-negative values: {bounds}")
    scanned = prefix_scans(
        df.select(*as_list(key), ts, *order),
        [(as_list(key), {"_key_max": ("max", ts, False)}), ([], {"_glob_max": ("max", ts, False)})],
        order,
    )

    if start is not None:
        scanned = scanned.withColumn("_glob_max", F.greatest("_glob_max", lit_long(start)))
    if start_of_keys is not None:
        known = start_of_keys.select(*as_list(key), F.col("wm").alias("_wm0"))
        scanned = null_safe_join(scanned, known, as_list(key), "left").withColumn("_key_max", F.greatest("_key_max", "_wm0"))
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, b in enumerate(bounds):
        for strat, col in (("key", "_key_max"), ("global", "_glob_max")):
            late = F.col(ts) <= F.try_subtract(F.col(col), lit_long(b))
            aggs.append(F.count_if(F.coalesce(late, F.lit(False))).alias(f"_{strat}_{i}"))
    totals = scanned.agg(*aggs)

    parts = []
    for i, b in enumerate(bounds):
        for strat in ("key", "global"):
            parts.append(f"'{strat}', cast({b} as bigint), _{strat}_{i}")
    stacked = totals.selectExpr(
        "n_rows", f"stack({len(parts)}, {', '.join(parts)}) as (strategy, bound_ms, n_late)"
    )
    return stacked.select(
        "strategy",
        "bound_ms",
        "n_rows",
        "n_late",
        (F.col("n_rows") - F.col("n_late")).alias("n_in_time"),
        (F.col("n_late") / F.col("n_rows")).alias("late_ratio"),
    )
