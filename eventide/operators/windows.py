"""Event-time window assignment (W1-W5) as column expressions.

A row with event time ``ts`` belongs to every window ``[start, start+size)``
with ``start ≡ offset (mod slide)`` and ``ts - size < start <= ts``. Starts use
floor arithmetic (``pmod``), so negative event times work; with ``slide >
size`` (sampling) some rows fall in no window.

int64 edges, kept on purpose so results match the reference at the end of
time: when ``ts - offset + slide`` does not fit in int64 the reference's start
computation wraps around and the row joins no window (it still moves the
watermark); windows whose end would not fit are never produced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.int64 import lit_long
from eventide.plans.spec import LONG_MAX, LONG_MIN, WindowSpec


def _largest_valid_start(w: WindowSpec) -> int:
    """Largest grid start whose window end still fits in int64."""
    top = LONG_MAX - w.size
    return top - ((top - w.offset) % w.slide)


def window_geometry(ts: Column, w: WindowSpec) -> tuple[Column, Column]:
    """(newest window start, number of windows) of a row; 0 windows for gaps.

    The row's windows are ``newest - k * slide`` for k in [0, n).
    """
    shifted = F.try_subtract(ts, lit_long(w.offset))
    fits = F.try_add(shifted, lit_long(w.slide)).isNotNull()
    last_start = F.try_subtract(ts, F.pmod(shifted, lit_long(w.slide)))  # NULL below int64: no window
    newest = F.when(last_start.isNotNull(), F.least(last_start, lit_long(_largest_valid_start(w))))
    lowest = F.coalesce(F.try_subtract(ts, lit_long(w.size - 1)), lit_long(LONG_MIN))
    n = F.when(fits & (newest >= lowest), F.floor(F.try_subtract(newest, lowest) / F.lit(w.slide)).cast("bigint") + 1)
    # (newest - lowest) < size, so the double division above is exact
    return newest, F.coalesce(n, lit_long(0))


def with_window_geometry(df: DataFrame, ts: str, w: WindowSpec, newest: str = "_w_newest",
                         count: str = "n_windows") -> DataFrame:
    top, n = window_geometry(F.col(ts), w)
    return df.withColumn(newest, top).withColumn(count, n)


def explode_windows(df: DataFrame, w: WindowSpec, newest: str = "_w_newest", count: str = "n_windows",
                    first: str | None = None) -> DataFrame:
    """One row per (row, window): adds window_start, window_end, max_ts.

    Windows are numbered from the newest; ``first`` and ``count`` name columns with
    the first number and the one after the last.
    """
    low = F.col(first) if first else lit_long(0)
    out = df.filter(F.col(count) > low).withColumn("_w_k", F.explode(F.sequence(low, F.col(count) - 1)))
    start = F.col(newest) - F.col("_w_k") * lit_long(w.slide)  # the row's windows all fit in int64
    return (
        out.withColumn("window_start", start)
        .withColumn("window_end", F.col("window_start") + lit_long(w.size))
        .withColumn("max_ts", F.col("window_end") - 1)
        .drop("_w_k")
    )


def assign_windows(df: DataFrame, ts: str, window: WindowSpec) -> DataFrame:
    """Every (row, window) pair (W1 tumbling, W2 sliding, W3 offset, W4 sampling gaps)."""
    geo = with_window_geometry(df, ts, window)
    return explode_windows(geo, window).drop("_w_newest", "n_windows", "max_ts")


def gap_rows(df: DataFrame, ts: str, window: WindowSpec) -> DataFrame:
    """Rows that belong to no window (A13 candidates, W4)."""
    geo = with_window_geometry(df, ts, window)
    return geo.filter(F.col("n_windows") == 0).drop("_w_newest", "n_windows")
