"""Sinks for window results (K1 main output, K2 late side output, drop counter)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventide.operators.window_agg import WindowAggResult


def write_window_result(res: WindowAggResult, path: str, mode: str = "overwrite") -> dict[str, str]:
    """Write firings, side output and the drop counter to ``path/{output,late,dropped}``.

    What the firings have stored for themselves is deleted at the end.
    """
    out = {}
    for name, df in (("output", res.output), ("late", res.late), ("dropped", res.dropped)):
        target = f"{path.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(target)
        out[name] = target
    res.release()
    return out


def split_by_tag(rows: DataFrame, tag: str = "tag") -> tuple[DataFrame, DataFrame]:
    """(in-time rows, late rows) of a ``late_split`` result, for two sinks (K1, K2)."""
    return rows.filter(rows[tag] != "late"), rows.filter(rows[tag] == "late")
