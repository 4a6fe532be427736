"""The 14 golden cases of the reference's window-operator tests, in batch."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventide.functions.aggregates import sum_of
from eventide.operators.window_agg import windowed_agg
from eventide.plans import prefix
from eventide.plans.spec import WatermarkSpec, WindowAggSpec, WindowSpec

NAMES = [
    "pk_sliding_reduce", "pk_tumbling_reduce", "pk_lateness_purge", "pk_cleanup_overflow",
    "pk_side_output_tumbling", "pk_side_output_sliding", "pk_cleanup_empty_state",
    "gl_sliding_reduce", "gl_tumbling_reduce", "gl_lateness_purge", "gl_cleanup_overflow",
    "gl_side_output_tumbling", "gl_side_output_sliding", "gl_cleanup_empty_state",
]


def spec_of(case):
    c = case.cfg
    strategy = {"key": "key", "explicit": "column", "global": "global"}[c["mode"]]
    wm = WatermarkSpec(strategy, int(c["bound"]), marker="wm" if strategy == "column" else None)
    return WindowAggSpec(
        window=WindowSpec(int(c["size"]), int(c["slide"])),
        watermark=wm,
        lateness=int(c["lateness"]),
        trigger=c["trigger"],
        side_output=c["tag"] == "yes",
        flush=False,
    )


def run_case(spark, case):
    res = windowed_agg(case.frame(spark), spec_of(case), "k", "ts_ms", ["seq"], sum_of("v", "total"))
    out = Counter((r.k, r.out_ts, r.total) for r in res.output.collect())
    late = Counter((r.k, r.ts_ms) for r in res.late.collect())
    dropped = res.dropped.collect()[0].dropped
    return out, late, dropped


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("range_rows", [100_000, 1, 3])
def test_golden_case(spark, cases, name, range_rows, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", range_rows)  # few rows to a range: several ranges
    case = cases[name]
    out, late, dropped = run_case(spark, case)
    assert out == Counter(case.out), name
    assert late == Counter(case.late), name
    assert dropped == case.dropped, name


@pytest.mark.parametrize("name", NAMES)
def test_golden_case_with_column_aggregate(spark, cases, name):
    """The non-mergeable path ({name: Column}) gives the same firings as the Accumulator."""
    case = cases[name]
    res = windowed_agg(case.frame(spark), spec_of(case), "k", "ts_ms", ["seq"],
                       {"total": F.sum("v")})
    assert Counter((r.k, r.out_ts, r.total) for r in res.output.collect()) == Counter(case.out)
