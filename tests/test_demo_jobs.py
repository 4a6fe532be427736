"""The reference's three demo jobs on their four input elements (FIXTURES.md §3)."""

from eventide.functions.aggregates import count_of
from eventide.operators.late import late_split
from eventide.operators.window_agg import windowed_agg
from eventide.plans.spec import LONG_MIN, WatermarkSpec, WindowAggSpec, WindowSpec

ROWS = [(0, 1, "device1"), (1, 105, "device2"), (2, 2, "device1"), (3, 104, "device2")]
SCHEMA = "seq BIGINT, ts_ms BIGINT, device STRING"


def split(spark, strategy):
    df = late_split(spark.createDataFrame(ROWS, SCHEMA), WatermarkSpec(strategy, 2), "device", "ts_ms", ["seq"])
    return sorted((r.tag, r.ts_ms, r.device, r.wm_seen) for r in df.collect())


def test_per_key_no_window(spark):
    assert split(spark, "key") == [("in_time", 1, "device1", LONG_MIN), ("in_time", 2, "device1", -1),
                                   ("in_time", 104, "device2", 103), ("in_time", 105, "device2", LONG_MIN)]


def test_global_no_window(spark):
    assert split(spark, "global") == [("in_time", 1, "device1", LONG_MIN), ("in_time", 104, "device2", 103),
                                      ("in_time", 105, "device2", -1), ("late", 2, "device1", 103)]


def test_global_tumbling_count_enriched(spark):
    spec = WindowAggSpec(WindowSpec(10), WatermarkSpec("global", 10), side_output=True)
    res = windowed_agg(spark.createDataFrame(ROWS, SCHEMA), spec, "device", "ts_ms", ["seq"], count_of("n"),
                       emit="enrich")
    out = sorted((r.window_end, r.device, r.n, r.trigger_seq) for r in res.output.collect())
    assert out == [(10, "device1", 1, 1), (110, "device2", 2, None)]  # second one at end of input
    assert [(r.ts_ms, r.device) for r in res.late.collect()] == [(2, "device1")]
