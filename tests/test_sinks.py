"""K1/K2: main and late sinks of batch results."""

from eventide.functions.aggregates import count_of
from eventide.operators.late import late_split
from eventide.operators.sinks import split_by_tag, write_window_result
from eventide.operators.window_agg import windowed_agg
from eventide.plans.spec import WatermarkSpec, WindowAggSpec, WindowSpec
from eventide.session import scratch_dir


def test_write_window_result(spark, cases):
    case = cases["pk_side_output_tumbling"]
    spec = WindowAggSpec(WindowSpec(2000), WatermarkSpec("key", 0), side_output=True)
    res = windowed_agg(case.frame(spark), spec, "k", "ts_ms", ["seq"], count_of("n"))
    paths = write_window_result(res, scratch_dir(spark, "sink-test"))
    assert spark.read.parquet(paths["output"]).count() == len(case.out)
    assert sorted((r.k, r.ts_ms) for r in spark.read.parquet(paths["late"]).collect()) == sorted(case.late)
    assert spark.read.parquet(paths["dropped"]).first().dropped == 0


def test_split_by_tag(spark):
    rows = [(0, 1, "d1"), (1, 105, "d2"), (2, 2, "d1"), (3, 104, "d2")]
    df = late_split(spark.createDataFrame(rows, "seq BIGINT, ts_ms BIGINT, device STRING"),
                    WatermarkSpec("global", 2), "device", "ts_ms", ["seq"])
    in_time, late = split_by_tag(df)
    assert in_time.count() == 3 and [r.ts_ms for r in late.collect()] == [2]
