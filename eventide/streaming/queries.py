"""Registered Structured Streaming queries.

The source is replayed in arrival order, one week of arrivals at a time: a slice is
appended, the query runs over what is available and stops, and the next run starts
from the checkpoint and the carried state (A20). Micro-batch cuts follow the arrival
order, so results must equal the batch operator's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide import oracle as O
from eventide import registry as R
from eventide.functions.aggregates import Accumulator, combine, count_of, distinct_of, spread_of, sum_of
from eventide.functions.int64 import floor_div
from eventide.plans.spec import FIRE, FIRE_AND_PURGE, WatermarkSpec, WindowAggSpec, WindowSpec
from eventide.session import scratch_dir
from eventide.sources.events import KEY, ORDER, TS, event_stream
from eventide.streaming.carried import (
    carried_compare_sink, carried_late_split_sink, carried_window_sink, read_carried, read_comparison,
)
from eventide.streaming.stream import batch_writer, native_windowed_agg, read_sink

WEEK = 7 * 24 * R.HOUR
ORD = list(ORDER)
Sink = Callable[[str], Callable[[DataFrame, int], None]]


def replay(spark: SparkSession, source: DataFrame, cut_col: str, cut_width: int,
           build: Callable[[DataFrame], DataFrame], name: str, sink: Sink = batch_writer) -> str:
    """Feed ``source`` to the streaming job ``build`` slice by slice; returns the sink folder.

    Every slice is one append and one ``availableNow`` run that restarts from the checkpoint.
    """
    src, ckpt, out = (scratch_dir(spark, f"{name}-{p}") for p in ("src", "ckpt", "out"))
    cut = floor_div(F.col(cut_col), cut_width)
    slices = [r[0] for r in source.select(cut.alias("cut")).distinct().orderBy("cut").collect()]  # one row per slice
    if not slices:
        raise ValueError("empty source")
    for c in slices:
        source.filter(cut == c).write.mode("append").parquet(src)
        stream = build(spark.readStream.schema(source.schema).parquet(src))
        (stream.writeStream.foreachBatch(sink(out)).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start().awaitTermination())
    return out


def _events(spark, sf_dir):
    return event_stream(spark, sf_dir).select("event_id", KEY, TS, "arr_ms", "v")


def _window(spec: WindowAggSpec, aggregate: Callable[[], Accumulator], name: str, columns: list[str | Column], what: str = "fire", **options):
    """A window stream over ``events`` (explicit watermarks: with its marker rows)."""

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        acc = aggregate()  # columns need a running session
        src = R.explicit_stream(spark, sf_dir) if spec.watermark.strategy == "column" else _events(spark, sf_dir)
        out = replay(spark, src, "arr_ms", WEEK, lambda s: s, name,
                     sink=lambda base: carried_window_sink(base, spec, KEY, TS, ORD, acc, **options))
        return read_carried(spark, out, what).select(*columns)

    return q


def _late_split(strategy: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = ["event_id", KEY, TS, "wm_seen", "tag"]
        out = replay(spark, _events(spark, sf_dir), "arr_ms", WEEK, lambda s: s, f"late-split-{strategy}",
                     sink=lambda base: carried_late_split_sink(base, R.BOUND, KEY, TS, ORD, columns, strategy))
        return read_carried(spark, out, "rows").select(*columns)

    return q


def q_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replay(spark, _events(spark, sf_dir), "arr_ms", WEEK, lambda s: s, "compare",
                 sink=lambda base: carried_compare_sink(base, KEY, TS, ORD, R.BOUNDS))
    return read_comparison(spark, out)


def q_native_windowed_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = event_stream(spark, sf_dir).select("event_id", KEY, "arr_ms", "v", F.col(TS))
    src = src.withColumn("event_time", F.timestamp_millis(F.col(TS)))

    def build(s):
        agg = native_windowed_agg(s, "event_time", "1 hour", "1 hour", None, KEY,
                                  [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")])
        return agg.select(KEY, F.unix_millis(F.col("window.start")).alias("window_start"),
                          F.unix_millis(F.col("window.end")).alias("window_end"), "n", "total")

    out = replay(spark, src, "arr_ms", WEEK, build, "native")
    kind = src.schema[KEY].dataType.simpleString()
    return read_sink(spark, out, f"{KEY} {kind}, window_start BIGINT, window_end BIGINT, n BIGINT, total BIGINT")


#: Spark drops a row whose window ended by the watermark after the earlier micro-batches, and
#: emits a window when the watermark has reached its end.
NATIVE_SQL = f"""WITH {O.events_cte()},
s AS (SELECT *, arr_ms // {WEEK} AS slice, ts_ms - ts_ms % {R.HOUR} AS window_start FROM ev),
m AS (SELECT slice, max(max(ts_ms)) OVER (ORDER BY slice) - {R.HOUR} AS wm FROM s GROUP BY slice),
w AS (SELECT slice, lag(wm) OVER (ORDER BY slice) AS seen FROM m)
SELECT user_id, window_start, window_start + {R.HOUR} AS window_end, count(*) AS n, CAST(sum(v) AS BIGINT) AS total
FROM s JOIN w USING (slice) WHERE seen IS NULL OR window_start + {R.HOUR} > seen
GROUP BY user_id, window_start HAVING window_start + {R.HOUR} <= (SELECT max(wm) FROM m)"""

HOURLY, SLIDING = WindowSpec(R.HOUR), WindowSpec(2 * R.HOUR, 30 * R.MIN)
BY_KEY, BY_ALL = WatermarkSpec("key", R.BOUND), WatermarkSpec("global", R.GLOBAL_BOUND)
HEAD = [KEY, "window_start", "window_end", "out_ts", "fire", *[f"trigger_{o}" for o in ORD]]


def _both() -> Accumulator:
    return combine(count_of("n"), sum_of("v", "total"))


def _metrics(c: dict[str, Column]) -> Column:
    rows = F.array(F.struct(F.lit("n").alias("metric"), c["n"].alias("amount")),
                   F.struct(F.lit("total").alias("metric"), c["total"].alias("amount")))
    return F.filter(rows, lambda r: r["amount"] != 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    late = 2 * R.HOUR
    return {
        "stream_key_tumbling": _window(WindowAggSpec(HOURLY, BY_KEY), count_of, "key-tumbling", [*HEAD, "n"]),
        "stream_key_sliding": _window(WindowAggSpec(SLIDING, BY_KEY), lambda: sum_of(F.col("v") * 0.5, "half"), "key-sliding",
                                      [*HEAD, "half"]),
        "stream_key_lateness": _window(WindowAggSpec(HOURLY, BY_KEY, late, FIRE), _both, "key-lateness", [*HEAD, "n", "total"]),
        "stream_key_purge": _window(WindowAggSpec(HOURLY, BY_KEY, late, FIRE_AND_PURGE), _both, "key-purge",
                                    [*HEAD, "n", "total"]),
        "stream_key_side_output": _window(WindowAggSpec(HOURLY, BY_KEY, 30 * R.MIN, FIRE, True), count_of, "key-side",
                                          ["event_id", KEY, TS, "arr_ms", "v", "wm_seen"], "late"),
        "stream_custom_aggregate": _window(WindowAggSpec(WindowSpec(6 * R.HOUR), BY_KEY), lambda: spread_of("v"), "custom",
                                           [*HEAD, "spread"]),
        "stream_custom_window_function": _window(
            WindowAggSpec(HOURLY, BY_KEY), _both, "custom-function",
            [KEY, "window_start", "window_end", "out_ts", "fire", "metric", "amount"], window_fn=_metrics),
        "stream_enriched": _window(WindowAggSpec(HOURLY, BY_KEY), count_of, "enriched", ["window_end", KEY, "n"],
                                   emit="enrich"),
        "stream_late_split": _late_split("key"),
        "native_windowed_agg": q_native_windowed_agg,
        "stream_global_lateness": _window(WindowAggSpec(HOURLY, BY_ALL, late, FIRE), _both, "global-lateness",
                                          [*HEAD, "n", "total"]),
        "stream_explicit_watermark": _window(WindowAggSpec(HOURLY, WatermarkSpec("column", marker="wm_mark"), R.HOUR, FIRE),
                                             _both, "explicit-watermark", [*HEAD, "n", "total"]),
        "stream_late_split_global": _late_split("global"),
        "stream_compare_watermarks": q_compare,
        "stream_custom_distinct": _window(WindowAggSpec(WindowSpec(6 * R.HOUR), BY_KEY, late), lambda: distinct_of("v", "d"),
                                          "custom-distinct", [*HEAD, "d"]),
        "stream_custom_avg": _window(WindowAggSpec(WindowSpec(6 * R.HOUR), BY_KEY, late), lambda: {"mean": F.avg("v")},
                                     "custom-avg", [*HEAD, "mean"]),
        "stream_custom_code_aggregate": _window(WindowAggSpec(WindowSpec(6 * R.HOUR), BY_KEY, late), R.xor_of, "custom-code", [*HEAD, "x"]),
        "stream_custom_code_window_function": _window(
            WindowAggSpec(HOURLY, BY_KEY), _both, "custom-code-function", [KEY, "window_end", "part", "share"], window_fn=R.thirds()),
    }


def oracle_sql() -> dict[str, str]:
    batch = R.oracle_sql()
    sliding = O.window_agg_sql("key", R.BOUND, SLIDING.size, SLIDING.slide, aggs=("sum",))
    return {
        "stream_key_tumbling": batch["key_tumbling_count"],
        "stream_key_sliding": f"WITH f AS ({sliding}) SELECT * EXCLUDE (total), total * 0.5::DOUBLE AS half FROM f",
        "stream_key_lateness": batch["key_lateness_fire"],
        "stream_key_purge": batch["key_lateness_purge"],
        "stream_key_side_output": O.rows_sql(
            "key", R.BOUND, R.HOUR, R.HOUR, 0, 30 * R.MIN,
            "event_id, user_id, ts_ms, arr_ms, v, coalesce(wm_before, -9223372036854775808) AS wm_seen", "tag = 'late'"),
        "stream_custom_aggregate": batch["custom_aggregate"],
        "stream_custom_window_function": batch["custom_window_function"],
        "stream_enriched": batch["key_enriched"],
        "stream_late_split": batch["late_split_key"],
        "native_windowed_agg": NATIVE_SQL,
        # a stream has no end of input: the global watermark does not flush pending windows
        "stream_global_lateness": O.window_agg_sql("global", R.GLOBAL_BOUND, R.HOUR, R.HOUR, 0, 2 * R.HOUR, FIRE,
                                                   False, ("count", "sum")),
        "stream_explicit_watermark": batch["explicit_watermark_agg"],
        "stream_late_split_global": batch["late_split_global"],
        "stream_compare_watermarks": batch["compare_watermarks"],
        "stream_custom_distinct": batch["custom_distinct"],
        "stream_custom_avg": batch["custom_avg"],
        "stream_custom_code_aggregate": batch["custom_code_aggregate"],
        "stream_custom_code_window_function": batch["custom_code_window_function"],
    }
