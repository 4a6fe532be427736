"""Registered queries over the driver's tables, each with its DuckDB oracle.

Stream: ``events`` with key ``user_id``, event time ``ts_ms`` and the arrival
order ``(arr_ms, event_id)`` of :mod:`eventide.sources.events`. Sums are over
``v`` (value in integer cents). Every query reads the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide import oracle as O
from eventide.functions.aggregates import Accumulator, combine, count_of, distinct_of, mean_of, spread_of, sum_of
from eventide.functions.code import ArrowFunction, CodeAccumulator
from eventide.functions.int64 import floor_div, lit_long
from eventide.operators.late import compare_watermarks, late_split
from eventide.operators.watermark import key_watermark_snapshot, watermark_range, with_watermarks
from eventide.operators.window_agg import windowed_agg
from eventide.operators.windows import assign_windows
from eventide.plans.spec import FIRE, FIRE_AND_PURGE, LONG_MAX, WatermarkSpec, WindowAggSpec, WindowSpec
from eventide.sources.events import KEY, ORDER, TS, event_stream

MIN = 60_000
HOUR = 3_600_000
BOUND = HOUR  # out-of-orderness bound of the per-key queries
GLOBAL_BOUND = 6 * HOUR  # the global watermark loses most rows below this
BOUNDS = (0, HOUR, 6 * HOUR)
EXPLICIT = (HOUR, 26 * HOUR)  # hourly watermark rows, 26 h behind arrival time

Query = Callable[[SparkSession, str], DataFrame]
ORD = list(ORDER)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream(spark, sf_dir, columns=())


def _agg(name: str) -> Accumulator:
    return {"count": count_of("n"), "sum": sum_of("v", "total"), "spread": spread_of("v", "spread")}[name]


def _window_query(strategy: str, bound: int, window: WindowSpec, lateness: int = 0, trigger: str = FIRE,
                  flush: bool | None = None, aggs: tuple[str, ...] = ("count",)) -> tuple[Query, str]:
    spec = WindowAggSpec(window, WatermarkSpec(strategy, bound), lateness, trigger, False, flush)

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        acc = combine(*[_agg(a) for a in aggs]) if len(aggs) > 1 else _agg(aggs[0])
        return windowed_agg(_stream(spark, sf_dir), spec, KEY, TS, ORD, acc).output

    sql = O.window_agg_sql(strategy, bound, window.size, window.slide, window.offset, lateness, trigger,
                           spec.flush, aggs)
    return q, sql


def _rows_query(strategy: str, bound: int, window: WindowSpec, lateness: int, side_output: bool,
                where: Callable[[DataFrame], DataFrame], cols: list[str], sql_where: str) -> tuple[Query, str]:
    spec = WindowAggSpec(window, WatermarkSpec(strategy, bound), lateness, FIRE, side_output)

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        res = windowed_agg(_stream(spark, sf_dir), spec, KEY, TS, ORD, count_of("n"))
        return where(res).select(*cols)

    sql_cols = ", ".join("coalesce(wm_before, -9223372036854775808) AS wm_seen" if c == "wm_seen" else c
                         for c in cols)
    return q, O.rows_sql(strategy, bound, window.size, window.slide, window.offset, lateness, sql_cols, sql_where)


def _dropped_query(strategy: str, bound: int, window: WindowSpec, lateness: int) -> tuple[Query, str]:
    spec = WindowAggSpec(window, WatermarkSpec(strategy, bound), lateness, FIRE, False)

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windowed_agg(_stream(spark, sf_dir), spec, KEY, TS, ORD, count_of("n")).dropped

    sql = O.rows_sql(strategy, bound, window.size, window.slide, window.offset, lateness,
                     "CAST(count(*) FILTER (WHERE tag = 'late') AS BIGINT) AS dropped")
    return q, sql


# ---------------------------------------------------------------- watermarks

def q_key_watermark(spark, sf_dir):
    df = with_watermarks(_stream(spark, sf_dir), WatermarkSpec("key", BOUND), KEY, TS, ORD)
    return df.select("event_id", KEY, TS, "arr_ms", "wm_before", "wm_after")


def q_global_watermark(spark, sf_dir):
    df = with_watermarks(_stream(spark, sf_dir), WatermarkSpec("global", BOUND), KEY, TS, ORD)
    return df.select("event_id", KEY, TS, "arr_ms", "wm_before", "wm_after")


def _wm_sql(strategy):
    return f"""WITH {O.events_cte()}, {O.stream_cte(BOUND, strategy)}
SELECT event_id, user_id, ts_ms, arr_ms, wm_before, wm_after FROM wm"""


def q_key_watermark_snapshot(spark, sf_dir):
    return key_watermark_snapshot(_stream(spark, sf_dir), KEY, TS, BOUND)


def q_watermark_range(spark, sf_dir):
    return watermark_range(_stream(spark, sf_dir), KEY, TS, BOUND)


SNAPSHOT_SQL = f"""WITH {O.events_cte()}
SELECT user_id, max(ts_ms) - {BOUND} AS watermark, count(*) AS n_rows FROM ev GROUP BY user_id"""

RANGE_SQL = f"""WITH {O.events_cte()}, snap AS (SELECT user_id, max(ts_ms) - {BOUND} AS watermark FROM ev GROUP BY 1)
SELECT min(watermark) AS low_watermark, max(watermark) AS high_watermark, count(*) AS n_keys FROM snap"""


# ---------------------------------------------------------------- late split

def _late_split(strategy, only_late):
    def q(spark, sf_dir):
        df = late_split(_stream(spark, sf_dir), WatermarkSpec(strategy, BOUND), KEY, TS, ORD)
        if only_late:
            return df.filter(F.col("tag") == "late").select("event_id", KEY, TS, "wm_seen")
        return df.select("event_id", KEY, TS, "wm_seen", "tag")

    cols = "event_id, user_id, ts_ms, coalesce(wm_before, -9223372036854775808) AS wm_seen"
    if only_late:
        sql = f"WITH {O.events_cte()}, {O.stream_cte(BOUND, strategy)} SELECT {cols} FROM wm WHERE ts_ms <= wm_before"
    else:
        sql = (f"WITH {O.events_cte()}, {O.stream_cte(BOUND, strategy)} SELECT {cols}, "
               "CASE WHEN ts_ms <= wm_before THEN 'late' ELSE 'in_time' END AS tag FROM wm")
    return q, sql


def q_compare_watermarks(spark, sf_dir):
    return compare_watermarks(_stream(spark, sf_dir), KEY, TS, ORD, BOUNDS)


def _compare_sql(bounds=BOUNDS, source=None):
    parts = []
    for b in bounds:
        for strat, part in (("key", "PARTITION BY user_id "), ("global", "")):
            parts.append(f"""SELECT '{strat}' AS strategy, CAST({b} AS BIGINT) AS bound_ms, count(*) AS n_rows,
  count(*) FILTER (WHERE ts_ms <= mx - {b}) AS n_late
FROM (SELECT ts_ms, max(ts_ms) OVER ({part}ORDER BY arr_ms, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM ev)""")
    return f"""WITH {O.events_cte(source)}, c AS ({' UNION ALL '.join(parts)})
SELECT strategy, bound_ms, n_rows, n_late, n_rows - n_late AS n_in_time,
       CAST(n_late AS DOUBLE) / n_rows AS late_ratio FROM c"""


# ---------------------------------------------------------------- window assignment

def _assign(window: WindowSpec, gaps_only: bool = False):
    def q(spark, sf_dir):
        df = _stream(spark, sf_dir).select("event_id", KEY, TS)
        if gaps_only:
            from eventide.operators.windows import gap_rows
            return gap_rows(df, TS, window)
        return assign_windows(df, TS, window)

    g = O.largest_valid_start(window.size, window.slide, window.offset)
    s, sl, off = window.size, window.slide, window.offset
    geo = f"""geo AS (
  SELECT event_id, user_id, ts_ms, newest,
         CASE WHEN newest >= ts_ms - {s - 1} THEN (newest - (ts_ms - {s - 1})) // {sl} + 1 ELSE 0 END AS n
  FROM (SELECT *, least(ts_ms - (((ts_ms - {off}) % {sl}) + {sl}) % {sl}, {g}) AS newest FROM ev))"""
    if gaps_only:
        sql = f"WITH {O.events_cte()}, {geo} SELECT event_id, user_id, ts_ms FROM geo WHERE n = 0"
    else:
        sql = f"""WITH {O.events_cte()}, {geo}
SELECT event_id, user_id, ts_ms, newest - r.k * {sl} AS window_start, newest - r.k * {sl} + {s} AS window_end
FROM geo, LATERAL (SELECT unnest(range(geo.n)) AS k) r WHERE n > 0"""
    return q, sql


# ---------------------------------------------------------------- explicit watermark, custom functions

def explicit_stream(spark: SparkSession, sf_dir: str, every: int = EXPLICIT[0], lag: int = EXPLICIT[1]) -> DataFrame:
    """Data rows plus watermark rows derived from arrival times: one per arrival
    ``every`` ms bucket, placed at the bucket's end and ``lag`` behind it."""
    ev = _stream(spark, sf_dir).select("event_id", KEY, TS, "arr_ms", "v").withColumn("wm_mark", F.lit(None).cast("bigint"))
    marks = (
        ev.select(((floor_div(F.col("arr_ms"), every) + 1) * lit_long(every)).alias("arr_ms")).distinct()
        .select(
            lit_long(-1).alias("event_id"), F.lit(None).cast("bigint").alias(KEY), F.lit(None).cast("bigint").alias(TS),
            "arr_ms", F.lit(None).cast("bigint").alias("v"), (F.col("arr_ms") - lit_long(lag)).alias("wm_mark"),
        )
    )
    return ev.unionByName(marks)


def q_explicit_watermark_agg(spark, sf_dir):
    spec = WindowAggSpec(WindowSpec(HOUR), WatermarkSpec("column", marker="wm_mark"), lateness=HOUR)
    acc = combine(count_of("n"), sum_of("v", "total"))
    return windowed_agg(explicit_stream(spark, sf_dir), spec, KEY, TS, ORD, acc).output


def q_custom_window_function(spark, sf_dir):
    """Each firing emits one (metric, amount) row per non-zero metric."""
    spec = WindowAggSpec(WindowSpec(HOUR), WatermarkSpec("key", BOUND))
    acc = combine(count_of("n"), sum_of("v", "total"))

    def per_metric(c):
        rows = F.array(F.struct(F.lit("n").alias("metric"), c["n"].alias("amount")),
                       F.struct(F.lit("total").alias("metric"), c["total"].alias("amount")))
        return F.filter(rows, lambda r: r["amount"] != 0)

    out = windowed_agg(_stream(spark, sf_dir), spec, KEY, TS, ORD, acc, window_fn=per_metric).output
    return out.select(KEY, "window_start", "window_end", "out_ts", "fire", "metric", "amount")


def _custom_wf_sql():
    base = O.window_agg_sql("key", BOUND, HOUR, HOUR, aggs=("count", "sum"))
    return f"""WITH f AS ({base})
SELECT user_id, window_start, window_end, out_ts, fire, 'n' AS metric, n AS amount FROM f WHERE n <> 0
UNION ALL
SELECT user_id, window_start, window_end, out_ts, fire, 'total' AS metric, total AS amount FROM f WHERE total <> 0"""


def _any_aggregate(name: str, lateness: int) -> tuple[Query, str]:
    """Aggregates that are not sums, counts, minima or maxima, with cumulative late refires: any Column,
    different values, an average as sum and count, Python code."""
    make = {"distinct": lambda: distinct_of("v", "d"), "distinct column": lambda: {"d": F.count_distinct("v")},
            "mean": lambda: mean_of("v"), "mean column": lambda: {"mean": F.avg("v")}, "xor": xor_of}[name]
    spec = WindowAggSpec(WindowSpec(6 * HOUR), WatermarkSpec("key", BOUND), lateness)

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windowed_agg(_stream(spark, sf_dir), spec, KEY, TS, ORD, make()).output

    return q, O.window_agg_sql("key", BOUND, 6 * HOUR, 6 * HOUR, 0, lateness, FIRE, False, (name.split()[0],))


def xor_of() -> CodeAccumulator:
    """A user's aggregate in Python: exclusive or of the values."""
    def add(state: tuple, rows: pa.RecordBatch) -> tuple:
        values = rows.column(0).drop_null().to_numpy()
        return (state[0] ^ int(np.bitwise_xor.reduce(values)), state[1] + len(values))

    return CodeAccumulator((("v", "v"),), "x BIGINT, n BIGINT", "x BIGINT", zero=lambda: (0, 0), add=add,
                           merge_states=lambda a, b: (a[0] ^ b[0], a[1] + b[1]), finish_state=lambda s: (s[0] if s[1] else None,))


def q_custom_code_window_function(spark, sf_dir):
    """G6 in Python: each firing emits ``n % 3`` rows."""
    spec = WindowAggSpec(WindowSpec(HOUR), WatermarkSpec("key", BOUND))
    out = windowed_agg(_stream(spark, sf_dir), spec, KEY, TS, ORD, combine(count_of("n"), sum_of("v", "total")),
                       window_fn=thirds()).output
    return out.select(KEY, "window_end", "part", "share")


def thirds() -> ArrowFunction:
    def parts(firings: pa.RecordBatch) -> pa.Table:
        n = firings.column("n").to_numpy()
        at = pa.array(np.repeat(np.arange(len(n)), n % 3))
        part = np.arange(len(at)) - np.repeat(np.cumsum(n % 3) - n % 3, n % 3)
        own = firings.take(at)
        return pa.table({KEY: own.column(KEY), "window_end": own.column("window_end"), "part": part,
                         "share": pc.add(own.column("total"), pa.array(part))})

    return ArrowFunction(parts, f"{KEY} BIGINT, window_end BIGINT, part BIGINT, share BIGINT")


def _thirds_sql():
    return f"""WITH f AS ({O.window_agg_sql("key", BOUND, HOUR, HOUR, aggs=("count", "sum"))})
SELECT user_id, window_end, r.part, total + r.part AS share FROM f, LATERAL (SELECT unnest(range(n % 3)) AS part) r"""


#: The last 30 days of int64 time but for two hours: cleanup times pass int64 there.
SPAN = 30 * 24 * HOUR
LATE_START = LONG_MAX - SPAN - 2 * HOUR


def q_key_cleanup_overflow(spark, sf_dir):
    """Event times wrapped into the end of int64 time, lateness of 10 days: the cleanup time saturates."""
    spec = WindowAggSpec(WindowSpec(HOUR), WatermarkSpec("key", BOUND), 10 * 24 * HOUR)
    late = _stream(spark, sf_dir).withColumn(TS, lit_long(LATE_START) + F.col(TS) % SPAN)
    return windowed_agg(late, spec, KEY, TS, ORD, combine(count_of("n"), sum_of("v", "total"))).output


def _cleanup_overflow_sql():
    """In 128-bit arithmetic nothing overflows: a cleanup time beyond int64 is one that no watermark reaches."""
    source = f"SELECT * REPLACE (CAST({LATE_START} AS HUGEINT) + ts_ms % {SPAN} AS ts_ms) FROM ({O.EVENT_STREAM_SQL})"
    f = O.window_agg_sql("key", BOUND, HOUR, HOUR, 0, 10 * 24 * HOUR, FIRE, False, ("count", "sum"), source=source)
    times = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("window_start", "window_end", "out_ts"))
    return f"WITH f AS ({f}) SELECT * REPLACE ({times}) FROM f"


def q_key_enriched(spark, sf_dir):
    spec = WindowAggSpec(WindowSpec(HOUR), WatermarkSpec("key", BOUND))
    out = windowed_agg(_stream(spark, sf_dir), spec, KEY, TS, ORD, count_of("n"), emit="enrich").output
    return out.select("window_end", KEY, "n")


# ---------------------------------------------------------------- a second stream: orders

DAY = 24 * HOUR
ORDER_BOUNDS = (0, 30 * DAY, 365 * DAY)


def q_orders_compare_watermarks(spark, sf_dir):
    from eventide.sources import orders as S

    return compare_watermarks(S.order_stream(spark, sf_dir), S.KEY, S.TS, list(S.ORDER), ORDER_BOUNDS)


def _orders_compare_sql():
    from eventide.sources.orders import ORDERS_AS_EVENTS_SQL

    return _compare_sql(ORDER_BOUNDS, ORDERS_AS_EVENTS_SQL)


def _orders_window(strategy: str, bound: int, window: WindowSpec, lateness: int, aggs: tuple[str, ...]):
    from eventide.sources import orders as S

    spec = WindowAggSpec(window, WatermarkSpec(strategy, bound), lateness)
    names = [{"count": "n", "sum": "total"}[a] for a in aggs]

    def q(spark, sf_dir):
        acc = combine(*[_agg(a) for a in aggs]) if len(aggs) > 1 else _agg(aggs[0])
        out = windowed_agg(S.order_stream(spark, sf_dir), spec, S.KEY, S.TS, list(S.ORDER), acc).output
        return out.select(S.KEY, "window_start", "window_end", "out_ts", "fire", "trigger_o_orderkey", *names)

    base = O.window_agg_sql(strategy, bound, window.size, window.slide, window.offset, lateness, FIRE,
                            spec.flush, aggs, source=S.ORDERS_AS_EVENTS_SQL)
    sql = f"""WITH f AS ({base})
SELECT user_id AS o_custkey, window_start, window_end, out_ts, fire, trigger_arr_ms AS trigger_o_orderkey,
       {', '.join(names)} FROM f"""
    return q, sql


def _build() -> tuple[dict[str, Query], dict[str, str]]:
    qs: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def add(name, q, s=None):
        qs[name] = q
        if s is not None:
            sql[name] = s

    add("compare_watermarks", q_compare_watermarks, _compare_sql())
    add("key_watermark", q_key_watermark, _wm_sql("key"))
    add("global_watermark", q_global_watermark, _wm_sql("global"))
    add("key_watermark_snapshot", q_key_watermark_snapshot, SNAPSHOT_SQL)
    add("watermark_range", q_watermark_range, RANGE_SQL)
    for strat in ("key", "global"):
        add(f"late_split_{strat}", *_late_split(strat, False))
        add(f"late_rows_{strat}", *_late_split(strat, True))

    add("assign_tumbling", *_assign(WindowSpec(HOUR)))
    add("assign_sliding", *_assign(WindowSpec(2 * HOUR, 30 * MIN)))
    add("assign_offset", *_assign(WindowSpec(HOUR, HOUR, 15 * MIN)))
    add("assign_gap", *_assign(WindowSpec(20 * MIN, HOUR), gaps_only=True))

    tumble, slide = WindowSpec(HOUR), WindowSpec(2 * HOUR, 30 * MIN)
    for strat, bound in (("key", BOUND), ("global", GLOBAL_BOUND)):
        add(f"{strat}_tumbling_count", *_window_query(strat, bound, tumble))
        add(f"{strat}_sliding_sum", *_window_query(strat, bound, slide, aggs=("sum",)))
        add(f"{strat}_lateness_fire", *_window_query(strat, bound, tumble, 2 * HOUR, FIRE, aggs=("count", "sum")))
        add(f"{strat}_lateness_purge", *_window_query(strat, bound, tumble, 2 * HOUR, FIRE_AND_PURGE,
                                                      aggs=("count", "sum")))
        cols = ["event_id", KEY, TS, "wm_seen"]
        add(f"{strat}_side_output", *_rows_query(strat, bound, tumble, 30 * MIN, True,
                                                 lambda r: r.late, cols, "tag = 'late'"))
        add(f"{strat}_dropped_count", *_dropped_query(strat, bound, tumble, 30 * MIN))

    add("key_partly_late", *_rows_query(
        "key", BOUND, slide, 0, False,
        lambda r: r.rows.filter((F.col("tag") == "in_window") & (F.col("n_dropped_windows") > 0)),
        ["event_id", KEY, TS, "n_windows", "n_dropped_windows"], "tag = 'in_window' AND n_dropped_windows > 0"))
    add("key_gap_rows", *_rows_query(
        "key", BOUND, WindowSpec(20 * MIN, HOUR), 0, False,
        lambda r: r.rows.filter(F.col("tag") == "gap"), ["event_id", KEY, TS], "tag = 'gap'"))
    add("key_flush", *_window_query("key", BOUND, tumble, flush=True))
    add("key_cleanup_overflow", q_key_cleanup_overflow, _cleanup_overflow_sql())
    add("key_enriched", q_key_enriched, f"""WITH f AS ({O.window_agg_sql('key', BOUND, HOUR, HOUR)})
SELECT window_end, user_id, n FROM f""")
    add("custom_aggregate", *_window_query("key", BOUND, WindowSpec(6 * HOUR), aggs=("spread",)))
    add("custom_distinct", *_any_aggregate("distinct", 2 * HOUR))
    add("custom_distinct_on_time", *_any_aggregate("distinct column", 0))
    add("custom_avg", *_any_aggregate("mean column", 2 * HOUR))
    add("custom_mean", *_any_aggregate("mean", 2 * HOUR))
    add("custom_code_aggregate", *_any_aggregate("xor", 2 * HOUR))
    add("custom_code_window_function", q_custom_code_window_function, _thirds_sql())
    add("custom_window_function", q_custom_window_function, _custom_wf_sql())
    add("explicit_watermark_agg", q_explicit_watermark_agg,
        O.window_agg_sql("column", 0, HOUR, HOUR, 0, HOUR, FIRE, False, ("count", "sum"), explicit=EXPLICIT))
    add("orders_compare_watermarks", q_orders_compare_watermarks, _orders_compare_sql())
    add("orders_key_lateness_fire", *_orders_window("key", 30 * DAY, WindowSpec(30 * DAY), 60 * DAY,
                                                    ("count", "sum")))
    add("orders_global_tumbling_count", *_orders_window("global", 365 * DAY, WindowSpec(30 * DAY), 0,
                                                        ("count",)))
    return qs, sql


_BUILT: tuple[dict[str, Query], dict[str, str]] | None = None


def _built() -> tuple[dict[str, Query], dict[str, str]]:
    global _BUILT
    if _BUILT is None:
        _BUILT = _build()
    return _BUILT


def queries() -> dict[str, Query]:
    return dict(_built()[0])


def oracle_sql() -> dict[str, str]:
    return dict(_built()[1])
