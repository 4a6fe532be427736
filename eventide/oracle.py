"""DuckDB SQL for the registered queries (the correctness oracle).

Straightforward, single-machine SQL of the same semantics: plain window
functions partitioned by key (or not at all), a join for the firing moment.
It is meant to be obviously right, not fast; it runs on the small scale
factors only. The events stream definition is shared with the Spark side.
"""

from __future__ import annotations

from eventide.plans.spec import LONG_MAX
from eventide.sources.events import EVENT_STREAM_SQL

ORDER_SQL = "arr_ms, event_id"


def stream_cte(bound: int, strategy: str, source: str = "ev") -> str:
    """CTE ``wm``: the stream with wm_before / wm_after."""
    part = "PARTITION BY user_id " if strategy == "key" else ""
    contrib = "wm_mark" if strategy == "column" else f"ts_ms - {bound}"
    return f"""
wm AS (
  SELECT s.*,
    max({contrib}) OVER (
      {part}ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm_before,
    max({contrib}) OVER (
      {part}ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wm_after
  FROM {source} s
)"""


def events_cte(source: str | None = None) -> str:
    """CTE ``ev``: the stream (event_id, user_id, ts_ms, arr_ms, v) — events by default."""
    return f"ev AS ({source or EVENT_STREAM_SQL})"


def markers_cte(hour: int, lag: int) -> str:
    """Data rows plus hourly explicit watermark rows derived from arrival times."""
    return f"""
marks AS (
  SELECT DISTINCT ((arr_ms - ((arr_ms % {hour}) + {hour}) % {hour}) + {hour}) AS arr_ms FROM ev
),
src AS (
  SELECT event_id, user_id, ts_ms, arr_ms, v, CAST(NULL AS BIGINT) AS wm_mark FROM ev
  UNION ALL
  SELECT -1 AS event_id, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS BIGINT) AS ts_ms, arr_ms,
         CAST(NULL AS BIGINT) AS v, arr_ms - {lag} AS wm_mark FROM marks
)"""


def largest_valid_start(size: int, slide: int, offset: int) -> int:
    top = LONG_MAX - size
    return top - ((top - offset) % slide)


def tagged_cte(size: int, slide: int, offset: int, lateness: int, data_filter: str = "TRUE") -> str:
    """CTEs ``geo`` and ``tagged``: window geometry and the per-row tag."""
    g = largest_valid_start(size, slide, offset)
    return f"""
geo AS (
  SELECT *, CASE WHEN newest >= ts_ms - {size - 1} THEN (newest - (ts_ms - {size - 1})) // {slide} + 1
                 ELSE 0 END AS n_windows
  FROM (SELECT *, least(ts_ms - (((ts_ms - {offset}) % {slide}) + {slide}) % {slide}, {g}) AS newest
        FROM wm WHERE {data_filter})
),
tagged AS (
  SELECT *,
    CASE WHEN n_windows > 0 AND NOT coalesce(newest + {size - 1 + lateness} <= wm_before, FALSE) THEN 'in_window'
         WHEN coalesce(ts_ms + {lateness} <= wm_before, FALSE) THEN 'late'
         ELSE 'gap' END AS tag,
    CASE WHEN wm_before IS NULL OR n_windows = 0 THEN 0
         ELSE n_windows - least(greatest(
              CAST(ceil((newest + {size - 1 + lateness} - wm_before) / {slide}) AS BIGINT), 0), n_windows)
    END AS n_dropped_windows
  FROM geo
)"""


def pairs_cte(size: int, slide: int, lateness: int) -> str:
    """CTE ``cls``: (row, window) pairs of accepted rows with their class."""
    return f"""
pairs AS (
  SELECT t.*, t.newest - r.k * {slide} AS window_start
  FROM tagged t, LATERAL (SELECT unnest(range(CAST(t.n_windows AS BIGINT))) AS k) r
  WHERE t.tag = 'in_window'
),
cls AS (
  SELECT *, window_start + {size} AS window_end, window_start + {size - 1} AS max_ts,
    CASE WHEN coalesce(window_start + {size - 1 + lateness} <= wm_before, FALSE) THEN 'drop'
         WHEN coalesce(window_start + {size - 1} <= wm_before, FALSE) THEN 'late'
         ELSE 'on' END AS cls
  FROM pairs
)"""


# aggregate name -> (group aggregate, running aggregate over a frame named w, single-row value)
AGGS = {
    "count": ("n", "count(*)", "count(*) OVER w", "CAST(1 AS BIGINT)"),
    "sum": ("total", "CAST(sum(v) AS BIGINT)", "CAST(sum(v) OVER w AS BIGINT)", "v"),
    "distinct": ("d", "count(DISTINCT v)", "count(DISTINCT v) OVER w", "CAST(1 AS BIGINT)"),
    "xor": ("x", "bit_xor(v)", "bit_xor(v) OVER w", "v"),
    "mean": ("mean", "avg(v)", "avg(v) OVER w", "CAST(v AS DOUBLE)"),
    "spread": ("spread", "max(v) - min(v)", "max(v) OVER w - min(v) OVER w", "CAST(0 AS BIGINT)"),
}


def window_agg_sql(
    strategy: str,
    bound: int,
    size: int,
    slide: int,
    offset: int = 0,
    lateness: int = 0,
    trigger: str = "FIRE",
    flush: bool = False,
    aggs: tuple[str, ...] = ("count",),
    explicit: tuple[int, int] | None = None,
    source: str | None = None,
) -> str:
    """Firings of the window operator (on-time + late refires)."""
    names = [AGGS[a][0] for a in aggs]
    group_aggs = ", ".join(f"{AGGS[a][1]} AS {AGGS[a][0]}" for a in aggs)
    run_aggs = ", ".join(f"{AGGS[a][2]} AS {AGGS[a][0]}" for a in aggs)
    single = ", ".join(f"{AGGS[a][3]} AS {AGGS[a][0]}" for a in aggs)
    key_match = "AND r.user_id = o.user_id " if strategy == "key" else ""
    if explicit:
        src = markers_cte(*explicit) + ","
        ctes = f"WITH {events_cte()}, {src} {stream_cte(bound, 'column', 'src')},"
        data_filter = "wm_mark IS NULL"
    else:
        ctes = f"WITH {events_cte(source)}, {stream_cte(bound, strategy)},"
        data_filter = "TRUE"
    late_sel = (
        f"SELECT user_id, window_start, window_end, arr_ms, event_id, {single} FROM cls WHERE cls = 'late'"
        if trigger == "FIRE_AND_PURGE"
        else f"""SELECT * EXCLUDE (c) FROM (
          SELECT user_id, window_start, window_end, arr_ms, event_id, cls AS c, {run_aggs}
          FROM cls WHERE cls IN ('on', 'late')
          WINDOW w AS (PARTITION BY user_id, window_end ORDER BY {ORDER_SQL}
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        WHERE c = 'late'"""
    )
    fired_filter = "" if flush else "WHERE trigger_arr_ms IS NOT NULL"
    return f"""{ctes}
{tagged_cte(size, slide, offset, lateness, data_filter)},
{pairs_cte(size, slide, lateness)},
onw AS (SELECT user_id, window_start, window_end, {group_aggs} FROM cls WHERE cls = 'on'
        GROUP BY user_id, window_start, window_end),
reach AS (
  SELECT o.user_id, o.window_start, r.arr_ms AS trigger_arr_ms, r.event_id AS trigger_event_id,
         row_number() OVER (PARTITION BY o.user_id, o.window_start ORDER BY r.arr_ms, r.event_id) AS rn
  FROM onw o JOIN wm r ON r.wm_after >= o.window_end - 1 {key_match}
),
fired AS (
  SELECT o.*, r.trigger_arr_ms, r.trigger_event_id FROM onw o
  LEFT JOIN (SELECT * FROM reach WHERE rn = 1) r ON r.user_id IS NOT DISTINCT FROM o.user_id
       AND r.window_start = o.window_start
),
late_fires AS ({late_sel})
SELECT user_id, window_start, window_end, window_end - 1 AS out_ts, 'on_time' AS fire,
       trigger_arr_ms, trigger_event_id, {', '.join(names)}
FROM fired {fired_filter}
UNION ALL
SELECT user_id, window_start, window_end, window_end - 1 AS out_ts, 'late' AS fire,
       arr_ms AS trigger_arr_ms, event_id AS trigger_event_id, {', '.join(names)}
FROM late_fires
"""


def rows_sql(strategy: str, bound: int, size: int, slide: int, offset: int = 0, lateness: int = 0,
             select: str = "*", where: str = "TRUE") -> str:
    """Per-row tags of the window operator (side output, drops, gaps, partly late rows)."""
    return f"""WITH {events_cte()}, {stream_cte(bound, strategy)},
{tagged_cte(size, slide, offset, lateness)}
SELECT {select} FROM tagged WHERE {where}"""
