"""Windowed aggregation under a per-key, global or explicit watermark.

In closed form over (row, window) pairs with ``max_ts = window_end - 1`` and the
watermark the row saw (``wm_before``):

    drop  if wm_before >= max_ts + lateness   (saturating at Long.MAX)
    late  if wm_before >= max_ts               (refire at this row; impossible with lateness 0)
    on    otherwise                            (part of the on-time firing)

* on-time firing: aggregate of the 'on' pairs per (key, window), emitted when
  some row's ``wm_after`` reaches ``max_ts`` (the first such row is the
  ``trigger``), or at end of input with ``flush``;
* late refire, one per 'late' pair: FIRE = the 'on' aggregate plus the running
  aggregate of the window's late pairs up to the row; FIRE_AND_PURGE = the row
  alone;
* a row with no accepted window is late iff ``ts + lateness <= wm_before``
  (Java wrap-around), else a gap row that is ignored.

A row's windows, newest first, are 'on', then 'late', then dropped, so two counts
per row say it all. Mergeable aggregates are computed per (key, newest window,
number of on-time windows) before the groups, not the rows, are exploded. What an aggregate
keeps of rows, and how late rows are added, is its own matter (``functions/aggregates.py``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventide.functions.aggregates import Accumulator, ColumnAggregate, DistinctCount
from eventide.functions.code import ArrowFunction, CodeAccumulator
from eventide.functions.int64 import ceil_div, lit_long, min_long_or, saturating_add, wrapping_add_le
from eventide.operators.watermark import as_list, scope_keys, with_watermarks
from eventide.operators.windows import explode_windows, with_window_geometry
from eventide.plans.materialize import delete, materialize
from eventide.plans.reach import first_reaching, null_safe_join
from eventide.plans.spec import FIRE_AND_PURGE, LONG_MAX, WindowAggSpec

IN_WINDOW, LATE, GAP = "in_window", "late", "gap"
ON_TIME_FIRE, LATE_FIRE = "on_time", "late"


@dataclass
class Carry:
    """State carried into one micro-batch.

    watermark: the scope's watermark after all earlier batches (None = none yet).
    windows: what earlier batches contributed to windows: keys, window_start, window_end and
    one column per accumulator field, any number of rows per window (None = nothing).
    """

    watermark: int | None = None
    windows: DataFrame | None = None
    key_watermarks: DataFrame | None = None
    """Per-key watermark strategy: keys and ``wm``, any number of rows per key: the largest counts."""


@dataclass
class WindowAggResult:
    """Outputs of one window aggregation.

    ``rows``, ``late`` and ``dropped`` are plain plans over the input and store
    nothing. ``output`` reads the watermarked rows several times, so it writes what
    it needs of them once, when it is first asked for; ``release`` deletes that.
    """

    rows: DataFrame
    """Every data row with wm_before, wm_after, wm_seen, n_windows, n_dropped_windows, tag."""
    late: DataFrame
    """Side output: rows accepted by no window and late (only with side_output)."""
    dropped: DataFrame
    """One row, ``dropped``: late rows counted instead of side-output (numLateRecordsDropped)."""
    build: Callable[[], DataFrame] = field(repr=False)
    folders: list[str] = field(default_factory=list, repr=False)
    state: DataFrame | None = None
    """With a carry: what earlier input and this one contribute to windows that can still fire or refire (same layout as
    ``Carry.windows``; older windows may be there in part)."""
    watermark: int | None = None
    """With a carry: the scope's watermark after this input."""
    key_watermarks: DataFrame | None = None
    """With a carry and per-key watermarks: keys and ``wm`` of earlier input and this one, the largest counts."""
    added: DataFrame | None = None
    """With a carry: the part of ``state`` that this input adds."""
    added_watermarks: DataFrame | None = None
    """With a carry and per-key watermarks: ``wm`` after this input of the keys in it."""
    aggregate: object = None
    """With a carry: the aggregate, which can merge states."""
    counts: dict[str, int] | None = None
    """With a carry: ``late`` rows (side output or dropped) and ``rows`` of this input."""

    @cached_property
    def output(self) -> DataFrame:
        """Firings: keys, window_start, window_end, out_ts, fire, trigger_<order>, results."""
        return self.build()

    def release(self) -> None:
        """Delete what ``output`` has stored; it cannot be read afterwards."""
        delete(self.rows.sparkSession, self.folders)
        self.folders.clear()


def _open_windows(spec: WindowAggSpec, lateness: int) -> Column:
    """How many of a row's windows, newest first, have ``max_ts + lateness`` above ``wm_before``."""
    w, n, wm = spec.window, F.col("n_windows"), F.col("wm_before")
    ahead = F.try_subtract(F.col("_w_newest") + lit_long(w.size - 1), wm)
    reach = F.try_add(ahead, lit_long(lateness))
    some = F.least(F.greatest(ceil_div(reach, w.slide), lit_long(0)), n)
    return (
        F.when(wm.isNull() | (n == 0), n)
        .when(wm == lit_long(LONG_MAX), lit_long(0))  # cleanup times saturate there
        .when(ahead.isNull(), F.when(wm < 0, n).otherwise(lit_long(0)))
        .when(reach.isNull(), n)
        .otherwise(some)
    )


def windowed_agg(
    df: DataFrame,
    spec: WindowAggSpec,
    key: str | Sequence[str],
    ts: str,
    order: Sequence[str],
    aggregate: Accumulator | DistinctCount | CodeAccumulator | dict[str, Column],
    window_fn: Callable[[dict[str, Column]], Column] | ArrowFunction | None = None,
    emit: str = "pass",
    materialize_rows: str = "table",
    carry: Carry | None = None,
    work_folder: str | None = None,
) -> WindowAggResult:
    """Aggregate ``df`` per key and event-time window under ``spec``.

    df: data rows (plus watermark marker rows for the 'column' strategy) with
    the key, a BIGINT event time ``ts`` and a total arrival ``order``.
    aggregate: an accumulator (``functions/aggregates.py``, ``functions/code.py``) or ``{name: aggregate Column}``.
    emit: 'pass' (keys and results, G4) or 'enrich' (window_end first, G5).
    window_fn: G6, maps the firing's columns to an array of structs, one output
    row per element (0..n), or an :class:`ArrowFunction` over batches of firings.
    materialize_rows: 'table' writes the watermarked rows that the firings need once,
    to the checkpoint folder; 'checkpoint' or 'none' (lazy) also work.
    carry: continue from earlier input (micro-batches of a stream): the input
    starts from the carried watermark(s) and windows, and the result holds what it
    adds to them. No end-of-input flush then.
    work_folder: where intermediate tables are (over)written; a stream passes one
    folder for all its micro-batches so storage stays bounded.
    """
    keys, order = as_list(key), as_list(order)
    w, lateness = spec.window, spec.lateness
    wm_spec = spec.watermark
    scope = scope_keys(wm_spec, keys)
    if isinstance(aggregate, dict) and aggregate:
        acc = ColumnAggregate(aggregate, tuple(df.columns))
    elif isinstance(aggregate, (Accumulator, DistinctCount, CodeAccumulator)):
        acc = aggregate
    else:
        raise ValueError("aggregate must be an accumulator or a non-empty {name: Column} dict")
    if emit not in ("pass", "enrich"):
        raise ValueError(f"emit must be 'pass' or 'enrich', not {emit!r}")
    base = df.select("*", *acc.inputs())
    marked = with_watermarks(base, wm_spec, keys, ts, order)
    if carry is not None:
        if scope and carry.key_watermarks is not None:  # each key continues from its own watermark
            kw = carry.key_watermarks.groupBy(*scope).agg(F.max("wm").alias("_wm0"))
            marked = null_safe_join(marked, kw, scope, "left")
        else:
            marked = marked.withColumn("_wm0", F.lit(None if scope else carry.watermark).cast("bigint"))
        marked = marked.withColumn("wm_before", F.greatest("_wm0", "wm_before")).withColumn("wm_after", F.greatest("_wm0", "wm_after"))

    # ---- per row: accepted by some window / late / gap; its on-time and its open windows ----
    marked = with_window_geometry(marked, ts, w)
    marked = marked.withColumn("_n_open", _open_windows(spec, lateness)).withColumn("_n_on", _open_windows(spec, 0))
    elem_late = F.coalesce(wrapping_add_le(F.col(ts), lateness, F.col("wm_before")), F.lit(False))
    marked = marked.withColumn(
        "tag", F.when(F.col("_n_open") > 0, F.lit(IN_WINDOW)).when(elem_late, F.lit(LATE)).otherwise(F.lit(GAP))
    ).withColumn("n_dropped_windows", F.col("n_windows") - F.col("_n_open"))
    folders: list[str] = []

    def is_data() -> Column:
        return F.col(wm_spec.marker).isNull() if wm_spec.strategy == "column" else F.lit(True)

    def data(df: DataFrame) -> DataFrame:
        return df.filter(is_data()) if wm_spec.strategy == "column" else df

    seen: dict = {}
    if carry is not None:  # a stream uses every output and the state: store the rows once, with all columns
        metrics = Observation()
        marked = marked.observe(metrics, F.max("wm_after").alias("wm"), F.count(F.lit(1)).alias("all"), F.count_if(is_data()).alias("rows"),
                                F.count_if(is_data() & (F.col("tag") == LATE)).alias("late"))
        marked = materialize(marked, "table", "window-rows", work_folder, folders)
        seen = metrics.get

    win = [*keys, "window_start", "window_end"]
    purge = spec.trigger == FIRE_AND_PURGE

    def on_time(taken: DataFrame) -> DataFrame:
        """The state of the on-time pairs, per window."""
        some = taken.filter(F.col("_n_on") > 0)
        if w.slide >= w.size:  # one window per row at most
            return acc.increments(some.withColumn("window_start", F.col("_w_newest")).withColumn(
                "window_end", F.col("window_start") + lit_long(w.size)), win)
        groups = acc.increments(some, [*keys, "_w_newest", "_n_on"])
        return acc.merge(explode_windows(groups, w, count="_n_on"), win)

    def firings(table: DataFrame) -> DataFrame:
        """On-time and late firings of the stored rows."""
        taken = data(table).filter(F.col("tag") == IN_WINDOW)
        states = on_time(taken)
        if carry is not None and carry.windows is not None:
            states = acc.merge(states.unionByName(_carried(carry, states, table, scope, seen["wm"], 0 if purge else lateness)), win)
        on = acc.summary(states, win).withColumn("max_ts", F.col("window_end") - 1)
        if scope:
            reached = first_reaching(table, scope, order, "wm_before", "wm_after", on, "max_ts", F.try_add("_w_newest", lit_long(w.size - 1)),
                                     n_rows=seen.get("all"))
        else:  # all keys' windows of one end fire at the same row: it is searched for once per end
            own = taken.filter(F.col("_n_on") > 0).select("_w_newest", "_n_on").distinct()
            ends = explode_windows(own, w, count="_n_on").select("max_ts")
            if carry is not None and carry.windows is not None:
                earlier = _carried(carry, states, table, scope, seen["wm"], 0 if purge else lateness)
                ends = ends.union(earlier.select((F.col("window_end") - 1).alias("max_ts")))
            reached = on.join(first_reaching(table, scope, order, "wm_before", "wm_after", ends.distinct(), "max_ts", few=True), "max_ts")
        if not spec.flush or carry is not None:  # also leaves out carried windows that fired before
            reached = reached.filter(F.col(f"trigger_{order[0]}").isNotNull())
        on_emit = shape(reached.withColumn("fire", F.lit(ON_TIME_FIRE)))
        if not lateness:  # a window past its end is past its cleanup
            return on_emit
        late_pairs = explode_windows(taken, w, first="_n_on", count="_n_open")
        late_acc = acc.alone(late_pairs, win, order) if purge else acc.refires(late_pairs, states, win, order)
        late_emit = late_acc.withColumn("fire", F.lit(LATE_FIRE)).withColumnsRenamed({o: f"trigger_{o}" for o in order})
        return on_emit.unionByName(shape(late_emit))

    triggers = [f"trigger_{o}" for o in order]
    head = [*keys, "window_start", "window_end", (F.col("window_end") - 1).alias("out_ts"), "fire", *triggers]

    def shape(emitted: DataFrame) -> DataFrame:
        return acc.finish(emitted, head)

    def finish(output: DataFrame) -> DataFrame:
        if isinstance(window_fn, ArrowFunction):
            return window_fn.apply(output)
        if window_fn is not None:
            env = {c: F.col(c) for c in output.columns}
            exploded = output.select(*head[:3], "out_ts", "fire", *triggers, F.explode(window_fn(env)).alias("_wf"))
            return exploded.select("*", "_wf.*").drop("_wf")
        if emit == "enrich":
            return output.select("window_end", *keys, *acc.result_names, "window_start", "out_ts", "fire", *triggers)
        return output

    def stored() -> DataFrame:
        """The rows, only the columns that the firings need, written once."""
        marker = [wm_spec.marker] if wm_spec.strategy == "column" else []
        own = list(acc.columns) if isinstance(acc, ColumnAggregate) else [c for c in marked.columns if c.startswith("_in_")]
        needed = [*keys, *order, *marker, "wm_before", "wm_after", "tag", "_w_newest", "_n_on", "_n_open", *own]
        table = marked.select(*dict.fromkeys(needed))
        return materialize(table, materialize_rows, "window-rows", work_folder, folders)

    rows = data(marked)
    helper = [c for c in rows.columns if c.startswith("_in_") or c in ("_w_newest", "_n_on", "_n_open", "_wm0")]
    rows = rows.withColumn("wm_seen", min_long_or(F.col("wm_before"))).drop(*helper)
    late = rows.filter(F.col("tag") == LATE) if spec.side_output else rows.filter(F.lit(False))
    dropped = rows.agg(
        F.count_if(F.lit(not spec.side_output) & (F.col("tag") == LATE)).cast("bigint").alias("dropped")
    )
    if carry is None:
        return WindowAggResult(rows=rows, late=late, dropped=dropped, folders=folders,
                               build=lambda: finish(firings(stored())))

    # ---- what this input adds to the state: rows with a window that is not past its cleanup after this input ----
    new_kw = marked.groupBy(*scope).agg(F.max("wm_after").alias("wm")).filter(F.col("wm").isNotNull()) if scope else None
    wm = None if scope else seen["wm"] if seen["wm"] is not None else carry.watermark
    taken = data(marked).filter(F.col("tag") == IN_WINDOW)
    if scope:
        taken = null_safe_join(taken, new_kw.withColumnRenamed("wm", "_wm_to"), scope, "left")
    else:
        taken = taken.withColumn("_wm_to", F.lit(wm).cast("bigint"))
    last = F.try_add("_w_newest", lit_long(w.size - 1))
    taken = taken.filter(F.coalesce(saturating_add(last, 0 if purge else lateness) > F.col("_wm_to"), F.lit(True))).drop("_wm_to")
    state = on_time(taken)
    if lateness and not purge:  # cumulative refires: the state also holds the late rows
        late_pairs = explode_windows(taken, w, first="_n_on", count="_n_open")
        state = acc.merge(state.unionByName(acc.increments(late_pairs, win)), win)
    return WindowAggResult(rows=rows, late=late, dropped=dropped, build=lambda: finish(firings(marked)), folders=folders,
                           state=state if carry.windows is None else carry.windows.select(*state.columns).unionByName(state), watermark=wm,
                           key_watermarks=new_kw if new_kw is None or carry.key_watermarks is None
                           else carry.key_watermarks.select(*new_kw.columns).unionByName(new_kw),
                           added=state, added_watermarks=new_kw, aggregate=acc, counts={"rows": seen["rows"], "late": seen["late"]})


def merged_windows(windows: DataFrame, keys: Sequence[str], acc) -> DataFrame:
    """Rows like ``Carry.windows``, merged: one per window (``DistinctCount``: and value; Columns: all rows)."""
    return acc.merge(windows, [*keys, "window_start", "window_end"])


def _carried(carry: Carry, states: DataFrame, table: DataFrame, scope: list[str], wm: int | None, horizon: int) -> DataFrame:
    """Carried windows that this input can fire or refire: those between the watermarks (of their key) before the
    input, less ``horizon``, and after it."""
    kinds = {f.name: f.dataType for f in states.schema.fields}
    carried = carry.windows.select(*[F.col(n).cast(kinds[n]).alias(n) for n in states.columns])
    last = F.col("window_end") - 1
    open_at = lambda before: F.coalesce(saturating_add(last, horizon) > before, F.lit(True))
    if not scope:
        return carried.filter((last <= F.lit(wm).cast("bigint")) & open_at(F.lit(carry.watermark).cast("bigint")))
    moved = table.groupBy(*scope).agg(F.max("_wm0").alias("_wm_from"), F.max("wm_after").alias("_wm_to"))
    near = null_safe_join(carried, moved, scope, "inner").filter((last <= F.col("_wm_to")) & open_at(F.col("_wm_from")))
    return near.select(*states.columns)
