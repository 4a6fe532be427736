"""Streams as the batch operators with carried state.

Every micro-batch runs the batch operator with what earlier batches left: the
watermark (global, explicit) or the watermarks of its keys, and what they contributed to windows.
So a stream has every feature of the batch operator - several keys, any mergeable
aggregate and value type, result expressions, window functions, the whole input
row in the side output - and a hot key is split over tasks as in batch. A batch writes

    <base>/fire/batch=N       firings (on-time and late refires)
    <base>/late/batch=N       side output
    <base>/rows/batch=N       rows of a late split
    <base>/late_counts/batch=N  late rows per strategy and bound (comparison)

then what it adds to the state, and last its commit (``streaming/state.py``), which also holds the
drop counter and the gauge. A retried batch overwrites its own folders, and only committed
batches are read, so the sink is exactly-once. As many commits are kept as the checkpoint keeps batches
(``spark.sql.streaming.minBatchesToRetain``): any batch that Spark can run again finds its state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventide.functions.aggregates import Accumulator
from eventide.functions.code import ArrowFunction
from eventide.functions.int64 import lit_long, saturating_add
from eventide.operators.late import compare_watermarks, late_split
from eventide.operators.watermark import as_list
from eventide.operators.window_agg import Carry, merged_windows, windowed_agg
from eventide.plans.reach import null_safe_join
from eventide.plans.spec import FIRE, WatermarkSpec, WindowAggSpec
from eventide.streaming.expiry import Expiry
from eventide.streaming.state import Commit, Save, commits, last_commit, load_commit, load_runs, together


def _carry(spark: SparkSession, commit: Commit | None) -> Carry:
    return Carry(watermark=commit.wm if commit else None, windows=load_runs(spark, commit, "windows"),
                 key_watermarks=load_runs(spark, commit, "key_wm"))


def load_carry(spark: SparkSession, base: str, batch_id: int, key: str | Sequence[str], acc: Accumulator | None = None) -> Carry:
    """State for ``batch_id``, merged: the watermarks of all keys and the open windows, one row each."""
    commit, keys = load_commit(spark, base, batch_id), as_list(key)
    carry = _carry(spark, commit)
    if carry.key_watermarks is not None:
        carry.key_watermarks = carry.key_watermarks.groupBy(*keys).agg(F.max("wm").alias("wm"))
    if carry.windows is not None and acc is not None:
        windows = merged_windows(carry.windows, keys, acc)
        if carry.key_watermarks is not None:
            windows = null_safe_join(windows, carry.key_watermarks.select(*keys, F.col("wm").alias("_wm")), keys, "left")
        else:
            windows = windows.withColumn("_wm", F.lit(commit.wm).cast("bigint"))
        carry.windows = _alive(windows, commit.horizon).drop("_wm")
    return carry


def _alive(windows: DataFrame, horizon: int) -> DataFrame:
    """Windows that the watermark ``_wm`` of their scope has not passed for good."""
    return windows.filter(F.coalesce(saturating_add(F.col("window_end") - 1, horizon) > F.col("_wm"), F.lit(True)))


def _largest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda runs: runs.groupBy(*keys).agg(F.max("wm").alias("wm"))


def carried_window_sink(base: str, spec: WindowAggSpec, key: str | Sequence[str], ts: str, order: Sequence[str],
                        acc, window_fn: Callable[[dict[str, Column]], Column] | ArrowFunction | None = None,
                        emit: str = "pass", expire_after: int | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function running the window operator with carried state.

    expire_after: with per-key watermarks, forget keys that have not arrived for so long, in the unit of the
    first ``order`` column (an integer; ``streaming/expiry.py``). By default, as in the batch operator, idle keys stay.

    ``acc`` (any aggregate), ``window_fn`` and ``emit`` as in ``windowed_agg``. The watermarked rows of a batch are stored once in
    ``<base>/work``, overwritten by every batch; outputs and state are made from them.
    """
    keys = as_list(key)
    scope = keys if spec.watermark.strategy == "key" else []
    horizon = spec.lateness if spec.trigger == FIRE else 0
    if expire_after is not None and (not scope or expire_after < 0):
        raise ValueError("expire_after is for per-key watermarks and cannot be negative")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = load_commit(spark, base, batch_id)
        save = Save(spark, base, batch_id, before, horizon=horizon)
        expiry = Expiry(save, before, keys, order[0], expire_after) if expire_after is not None else None
        carry = _carry(spark, before)
        if expiry:
            carry.windows, carry.key_watermarks = expiry.live(carry.windows), expiry.live(carry.key_watermarks)
        res = windowed_agg(batch, spec, keys, ts, order, acc, window_fn=window_fn, emit=emit, carry=carry, work_folder=f"{base}/work")
        name = f"batch={batch_id:09d}"
        save.commit.wm = res.watermark

        def known() -> DataFrame:
            """The watermarks of the keys that are not gone."""
            rows = load_runs(spark, save.commit, "key_wm")
            return expiry.live(rows) if expiry else rows

        def merge_windows(runs: DataFrame) -> DataFrame:
            """One row per window; windows that are past their cleanup go before that."""
            if scope:
                runs = null_safe_join(runs, _largest(keys)(known()).withColumnRenamed("wm", "_wm"), keys, "left")
            else:
                runs = runs.withColumn("_wm", F.lit(res.watermark).cast("bigint"))
            return merged_windows(_alive(runs, horizon).drop("_wm"), keys, res.aggregate)

        merges = {"key_wm": _largest(keys), "windows": merge_windows}
        if expiry:
            merges = {n: expiry.merging(m) for n, m in merges.items()}
        dated = expiry.dated if expiry else lambda rows: rows

        def outputs() -> None:
            res.output.write.mode("overwrite").parquet(f"{base}/fire/{name}")
            if batch_id == 0 or (spec.side_output and res.counts["late"]):  # batch 0 also shows the columns
                res.late.write.mode("overwrite").parquet(f"{base}/late/{name}")

        def watermarks() -> None:
            if scope:
                run = save.add("key_wm", dated(res.added_watermarks))
                save.gauge_keys(run, keys, known, bool(expiry and expiry.went))
            else:
                save.gauge_one(res.watermark)

        together(outputs, watermarks, lambda: save.add("windows", dated(res.added)))
        for table in ["key_wm"] * bool(scope) + ["windows"]:
            save.merge(table, merges[table])
        late = res.counts["late"]
        dropped = 0 if spec.side_output else late
        so_far = dropped + (before.counters.get("dropped_so_far", 0) if before else 0)
        counters = {"rows": res.counts["rows"], "late": late - dropped, "dropped": dropped, "dropped_so_far": so_far}
        save.finish({**counters, **(expiry.finish(batch, merges) if expiry else {})})

    return write


def carried_late_split_sink(base: str, bound: int, key: str | Sequence[str], ts: str, order: Sequence[str], columns: Sequence[str],
                            strategy: str = "global") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for the late split (C1 per key, C2 global): the
    watermark(s) are carried from batch to batch; rows go to ``<base>/rows/batch=N``."""
    spec, keys = WatermarkSpec(strategy, bound), as_list(key)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = load_commit(spark, base, batch_id)
        known = load_runs(spark, before, "key_wm")
        split = late_split(batch, spec, keys, ts, order, start_watermark=before.wm if before and strategy == "global" else None,
                           start_watermarks=_largest(keys)(known) if known is not None else None)
        seen = Observation()
        split = split.observe(seen, F.max("wm_after").alias("wm"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("tag") == "late").alias("late"))

        def rows() -> None:
            split.select(*columns).write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id:09d}")

        if strategy == "global":
            rows()
            found = [x for x in (seen.get["wm"], before.wm if before else None) if x is not None]
            save = Save(spark, base, batch_id, before, max(found, default=None))
            save.gauge_one(save.commit.wm)
        else:
            save = Save(spark, base, batch_id, before)
            top = F.try_subtract(F.max(ts), lit_long(bound)).alias("wm")  # a watermark is the largest event time so far minus the bound
            together(rows, lambda: save.gauge_keys(save.add("key_wm", batch.groupBy(*keys).agg(top).where("wm IS NOT NULL")), keys))
            save.merge("key_wm", _largest(keys))
        save.finish({"rows": seen.get["rows"], "late": seen.get["late"]})

    return write


def carried_compare_sink(base: str, key: str | Sequence[str], ts: str, order: Sequence[str], bounds: Sequence[int]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for the strategy comparison (C4): both watermarks are carried together.

    A watermark is the largest event time so far minus a bound, so one largest event time per key and one over
    all rows serve every bound. ``<base>/late_counts/batch=N`` has the batch's counts per strategy and bound;
    they add up (``read_comparison``).
    """
    keys = as_list(key)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = load_commit(spark, base, batch_id)
        known = load_runs(spark, before, "key_wm")
        found = compare_watermarks(batch, keys, ts, order, bounds, start=before.wm if before else None,
                                   start_of_keys=_largest(keys)(known) if known is not None else None)
        own = batch.groupBy(*keys).agg(F.max(ts).alias("wm")).where("wm IS NOT NULL")
        save = Save(spark, base, batch_id, before)
        together(lambda: found.write.mode("overwrite").parquet(f"{base}/late_counts/batch={batch_id:09d}"),
                 lambda: save.gauge_keys(save.add("key_wm", own), keys))
        save.merge("key_wm", _largest(keys))
        save.commit.wm = save.commit.gauge["highest"]  # the largest event time of all keys
        save.finish({})

    return write


def read_carried(spark: SparkSession, base: str, what: str = "fire") -> DataFrame:
    """Read one output (fire / late / rows / late_counts, dropped / watermark) of a carried-state stream: of committed
    batches only. ``dropped`` and ``watermark`` are of the commits that are kept."""
    if what in ("dropped", "watermark"):
        kept = commits(spark, base)
        if what == "dropped":
            rows = [(c.counters["dropped"], c.counters["dropped_so_far"], c.batch) for c in kept]
            return spark.createDataFrame(rows, "dropped BIGINT, dropped_so_far BIGINT, at_batch INT")
        return spark.createDataFrame([(c.gauge.get("lowest"), c.gauge.get("highest"), c.batch) for c in kept], "lowest BIGINT, highest BIGINT, at_batch INT")
    last = last_commit(spark, base)
    return spark.read.parquet(f"{base}/{what}").where(F.col("batch") <= (last.batch if last else -1)).drop("batch")


def read_comparison(spark: SparkSession, base: str) -> DataFrame:
    """The counts of a comparison stream so far, as ``compare_watermarks`` has them."""
    sums = read_carried(spark, base, "late_counts").groupBy("strategy", "bound_ms").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_late").alias("n_late"))
    return sums.select("*", (F.col("n_rows") - F.col("n_late")).alias("n_in_time"), (F.col("n_late") / F.col("n_rows")).alias("late_ratio"))
