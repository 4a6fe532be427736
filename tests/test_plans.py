"""Plan shape: what must hold at 100 TB, checked on the physical plans."""

import os

import pytest

import __spark_entry__ as entry
from eventide.functions.aggregates import count_of
from eventide.operators.window_agg import windowed_agg
from eventide.plans import prefix
from eventide.plans.spec import WatermarkSpec, WindowAggSpec, WindowSpec
from eventide.sources.events import event_stream
from given_tables import SF_SMALL


def plan_lines(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in text.splitlines():
        body = line.lstrip(" :+-")
        out.append((len(line) - len(body), body))
    return out


def single_partition_inputs_are_aggregated(df):
    """Every single-task exchange must sit on aggregated rows: on each path from it
    down to a file scan there is an aggregate."""
    lines = plan_lines(df)
    checked = 0
    for i, (ind, body) in enumerate(lines):
        if not body.startswith("Exchange SinglePartition"):
            continue
        checked += 1
        sub = []
        for ind2, body2 in lines[i + 1:]:
            if ind2 <= ind:
                break
            sub.append((ind2, body2))
        for j, (ind2, body2) in enumerate(sub):
            if "FileScan" in body2 or "Scan ExistingRDD" in body2:
                level, aggregated = ind2, False
                for ind3, body3 in reversed(sub[:j]):
                    if ind3 < level:
                        level = ind3
                        aggregated |= body3.startswith(("HashAggregate", "SortAggregate"))
                assert aggregated, f"raw rows reach a single task:\n{body2[:200]}"
    return checked


@pytest.mark.parametrize("name", ["compare_watermarks", "global_watermark", "late_split_global",
                                  "global_sliding_sum", "explicit_watermark_agg", "key_lateness_fire"])
def test_no_single_task_over_raw_rows(spark, name):
    checked = single_partition_inputs_are_aggregated(entry.queries()[name](spark, SF_SMALL))
    if name != "key_lateness_fire":
        assert checked > 0  # global scopes do have single-task scans, over one row per range


def test_scan_reads_only_needed_columns(spark):
    lines = plan_lines(entry.queries()["compare_watermarks"](spark, SF_SMALL))
    scans = [b for _, b in lines if b.startswith("FileScan parquet")]
    assert scans
    for s in scans:
        cols = s[s.index("[") + 1:s.index("]")]
        assert set(c.split("#")[0] for c in cols.split(",")) <= {"event_id", "ts", "user_id"}, s


@pytest.fixture(autouse=True)
def several_ranges(monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 100)


@pytest.mark.parametrize("name", ["key_watermark", "global_watermark"])
def test_one_shuffle_and_one_sort_of_the_rows(spark, name):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = [b for _, b in plan_lines(entry.queries()[name](spark, SF_SMALL))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    # the rows are dealt by their range; all else that is shuffled is the carries: a partial aggregate of the ranges' ends
    assert sum(b.startswith("Exchange shufflepartitionidpassthrough") for b in lines) == 1
    assert sum("Sort [_range" in b and "arr_ms" in b for b in lines) == 1
    for i, b in enumerate(lines):
        if b.startswith("Exchange hashpartitioning") or b.startswith("Exchange SinglePartition"):
            assert any("HashAggregate" in below for below in lines[i + 1:i + 3]), lines[i:i + 4]
    assert not any("SortMergeJoin" in b for b in lines)


def test_comparison_reads_the_source_twice_at_most(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = entry.queries()["compare_watermarks"](spark, SF_SMALL)
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert text.count("FileScan parquet") - text.count("ReusedExchange") <= 2, text


def _result(spark, lateness):
    spec = WindowAggSpec(WindowSpec(3_600_000), WatermarkSpec("key", 3_600_000), lateness)
    return windowed_agg(event_stream(spark, SF_SMALL), spec, "user_id", "ts_ms", ["arr_ms", "event_id"], count_of("n"))


def test_firings_store_what_they_need_once_and_release_it(spark):
    res = _result(spark, 7_200_000)
    for df in (res.rows, res.late, res.dropped):  # plain plans over the source
        df.count()
    assert res.folders == []
    scans = [b for _, b in plan_lines(res.output) if "FileScan" in b]
    assert scans and not any("events.parquet" in b for b in scans)
    (folder,) = res.folders
    stored = set(spark.read.parquet(folder).columns)
    assert stored == {"user_id", "arr_ms", "event_id", "wm_before", "wm_after", "tag", "_w_newest", "_n_on", "_n_open", "_in_n"}
    assert os.path.exists(folder.removeprefix("file:"))
    res.release()
    assert not os.path.exists(folder.removeprefix("file:"))


def test_no_late_branch_without_lateness(spark):
    lines = [b for _, b in plan_lines(_result(spark, 0).output)]
    assert not any(b.startswith(("Union", "Generate")) and "late" in b for b in lines)
    assert sum("FileScan" in b for b in lines) <= 4  # the on-time aggregate, the advancing rows and the ranges' ends of both
    assert sum("FileScan" in b for b in [b for _, b in plan_lines(_result(spark, 7_200_000).output)]) > 4
