"""Streams: golden cases cut into several runs, carried state that cannot be lost, edge values.

Every run restarts the query from the same checkpoint, so watermarks and open
windows are restored between runs.
"""

import os
import random
from collections import Counter

import pytest

from eventide.functions.aggregates import combine, sum_of
from eventide.operators.window_agg import windowed_agg
from eventide.plans.spec import FIRE, WatermarkSpec, WindowAggSpec, WindowSpec
from eventide.session import scratch_dir
from eventide.operators.late import compare_watermarks
from eventide.streaming import state
from eventide.streaming.carried import (
    carried_compare_sink, carried_late_split_sink, carried_window_sink, load_carry, read_carried, read_comparison,
)
from eventide.streaming.state import commits, last_commit, load_commit
from eventide.streaming.queries import replay
from test_golden import spec_of

PER_KEY = ["pk_sliding_reduce", "pk_tumbling_reduce", "pk_lateness_purge", "pk_cleanup_overflow",
           "pk_side_output_tumbling", "pk_side_output_sliding", "pk_cleanup_empty_state"]


def test_stream_equals_batch_on_events(spark):
    """stream_key_lateness (5 arrival slices, restarts) equals the batch operator."""
    import __spark_entry__ as entry
    from given_tables import SF_SMALL

    qs = entry.queries()
    s = qs["stream_key_lateness"](spark, SF_SMALL)
    b = qs["key_lateness_fire"](spark, SF_SMALL)
    cols = sorted(s.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(tuple, s.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


GLOBAL_CASES = ["gl_sliding_reduce", "gl_tumbling_reduce", "gl_lateness_purge", "gl_cleanup_overflow",
                "gl_side_output_tumbling", "gl_side_output_sliding", "gl_cleanup_empty_state"]


@pytest.mark.parametrize("name", GLOBAL_CASES + PER_KEY)
def test_streaming_carried_state_case(spark, cases, name):
    """Explicit and per-key watermarks through the batch operator with carried state, one run per segment."""
    case = cases[name]
    rows = [(*r, run) for run, seg in enumerate(case.segments()) for r in seg]
    src = spark.createDataFrame(rows, "seq BIGINT, k STRING, v BIGINT, ts_ms BIGINT, wm BIGINT, run BIGINT")
    spec = spec_of(case)
    out = replay(spark, src, "run", 1, lambda s: s, f"golden-{name}",
                 sink=lambda base: carried_window_sink(base, spec, "k", "ts_ms", ["seq"], sum_of("v", "total")))
    fired = Counter((r.k, r.out_ts, r.total) for r in read_carried(spark, out, "fire").collect())
    late = Counter((r.k, r.ts_ms) for r in read_carried(spark, out, "late").collect())
    dropped = sum(r.dropped for r in read_carried(spark, out, "dropped").collect())
    assert fired == Counter(case.out)
    assert late == Counter(case.late)
    assert dropped == case.dropped


def test_global_late_split_stream_demo_job(spark):
    """The global no-window demo job as a stream of two micro-batch runs (FIXTURES.md §3)."""
    from eventide.plans.spec import LONG_MIN

    rows = [(0, 1, "device1", 0), (1, 105, "device2", 0), (2, 2, "device1", 1), (3, 104, "device2", 1)]
    src = spark.createDataFrame(rows, "seq BIGINT, ts_ms BIGINT, device STRING, run BIGINT")
    cols = ["seq", "device", "ts_ms", "wm_seen", "tag"]
    out = replay(spark, src, "run", 1, lambda s: s, "demo-global-split",
                 sink=lambda base: carried_late_split_sink(base, 2, "device", "ts_ms", ["seq"], cols))
    got = sorted((r.tag, r.ts_ms, r.device, r.wm_seen) for r in read_carried(spark, out, "rows").collect())
    assert got == [("in_time", 1, "device1", LONG_MIN), ("in_time", 104, "device2", 103),
                   ("in_time", 105, "device2", -1), ("late", 2, "device1", 103)]


SPEC = WindowAggSpec(WindowSpec(1000), WatermarkSpec("key", 0), 500, FIRE, True)
SCHEMA = "seq BIGINT, k STRING, k2 INT, x DOUBLE, i BIGINT, ts_ms BIGINT, note STRING, run BIGINT"


def both():
    return combine(sum_of("x", "total"), sum_of("i", "whole"))


def window_stream(spark, rows, name, **options):
    src = spark.createDataFrame(rows, SCHEMA)
    out = replay(spark, src, "run", 1, lambda s: s, name,
                 sink=lambda base: carried_window_sink(base, SPEC, ["k", "k2"], "ts_ms", ["seq"], both(), **options))
    return src, out


def test_stream_keeps_fractions_nulls_and_the_whole_row(spark):
    big = 2**53 + 1
    rows = [(0, "a", 1, 1.9, big, 100, "p", 0), (1, "a", 1, 1.9, None, 200, "q", 0), (2, "a", 2, None, 5, 300, "r", 0),
            (3, "a", 1, 0.5, 1, None, "s", 0), (4, "a", 1, 0.25, 2, 5000, "t", 1), (5, "a", 1, 7.0, 3, 10, "late", 1),
            (6, None, 1, 1.0, 1, 100, "n", 1), (7, None, 1, 1.0, 1, 2000, "n", 1), (8, "a", 2, 1.0, 1, 9000, "u", 1)]
    src, out = window_stream(spark, rows, "edge")
    fired = {(r.k, r.k2, r.window_start): (r.total, r.whole) for r in read_carried(spark, out).collect()}
    assert fired == {("a", 1, 0): (3.8, big), ("a", 2, 0): (None, 5), (None, 1, 0): (1.0, 1)}
    late = read_carried(spark, out, "late").collect()
    assert [(r.seq, r.x, r.i, r.note, r.ts_ms) for r in late] == [(5, 7.0, 3, "late", 10)]
    batch = windowed_agg(src, SPEC, ["k", "k2"], "ts_ms", ["seq"], both())
    assert sorted(map(str, batch.output.collect())) == sorted(map(str, read_carried(spark, out).collect()))
    gauge = sorted((r.at_batch, r.lowest, r.highest) for r in read_carried(spark, out, "watermark").collect())
    assert gauge == [(0, 200, 300), (1, 2000, 9000)]


def test_stream_of_a_hot_key_equals_batch(spark):
    rng = random.Random(3)
    rows = [(n, "hot" if n % 3 == 0 else f"k{rng.randint(0, 9)}", 0, float(n % 7), n, n * 5 + rng.randint(-900, 900), "", n // 200)
            for n in range(600)]
    src, out = window_stream(spark, rows, "hot-key")
    batch = windowed_agg(src, SPEC, ["k", "k2"], "ts_ms", ["seq"], both())
    assert sorted(map(tuple, batch.output.collect())) == sorted(map(tuple, read_carried(spark, out).collect()))
    assert sorted(batch.late.select("seq").collect()) == sorted(read_carried(spark, out, "late").select("seq").collect())


def test_state_is_needed_and_damage_is_noticed(spark):
    base = scratch_dir(spark, "state")
    sink = carried_window_sink(base, SPEC, ["k", "k2"], "ts_ms", ["seq"], both())
    first = [(n, f"k{n}", 0, 1.0, 1, 100, "", 0) for n in range(40)]
    sink(spark.createDataFrame(first, SCHEMA), 0)
    sink(spark.createDataFrame([(50, "k7", 0, 1.0, 1, 3000, "", 0)], SCHEMA), 1)
    commit = load_commit(spark, base, 2)
    assert [r["rows"] for r in commit.runs["key_wm"]] == [40, 1]  # batch 1 wrote its own key alone
    carry = load_carry(spark, base, 2, ["k", "k2"], both())
    open_windows = {(r.k, r.window_start) for r in carry.windows.collect()}
    assert open_windows == {(f"k{n}", 0) for n in range(40) if n != 7} | {("k7", 3000)}  # window 0 of k7 is cleaned up
    assert {r.k: r.wm for r in carry.key_watermarks.collect()} == {**{f"k{n}": 100 for n in range(40)}, "k7": 3000}
    with pytest.raises(RuntimeError, match="needs the state of batch 4"):
        load_carry(spark, base, 5, ["k", "k2"])
    with pytest.raises(RuntimeError):
        sink(spark.createDataFrame(first, SCHEMA), 500)
    folder = commit.runs["windows"][0]["path"].removeprefix("file:")
    for name in os.listdir(folder):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(b"damaged")
    with pytest.raises(Exception):
        load_carry(spark, base, 2, ["k", "k2"], both()).windows.collect()


def split_sink(base, keys="k"):
    return carried_late_split_sink(base, 0, keys, "ts_ms", ["seq"], ["seq", "tag"], "key")


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "seq BIGINT, k STRING, ts_ms BIGINT")


def test_an_old_sink_is_refused_and_a_retried_batch_replaces_its_rows(spark):
    base = scratch_dir(spark, "old-sink")
    sink = split_sink(base)
    sink(rows_of(spark, [(0, "a", 5)]), 0)
    sink(rows_of(spark, [(0, "a", 5), (1, "b", 5)]), 0)  # Spark runs batch 0 again
    assert read_carried(spark, base, "rows").count() == 2
    sink(rows_of(spark, [(2, "a", 7)]), 1)
    with pytest.raises(RuntimeError, match="later commits"):  # a new query over the sink of another
        sink(rows_of(spark, [(0, "a", 1)]), 0)
    assert read_carried(spark, base, "rows").count() == 3


def test_a_new_query_over_an_old_sink_fails(spark, tmp_path):
    base, src = scratch_dir(spark, "sink"), str(tmp_path / "src")
    rows_of(spark, [(0, "a", 5)]).write.parquet(src)

    def run(checkpoint):
        stream = spark.readStream.schema("seq BIGINT, k STRING, ts_ms BIGINT").parquet(src)
        stream.writeStream.foreachBatch(split_sink(base)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    run("one")
    assert last_commit(spark, base).query
    with pytest.raises(Exception, match="another query"):
        run("two")
    assert read_carried(spark, base, "rows").count() == 1


def test_uncommitted_outputs_are_not_read(spark):
    base = scratch_dir(spark, "uncommitted")
    split_sink(base)(rows_of(spark, [(0, "a", 5)]), 0)
    rows_of(spark, [(9, "a", 9)]).selectExpr("seq", "'late' AS tag").write.parquet(f"{base}/rows/batch=000000001")  # a batch that died
    assert [r.seq for r in read_carried(spark, base, "rows").collect()] == [0]


def test_old_state_goes_but_never_what_a_retained_batch_needs(spark):
    base = scratch_dir(spark, "retained")
    old = spark.conf.get("spark.sql.streaming.minBatchesToRetain", None)
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    try:
        sink = split_sink(base)
        for n in range(12):
            sink(rows_of(spark, [(n, k, 100 * n) for k in (["a", "b"] if n == 0 else ["a"])]), n)
        assert sorted(os.listdir(f"{base}/state/commits".removeprefix("file:")))[-1] == "000000011.json"
        assert [c.batch for c in commits(spark, base)] == [10, 11]
        named = {r["path"].rsplit("/", 1)[1] for c in commits(spark, base) for r in c.runs["key_wm"]}
        assert set(os.listdir(f"{base}/state/key_wm".removeprefix("file:"))) >= named and len(named) < 7
        assert {r.k: r.wm for r in load_carry(spark, base, 12, "k").key_watermarks.collect()} == {"a": 1100, "b": 0}
        assert {r.k: r.wm for r in load_carry(spark, base, 11, "k").key_watermarks.collect()} == {"a": 1000, "b": 0}
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.minBatchesToRetain")
        else:
            spark.conf.set("spark.sql.streaming.minBatchesToRetain", old)


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(folder.removeprefix("file:")) for n in names if n.endswith(".parquet"))


def test_bytes_written_follow_the_batch_not_the_state(spark):
    """A million idle keys lie in the first run; batches of a hundred keys do not write them again."""
    base = scratch_dir(spark, "idle")
    sink = split_sink(base)
    sink(spark.range(1_000_000).selectExpr("id AS seq", "concat('idle', id) AS k", "id AS ts_ms"), 0)
    idle = size_of(f"{base}/state")
    for n in range(1, 8):
        sink(spark.range(100).selectExpr(f"id + {n} * 1000000 AS seq", "concat('k', id) AS k", f"id + {n} * 1000 AS ts_ms"), n)
    commit = last_commit(spark, base)
    assert size_of(f"{base}/state") - idle < idle / 50
    assert commit.runs["key_wm"][0]["rows"] == 1_000_000 and 1 < len(commit.runs["key_wm"]) <= 5
    known = load_carry(spark, base, 8, "k").key_watermarks
    assert known.count() == 1_000_100
    assert (commit.gauge["lowest"], commit.gauge["highest"]) == (0, 999_999)


def test_runs_are_merged_in_tiers(spark):
    base = scratch_dir(spark, "tiers")
    sink = carried_window_sink(base, SPEC, ["k", "k2"], "ts_ms", ["seq"], both())
    for n in range(9):
        sink(spark.createDataFrame([(n, f"k{n % 5}", 0, 1.0, 1, 100 * n, "", 0)], SCHEMA), n)
    commit = last_commit(spark, base)
    assert all(len(runs) < 5 for runs in commit.runs.values()) and any("merged" in r["path"] for r in commit.runs["windows"])
    carry = load_carry(spark, base, 9, ["k", "k2"], both())
    assert {(r.k, r.window_start): r.whole for r in carry.windows.collect()} == {("k0", 0): 2, ("k1", 0): 2, ("k2", 0): 2, ("k3", 0): 2, ("k4", 0): 1}


def test_gauge_follows_the_batch(spark, monkeypatch):
    """Lowest and highest watermark of all keys, without reading the table every batch."""
    monkeypatch.setattr(state, "LISTED_KEYS", 3)
    rng = random.Random(5)
    base = scratch_dir(spark, "gauge")
    sink = split_sink(base)
    known, reread = {}, []
    plain = state.load_runs
    monkeypatch.setattr(state, "load_runs", lambda *a: reread.append(a) or plain(*a))
    for n in range(14):
        rows = [(n * 100 + i, rng.choice([f"k{rng.randint(0, 30)}", None]), 100 * n + rng.randint(0, 900)) for i in range(rng.choice([1, 3, 25]))]
        sink(rows_of(spark, rows), n)
        for _, k, ts in rows:
            known[k] = max(ts, known.get(k, ts))
        gauge = last_commit(spark, base).gauge
        assert (gauge["lowest"], gauge["highest"]) == (min(known.values()), max(known.values())), n
    assert len(reread) < 14


def test_one_run_of_several_micro_batches(spark, tmp_path):
    """Steady running: files are taken one at a time, in one query."""
    rng = random.Random(9)
    rows = [(n, f"k{rng.randint(0, 4)}", 0, 1.0, n, n * 20 + rng.randint(-900, 900), "", 0) for n in range(300)]
    src, base = str(tmp_path / "src"), scratch_dir(spark, "steady")
    for n in range(6):
        spark.createDataFrame(rows[n * 50:n * 50 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    sink = carried_window_sink(base, SPEC, ["k", "k2"], "ts_ms", ["seq"], both())
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    assert last_commit(spark, base).batch == 5
    batch = windowed_agg(spark.createDataFrame(rows, SCHEMA), SPEC, ["k", "k2"], "ts_ms", ["seq"], both())
    assert sorted(map(str, batch.output.collect())) == sorted(map(str, read_carried(spark, base).collect()))
    assert sorted(batch.late.select("seq").collect()) == sorted(read_carried(spark, base, "late").select("seq").collect())


def test_drop_counter_comes_with_the_commit(spark):
    base = scratch_dir(spark, "drops")
    spec = WindowAggSpec(WindowSpec(1000), WatermarkSpec("global", 0))
    sink = carried_window_sink(base, spec, "k", "ts_ms", ["seq"], sum_of("seq", "s"))
    sink(rows_of(spark, [(0, "a", 5000), (1, "a", 10), (2, "b", 20)]), 0)
    sink(rows_of(spark, [(3, "a", 4000), (4, "a", 100)]), 1)
    sink(rows_of(spark, []), 2)
    got = [(r.at_batch, r.dropped, r.dropped_so_far) for r in read_carried(spark, base, "dropped").collect()]
    assert got == [(0, 2, 2), (1, 2, 4), (2, 0, 4)]
    assert [(r.lowest, r.highest) for r in read_carried(spark, base, "watermark").collect()] == [(5000, 5000)] * 3


def test_comparison_stream_after_every_slice(spark):
    rng = random.Random(2)
    rows = [(n, f"k{rng.randint(0, 3)}", n * 10 + rng.randint(-300, 300)) for n in range(200)]
    base = scratch_dir(spark, "comparison")
    sink = carried_compare_sink(base, "k", "ts_ms", ["seq"], (0, 100))
    for n, end in enumerate((50, 51, 120, 200)):
        sink(rows_of(spark, rows[(0, 50, 51, 120)[n]:end]), n)
        want = compare_watermarks(rows_of(spark, rows[:end]), "k", "ts_ms", ["seq"], (0, 100))
        assert sorted(map(str, read_comparison(spark, base).select(*want.columns).collect())) == sorted(map(str, want.collect()))
