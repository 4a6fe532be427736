"""Aggregates of every form give what a plain fold over the rows gives, in batch and in streams."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from definition import outcome
from eventide.functions import code
from eventide.functions.aggregates import combine, count_of, distinct_of, mean_of, sum_of
from eventide.functions.code import ArrowFunction, CodeAccumulator
from eventide.operators.window_agg import windowed_agg
from eventide.plans import prefix
from eventide.plans.spec import FIRE, FIRE_AND_PURGE, WatermarkSpec, WindowAggSpec, WindowSpec
from eventide.session import scratch_dir
from eventide.streaming.carried import carried_window_sink, read_carried
from eventide.streaming.state import last_commit

SCHEMA = "k STRING, seq BIGINT, ts_ms BIGINT, v BIGINT"


def listing():
    """Keeps what it was given: the sorted values and how often states were made."""
    return CodeAccumulator((("v", "v"),), "vs ARRAY<BIGINT>", "text STRING, size INT", zero=lambda: ([],),
                           add=lambda s, rows: (s[0] + rows.column("v").to_pylist(),), merge_states=lambda a, b: (list(a[0]) + list(b[0]),),
                           finish_state=lambda s: (" ".join(sorted(map(str, s[0]))), len(s[0])))


def values_of(kind, vs):
    known = [v for v in vs if v is not None]
    return {"listing": (" ".join(sorted(map(str, vs))), len(vs)), "distinct": (len(set(known)),), "distinct column": (len(set(known)),),
            "mean": (sum(known) / len(known) if known else None,), "mean column": (sum(known) / len(known) if known else None,),
            "median": (float(sorted(known)[(len(known) - 1) // 2]) if known else None,)}[kind]


KINDS = {"listing": (listing, ["text", "size"]), "distinct": (lambda: distinct_of("v", "d"), ["d"]), "distinct column": (lambda: {"d": F.count_distinct("v")}, ["d"]),
         "mean": (lambda: mean_of("v"), ["mean"]), "mean column": (lambda: {"mean": F.avg("v")}, ["mean"]),
         "median": (lambda: {"m": F.percentile_disc("v", 0.5) if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)")}, ["m"])}


def stream(seed, n=150):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "b", None]), i, i * 4 + rng.randint(-60, 60), rng.choice([None, rng.randint(0, 6), rng.randint(0, 6)])) for i in range(n)]


def expected(rows, spec, kind):
    """By the plain definition: instead of being added up, values are listed."""
    class Values(tuple):
        def __radd__(self, other):  # sum() begins with 0
            return Values((other or ()) + tuple(self)) if other else self

        def __add__(self, other):
            return Values(tuple(self) + tuple(other))

    events = [("e", seq, k, ts, Values((v,))) for k, seq, ts, v in rows]
    out, _, _ = outcome(events, "key", spec.watermark.bound, spec.window.size, spec.window.slide, 0, spec.lateness, spec.trigger == FIRE_AND_PURGE, False)
    return sorted(map(str, [(k, out_ts, fire, seq, *values_of(kind, list(vs))) for k, out_ts, vs, fire, seq in out]))


def found(df, columns):
    return sorted(map(str, map(tuple, df.select("k", "out_ts", "fire", "trigger_seq", *columns).collect())))


@pytest.mark.parametrize("range_rows", [10**6, 15])
@pytest.mark.parametrize("trigger", [FIRE, FIRE_AND_PURGE])
@pytest.mark.parametrize("kind", list(KINDS))
def test_batch(spark, monkeypatch, kind, trigger, range_rows):
    if range_rows < 100 and kind in ("mean column", "median", "distinct column"):
        pytest.skip("not cut by the aggregate")
    monkeypatch.setattr(prefix, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(code, "HELD_GROUPS", 5)
    make, columns = KINDS[kind]
    slide = 20 if kind in ("listing", "distinct") else 50
    spec = WindowAggSpec(WindowSpec(50, slide), WatermarkSpec("key", 10), 60, trigger)
    rows = stream(len(kind))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(windowed_agg(df, spec, "k", "ts_ms", ["seq"], make()).output, columns) == expected(rows, spec, kind)


@pytest.mark.parametrize("kind", ["listing", "distinct", "mean column"])
def test_stream_equals_batch(spark, kind):
    make, columns = KINDS[kind]
    spec = WindowAggSpec(WindowSpec(50, 25), WatermarkSpec("key", 10), 60, FIRE)
    rows, base = stream(5), scratch_dir(spark, "aggregates")
    sink = carried_window_sink(base, spec, "k", "ts_ms", ["seq"], make())
    for n in range(6):
        sink(spark.createDataFrame(rows[n * 25:n * 25 + 25], SCHEMA), n)
    assert found(read_carried(spark, base), columns) == expected(rows, spec, kind)
    assert any("merged" in r["path"] for r in last_commit(spark, base).runs["windows"])


def test_the_distinct_count_meets_no_pairs_of_rows(spark):
    """Late refires of different values: no join of a window's late rows with its rows."""
    spec = WindowAggSpec(WindowSpec(10**6), WatermarkSpec("key", 0), 10**9)
    rows = [("hot", i, 10**6 + 5 if i == 1000 else i, i % 700) for i in range(3000)]  # one window, 2,000 late rows
    out = windowed_agg(spark.createDataFrame(rows, SCHEMA), spec, "k", "ts_ms", ["seq"], distinct_of("v", "d")).output
    late = sorted((r.trigger_seq, r.d) for r in out.where("fire = 'late'").collect())
    assert late == [(i, 700) for i in range(1001, 3000)]
    text = out._jdf.queryExecution().toString()
    assert "_at_seq" not in text


def test_a_hot_window_of_code_is_spread(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 100)
    xor = CodeAccumulator((("v", "v"),), "x BIGINT", "x BIGINT", zero=lambda: (0,), add=lambda s, rows: (s[0] ^ int(np.bitwise_xor.reduce(rows.column(0).to_numpy())),),
                          merge_states=lambda a, b: (a[0] ^ b[0],), finish_state=lambda s: s)
    spec = WindowAggSpec(WindowSpec(10**6), WatermarkSpec("key", 0), 10**9)
    rows = [("hot", i, 10**6 + 5 if i == 1 else i, i * 7919) for i in range(2000)]
    out = windowed_agg(spark.createDataFrame(rows, SCHEMA), spec, "k", "ts_ms", ["seq"], xor).output
    assert "shufflepartitionidpassthrough" in out._jdf.queryExecution().toString()
    want, held = [], 0
    for i in range(2000):
        if i != 1:
            held ^= i * 7919
            want += [(i, held)] if i > 1 else []
    assert sorted((r.trigger_seq, r.x) for r in out.where("fire = 'late'").collect()) == want


def test_window_function_in_python_gives_any_number_of_rows(spark):
    def repeat(firings: pa.RecordBatch) -> pa.RecordBatch:
        at = np.repeat(np.arange(firings.num_rows), firings.column("n").to_numpy() - 1)
        return pa.RecordBatch.from_arrays([firings.column("k").take(pa.array(at)), pa.array(at * 0 + 7)], names=["k", "seven"])

    spec = WindowAggSpec(WindowSpec(100), WatermarkSpec("key", 0), flush=True)
    rows = [("a", 0, 1, 1), ("a", 1, 2, 1), ("a", 2, 3, 1), ("b", 3, 1, 1), (None, 4, 5, 1), (None, 5, 6, 1)]
    fn = ArrowFunction(repeat, "k STRING, seven INT")
    for df, want in ((spark.createDataFrame(rows, SCHEMA), [("a", 7), ("a", 7), (None, 7)]), (spark.createDataFrame([], SCHEMA), [])):
        out = windowed_agg(df, spec, "k", "ts_ms", ["seq"], combine(count_of("n"), sum_of("v", "t")), window_fn=fn).output
        assert out.columns == ["k", "seven"] and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_other_aggregates_are_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="aggregate must be"):
        windowed_agg(df, WindowAggSpec(WindowSpec(1)), "k", "ts_ms", ["seq"], {})
    with pytest.raises(ValueError, match="aggregate must be"):
        windowed_agg(df, WindowAggSpec(WindowSpec(1)), "k", "ts_ms", ["seq"], F.sum("v"))
