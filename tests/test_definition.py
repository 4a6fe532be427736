"""Closed form of the window operator vs a plain definition, random cases.

Covers what the reference's own tests leave out: FIRE with late refires,
gaps (slide > size), offsets, negative event times, the drop counter, the
firing moment (trigger), flush, and the explicit-watermark mode.
"""

import random
from collections import Counter

import pytest

from eventide.functions.aggregates import sum_of
from eventide.operators.window_agg import windowed_agg
from eventide.plans import prefix
from eventide.plans.spec import FIRE, FIRE_AND_PURGE, WatermarkSpec, WindowAggSpec, WindowSpec
from definition import outcome

@pytest.fixture(autouse=True)
def several_ranges(monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 12)


SCHEMA = "seq BIGINT, k STRING, v INT, ts_ms BIGINT, wm BIGINT"


def random_params(rng):
    size = rng.choice([1000, 2000, 3000])
    slide = rng.choice([size, size // 2, size // 3, size * 2, 700])
    offset = rng.choice([0, 0, slide // 3, -(slide // 4)])
    return dict(
        bound=rng.choice([0, 1, 500, 2000]),
        size=size,
        slide=slide,
        offset=offset,
        lateness=rng.choice([0, 1, 700, 2500]),
        purge=rng.random() < 0.5,
        side_output=rng.random() < 0.5,
    )


def random_stream(rng, prefix, n, explicit=False, seq0=0):
    events, seq, wm = [], seq0, -4000
    base = rng.randint(-3000, 3000)
    for _ in range(n):
        if explicit and rng.random() < 0.25:
            wm += rng.randint(0, 1500)
            events.append(("w", seq, wm))
        else:
            key = f"{prefix}{rng.choice('abc')}"
            events.append(("e", seq, key, base + rng.randint(-2500, 9000), rng.randint(1, 5)))
            base += rng.randint(-200, 400)
        seq += 1
    return events


def rows_of(events):
    out = []
    for ev in events:
        if ev[0] == "w":
            out.append((ev[1], None, None, None, ev[2]))
        else:
            out.append((ev[1], ev[2], ev[4], ev[3], None))
    return out


def closed_form(spark, events, mode, p, flush):
    strategy = {"key": "key", "global": "global", "explicit": "column"}[mode]
    spec = WindowAggSpec(
        WindowSpec(p["size"], p["slide"], p["offset"]),
        WatermarkSpec(strategy, p["bound"] if mode != "explicit" else 0,
                      marker="wm" if mode == "explicit" else None),
        p["lateness"], FIRE_AND_PURGE if p["purge"] else FIRE, p["side_output"], flush,
    )
    res = windowed_agg(spark.createDataFrame(rows_of(events), SCHEMA), spec, "k", "ts_ms", ["seq"],
                       sum_of("v", "total"))
    out = Counter((r.k, r.out_ts, r.total, r.fire, r.trigger_seq) for r in res.output.collect())
    late = Counter((r.k, r.ts_ms) for r in res.late.collect())
    return out, late, res.dropped.collect()[0].dropped


@pytest.mark.parametrize("seed", range(6))
def test_per_key_matches_definition(spark, seed):
    rng = random.Random(seed)
    p = random_params(rng)
    events, seq = [], 0
    for s in range(4):  # independent streams under distinct key prefixes, one job
        part = random_stream(rng, f"s{s}", 40, seq0=seq)
        seq += len(part)
        events += part
    flush = seed % 3 == 0
    exp_out, exp_late, exp_dropped = outcome(events, "key", p["bound"], p["size"], p["slide"], p["offset"],
                                              p["lateness"], p["purge"], p["side_output"], flush)
    out, late, dropped = closed_form(spark, events, "key", p, flush)
    assert out == Counter(exp_out), p
    assert late == Counter(exp_late), p
    assert dropped == exp_dropped, p


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("mode", ["global", "explicit"])
def test_global_and_explicit_match_simulation(spark, seed, mode):
    rng = random.Random(100 + seed)
    p = random_params(rng)
    events = random_stream(rng, "", 60, explicit=mode == "explicit")
    flush = mode == "global" and seed % 2 == 0
    bound = p["bound"] if mode == "global" else 0
    exp_out, exp_late, exp_dropped = outcome(events, mode, bound, p["size"], p["slide"], p["offset"],
                                              p["lateness"], p["purge"], p["side_output"], flush)
    out, late, dropped = closed_form(spark, events, mode, p, flush)
    assert out == Counter(exp_out), p
    assert late == Counter(exp_late), p
    assert dropped == exp_dropped, p


def test_fire_mode_has_cumulative_late_refires(spark):
    # window [0, 2000) fires at 1999 with 2 rows; two late rows refire cumulatively (3, then 4)
    events = [("e", 0, "k", 100, 1), ("e", 1, "k", 500, 1), ("e", 2, "k", 2500, 1),
              ("e", 3, "k", 1000, 1), ("e", 4, "k", 1500, 1)]
    p = dict(bound=0, size=2000, slide=2000, offset=0, lateness=1000, purge=False, side_output=True)
    out, late, dropped = closed_form(spark, events, "key", p, False)
    assert out == Counter({("k", 1999, 2, "on_time", 2): 1, ("k", 1999, 3, "late", 3): 1,
                           ("k", 1999, 4, "late", 4): 1})
    assert not late and dropped == 0


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("mode", ["global", "explicit", "key"])
def test_carried_state_over_cuts_matches_definition(spark, seed, mode):
    """The operator run piece by piece with a Carry equals the definition on the whole input."""
    from eventide.operators.window_agg import Carry

    rng = random.Random(300 + seed)
    p = random_params(rng)
    events = random_stream(rng, "", 60, explicit=mode == "explicit")
    bound = p["bound"] if mode != "explicit" else 0
    exp_out, exp_late, exp_dropped = outcome(events, mode, bound, p["size"], p["slide"], p["offset"],
                                              p["lateness"], p["purge"], p["side_output"], False)
    spec = WindowAggSpec(
        WindowSpec(p["size"], p["slide"], p["offset"]),
        WatermarkSpec({"global": "global", "explicit": "column", "key": "key"}[mode], bound,
                      marker="wm" if mode == "explicit" else None),
        p["lateness"], FIRE_AND_PURGE if p["purge"] else FIRE, p["side_output"],
    )
    cuts = sorted(rng.sample(range(1, len(events)), 3))
    carry, out, late, dropped = Carry(), Counter(), Counter(), 0
    for lo, hi in zip([0, *cuts], [*cuts, len(events)]):
        part = spark.createDataFrame(rows_of(events[lo:hi]), SCHEMA)
        res = windowed_agg(part, spec, "k", "ts_ms", ["seq"], sum_of("v", "total"), carry=carry)
        out += Counter((r.k, r.out_ts, r.total, r.fire, r.trigger_seq) for r in res.output.collect())
        late += Counter((r.k, r.ts_ms) for r in res.late.collect())
        dropped += res.dropped.collect()[0].dropped
        carry = Carry(res.watermark, res.state, res.key_watermarks)
    assert out == Counter(exp_out), p
    assert late == Counter(exp_late), p
    assert dropped == exp_dropped, p


@pytest.mark.parametrize("mode,bound", [("key", 0), ("global", 0)])
def test_a_stream_keeps_only_windows_that_can_fire(spark, mode, bound):
    """What a batch adds to the state leaves out the windows that its own watermark has closed for good."""
    from eventide.operators.window_agg import Carry

    spec = WindowAggSpec(WindowSpec(1000), WatermarkSpec(mode, bound), 0, FIRE)
    part = spark.createDataFrame(rows_of([("e", i, "k", 100 * i, 1) for i in range(100)]), SCHEMA)
    res = windowed_agg(part, spec, "k", "ts_ms", ["seq"], sum_of("v", "total"), carry=Carry())
    assert [(r.window_start, r.total) for r in res.added.collect()] == [(9000, 10)]
    assert res.output.count() == 9
