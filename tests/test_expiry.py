"""Idle keys: kept by default, forgotten on request at the cost of what expires."""

import random

import pytest

from eventide.functions.aggregates import sum_of
from eventide.plans.spec import WatermarkSpec, WindowAggSpec, WindowSpec
from eventide.session import scratch_dir
from eventide.streaming import state
from eventide.streaming.carried import carried_window_sink, read_carried
from eventide.streaming.state import last_commit

SPEC = WindowAggSpec(WindowSpec(100), WatermarkSpec("key", 0), 150)
SCHEMA = "k STRING, seq BIGINT, ts_ms BIGINT, v BIGINT"


def stream(spark, batches, after, name):
    base = scratch_dir(spark, name)
    sink = carried_window_sink(base, SPEC, "k", "ts_ms", ["seq"], sum_of("v", "total"), expire_after=after)
    for n, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, SCHEMA), n)
    return base, sorted(map(str, (tuple(r) for r in read_carried(spark, base).select("k", "out_ts", "fire", "trigger_seq", "total").collect())))


def expected(spark, batches, after):
    """A key that expires is another key afterwards: the same stream with keys numbered by their lives."""
    life, last, latest, out = {}, {}, None, []
    for rows in batches:
        horizon = None if latest is None else latest - after
        for k in {r[0] for r in rows}:
            if horizon is not None and k in last and last[k] < horizon:
                life[k] = life.get(k, 0) + 1
        renamed = [(f"{k}/{life.get(k, 0)}", seq, ts, v) for k, seq, ts, v in rows]
        out.append(renamed)
        for k, seq, _, _ in rows:
            last[k] = max(seq, last.get(k, seq))
            latest = seq if latest is None else max(latest, seq)
    return out


def batches_of(seed):
    rng = random.Random(seed)
    out, seq = [], 0
    for n in range(9):
        active = rng.sample(["a", "b", "c", "d"], rng.randint(1, 3))
        rows = []
        for _ in range(rng.randint(1, 12)):
            seq += rng.randint(1, 9)
            rows.append((rng.choice(active), seq, seq * 8 + rng.randint(-150, 50), rng.randint(1, 9)))
        out.append(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_an_expired_key_starts_anew(spark, seed):
    batches = batches_of(seed)
    renamed = expected(spark, batches, 25)
    assert any("/1" in r[0] for rows in renamed for r in rows)
    _, plain = stream(spark, renamed, None, "lives")
    _, got = stream(spark, batches, 25, "expiry")
    assert got == sorted(p.replace(f"/{n}'", "'") for p in plain for n in range(9) if f"/{n}'" in p)


def test_default_keeps_idle_keys(spark):
    batches = batches_of(2)
    base, default = stream(spark, batches, None, "default")
    assert set(last_commit(spark, base).runs) == {"key_wm", "windows"}
    _, never = stream(spark, batches, 10**9, "never")
    assert default == never


def test_state_shrinks_by_what_expired(spark, monkeypatch):
    monkeypatch.setattr(state, "LISTED_KEYS", 5)
    idle = [(f"idle{i}", i, 1000 + i, 1) for i in range(500)]
    busy = [[("busy", 1000 * n + i, 5000 * n + i, 1) for i in range(3)] for n in range(1, 5)]
    base, _ = stream(spark, [idle, *busy], 1500, "shrinks")
    commit = last_commit(spark, base)
    assert sum(r["rows"] for r in commit.runs["key_wm"]) < 10 and sum(r["rows"] for r in commit.runs["arrivals"]) < 10
    assert sum(r["rows"] for r in commit.runs["windows"]) < 20 and commit.runs["gone"] == []
    assert commit.gauge["lowest"] == commit.gauge["highest"] == 20_002
    with pytest.raises(ValueError):
        carried_window_sink(base, WindowAggSpec(WindowSpec(1), WatermarkSpec("global", 0)), "k", "ts_ms", ["seq"], sum_of("v"), expire_after=1)
