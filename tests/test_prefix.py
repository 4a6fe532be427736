"""The range-partitioned prefix scan equals a plain running aggregate, wherever it is cut."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.plans import prefix
from eventide.plans.prefix import prefix_scan, prefix_scans
from eventide.plans.reach import first_reaching

OUTPUTS = {"mx_in": ("max", "x", True), "mx_ex": ("max", "x", False), "mn_in": ("min", "x", True), "sm_ex": ("sum", "x", False)}


def reference(df, keys, order, outputs=OUTPUTS):
    w = Window.partitionBy(*keys).orderBy(*order)
    frame = {True: w.rowsBetween(Window.unboundedPreceding, 0), False: w.rowsBetween(Window.unboundedPreceding, -1)}
    agg = {"max": F.max, "min": F.min, "sum": F.sum}
    return df.select("id", *[agg[op](src).over(frame[inc]).alias(n) for n, (op, src, inc) in outputs.items()])


def same(got, want):
    columns = want.columns
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("range_rows", [10**6, 200, 40, 7])
@pytest.mark.parametrize("keys", [["k"], ["k", "k2"], []])
def test_prefix_scan_matches_window(spark, monkeypatch, keys, range_rows):
    monkeypatch.setattr(prefix, "RANGE_ROWS", range_rows)
    rng = random.Random(range_rows)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, 1]), rng.choice([None, i // 3 - 50]), i, rng.choice([None, rng.randint(-50, 50)]))
            for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k STRING, k2 INT, arr BIGINT, id BIGINT, x BIGINT")
    same(prefix_scan(df, keys, ["arr", "id"], OUTPUTS), reference(df, keys, ["arr", "id"]))


def test_other_types_of_values_and_orders(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 20)
    rng = random.Random(4)
    day = datetime.datetime(2024, 3, 31)
    rows = [(rng.randint(0, 2), day + datetime.timedelta(minutes=rng.randint(0, 90)), f"s{rng.randint(0, 40)}", rng.random(), i, rng.random(), (i % 9, str(i)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "k BIGINT, t TIMESTAMP, s STRING, d DOUBLE, id BIGINT, x DECIMAL(20,0), z STRUCT<a: INT, b: STRING>".replace("DECIMAL(20,0)", "DOUBLE"))
    df = df.withColumn("x", F.col("x").cast("decimal(18,6)"))
    for keys in (["k"], []):
        for order in (["t", "id"], ["s", "t", "id"], ["s", "d", "id"], ["d", "id"]):
            outputs = {"m": ("min", "z", True), "sm": ("sum", "x", True)}
            same(prefix_scan(df, keys, order, outputs), reference(df, keys, order, outputs))


def test_extreme_places(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 2)
    rows = [(0, v, i, i % 5) for i, v in enumerate([-2**63, 2**63 - 1, 0, -1, 1, -2**63, 2**63 - 1, None] * 5)]
    df = spark.createDataFrame(rows, "k BIGINT, arr BIGINT, id BIGINT, x BIGINT")
    for keys in (["k"], []):
        same(prefix_scan(df, keys, ["arr", "id"], OUTPUTS), reference(df, keys, ["arr", "id"]))


def test_global_scope_and_two_scans(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 30)
    rows = [(i % 4, i * 7 % 50, i, (i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "k BIGINT, arr BIGINT, id BIGINT, x BIGINT")
    out = prefix_scans(df, [(["k"], {"a": ("max", "x", False)}), ([], {"g": ("max", "x", True)})], ["arr", "id"])
    got = {r.id: (r.a, r.g) for r in out.collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    best_k, best_g = {}, None
    for k, arr, i, x in ordered:
        want_a = best_k.get(k)
        best_g = x if best_g is None else max(best_g, x)
        assert got[i] == (want_a, best_g)
        best_k[k] = x if want_a is None else max(want_a, x)
    assert set(out.columns) == {"k", "arr", "id", "x", "a", "g"}


def test_a_table_with_like_places_can_be_sampled(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 50)
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).alias("arr"), "id", F.col("id").alias("x"))
    other = df.where("arr % 5 = 0")  # other places: other cuts, the same result
    same(prefix_scan(df, ["k"], ["arr", "id"], OUTPUTS, other), reference(df, ["k"], ["arr", "id"]))
    same(prefix_scan(df, ["k"], ["arr", "id"], OUTPUTS, df.limit(0)), reference(df, ["k"], ["arr", "id"]))
    with pytest.raises(ValueError, match="unsupported"):
        prefix_scan(df, ["k"], ["arr"], {"m": ("avg", "x", True)})


@pytest.mark.parametrize("range_rows", [10**6, 25])
@pytest.mark.parametrize("keys", [["k"], []])
def test_first_row_that_reaches_a_target(spark, monkeypatch, keys, range_rows):
    monkeypatch.setattr(prefix, "RANGE_ROWS", range_rows)
    rng = random.Random(6)
    top, rows = {}, []
    for i in range(400):
        k = rng.choice(["a", "b", None, "c"])
        before = top.get(k if keys else 0)
        after = rng.choice([before, i * 3 + rng.randint(0, 90)])
        after = after if before is None or after is None else max(before, after)
        top[k if keys else 0] = after
        rows.append((k, i // 7, i, before, after))
    targets = [(rng.choice(["a", "b", None, "c", "none"]), rng.choice([-2**63, 2**63 - 1, rng.randint(-10, 1300)]), n) for n in range(300)]
    df = spark.createDataFrame(rows, "k STRING, arr BIGINT, id BIGINT, b BIGINT, a BIGINT")
    goals = spark.createDataFrame(targets, "k STRING, goal BIGINT, payload BIGINT")
    got = first_reaching(df, keys, ["arr", "id"], "b", "a", goals, "goal", F.col("id") * 3)
    want = []
    for k, goal, n in targets:
        found = [r for r in rows if (not keys or r[0] == k) and r[4] is not None and r[4] >= goal]
        want.append((k, goal, n, *((found[0][1], found[0][2]) if found else (None, None))))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_small_keys_are_not_cut(spark, monkeypatch):
    """Cuts move to the beginnings of small keys: nothing is carried, so the input is read once and nothing is joined."""
    monkeypatch.setattr(prefix, "RANGE_ROWS", 1_000)
    df = spark.range(8_000).select((F.col("id") % 900).alias("k"), F.col("id").alias("arr"), "id", ((F.col("id") * 37) % 1_000).alias("x"))
    scanned = prefix_scan(df, ["k"], ["arr", "id"], {"m": ("max", "x", False), "s": ("sum", "x", True)})
    assert "Join" not in scanned._jdf.queryExecution().optimizedPlan().toString()
    w = Window.partitionBy("k").orderBy("arr", "id")
    plain = df.select("*", F.max("x").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"), F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert {r.id: (r.m, r.s) for r in scanned.collect()} == {r.id: (r.m, r.s) for r in plain.collect()}
