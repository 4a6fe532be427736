"""No task holds a hot key, or all rows of one arrival value."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.plans import prefix
from eventide.plans.prefix import prefix_scan
from eventide.plans.reach import first_reaching


def sizes_of(df):
    """Rows per task of a lazy frame; the sums keep every column needed."""
    return [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("wm"), F.count(F.lit(1)).alias("n")).collect()]


@pytest.fixture(autouse=True)
def visible_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 1000)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep the 8 tasks visible
    yield
    spark.conf.set("spark.sql.adaptive.enabled", old)


def rows(n, arrival, hot=True):
    rng = random.Random(7)
    return [("hot" if hot and i % 3 == 0 else f"k{rng.randint(0, 500)}", arrival(i), i, rng.randint(0, 10**6)) for i in range(n)]


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("arrival", [lambda i: i * 10, lambda i: 5, lambda i: 5 if i % 2 else i], ids=["spread", "one value", "half in one value"])
def test_no_task_holds_twice_the_mean(spark, keys, arrival):
    df = spark.createDataFrame(rows(30_000, arrival), "k STRING, arr BIGINT, id BIGINT, ts BIGINT")
    scanned = prefix_scan(df, keys, ["arr", "id"], {"wm": ("max", "ts", False)})
    sizes = sizes_of(scanned)
    assert len(sizes) == 8 and max(sizes) < 2 * 30_000 / 8, sizes
    naive = df.withColumn("wm", F.max("ts").over(Window.partitionBy(*keys).orderBy("arr", "id").rowsBetween(Window.unboundedPreceding, -1)))
    assert max(sizes_of(naive)) >= 10_000  # the whole hot key, or everything, in one task
    got = {r.id: r.wm for r in scanned.select("id", "wm").collect()}
    assert got == {r.id: r.wm for r in naive.select("id", "wm").collect()}


def test_carries_are_two_rows_per_range_at_most(spark):
    """However many keys and moments there are: no table near the input's size is joined or added to the rows."""
    df = spark.range(40_000).select(F.col("id").alias("k"), F.col("id").alias("arr"), "id", (F.col("id") * 7).alias("ts"))
    text = prefix_scan(df, ["k"], ["arr", "id"], {"wm": ("max", "ts", False)})._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in text and "SortMergeJoin" not in text
    bounds = prefix._cuts(df, [["k"]], ["arr", "id"])[0]
    place = [F.xxhash64("k"), F.col("arr"), F.col("id")]
    numbered = prefix._numbered(df, place, [prefix._array(c, "bigint") for c in zip(*bounds)], len(bounds))
    at_ends = numbered.where(F.xxhash64("k").isin([b[0] for b in bounds])).groupBy("_range", "k").count().count()
    assert len(bounds) == 7 and at_ends <= 2 * 8


@pytest.mark.parametrize("keys", [["k"], []])
def test_firing_search_is_spread(spark, keys):
    """Half of all windows end at one moment, and one key holds a third of them."""
    df = spark.createDataFrame(rows(20_000, lambda i: i), "k STRING, arr BIGINT, id BIGINT, ts BIGINT")
    seen = df.select("k", "arr", "id", (F.col("id") - 1).alias("b"), F.col("id").alias("a"))
    goals = df.select("k", F.when(F.col("id") % 2 == 0, F.lit(10_000)).otherwise(F.col("id")).cast("bigint").alias("goal"), F.col("id").alias("n"))
    found = first_reaching(seen, keys, ["arr", "id"], "b", "a", goals, "goal", F.when(F.col("id") % 2 == 0, F.lit(10_000)).otherwise(F.col("id")).cast("bigint"))
    sizes = [r.n for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("trigger_id"), F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2.5 * 20_000 / 8, sizes
