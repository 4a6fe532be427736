"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import written


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """Smallest node reachable from each node that has a link.

    ``links`` has two columns ``a`` and ``b`` of one orderable type; direction,
    repeats, loops and nulls do not matter. Returns ``node``, ``root`` (``root`` = smallest
    node of the component). Alternates large-star and small-star steps until the
    links no longer change: a logarithmic number of rounds also for long chains.
    Every step is a minimum per node (combined before the shuffle) and a join
    with it; both inputs of a join are stored tables, so that a node with very
    many links is a skewed join key that adaptive execution splits.
    """
    now = written(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(large.where("a <> b").distinct(), "large")
        down = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = (down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))))
        now = written(small.where("a <> b").distinct(), "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components: links still change after {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
