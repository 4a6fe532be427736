"""Forgetting idle keys (A19): opt-in, a key's state goes when it has not arrived for long enough.

A key has expired when its last arrival is more than ``after`` before the latest arrival of all
earlier batches: the next batch does not know it any more, its watermark and windows are gone, and if it comes
back it starts anew. Three state tables more:

* ``arrivals``: keys and last arrival; merged runs are sorted by it, so the keys that expire in a batch, those
  between the last batch's horizon and this one's, are found by reading little else.
* ``gone``: keys and the batch at which they expired. State rows carry the batch that wrote them; rows
  written before their key went do not count.
* When as many keys have gone as half of the keys that are stored, all runs are written without them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.plans.reach import null_safe_join
from eventide.streaming.state import Commit, Save, load_runs


class Expiry:
    """Expiry of the keys of one stream, for one batch."""

    def __init__(self, save: Save, before: Commit | None, keys: Sequence[str], arrival: str, after: int):
        self.save, self.keys, self.arrival, self.spark = save, list(keys), arrival, save.spark
        latest = before.counters.get("latest") if before else None
        self.latest = latest
        self.horizon = None if latest is None else latest - after
        self.past = before.counters.get("horizon") if before else None
        self.went = 0
        if self.horizon is not None and (self.past is None or self.horizon > self.past):
            self.went = self._expire(load_runs(self.spark, before, "arrivals"))

    def _expire(self, arrivals: DataFrame) -> int:
        last = F.col("last")
        due = arrivals.where(last < self.horizon)
        due = (due if self.past is None else due.where(last >= self.past)).select(*self.keys).distinct()
        later = arrivals.where(last >= self.horizon).select(*self.keys).distinct()
        gone = null_safe_join(due, later, self.keys, "left_anti").withColumn("at", F.lit(self.save.commit.batch).cast("bigint"))
        rows = self.save.rows("gone")
        self.save.add("gone", gone)
        self.save.merge("gone", lambda runs: runs.groupBy(*self.keys).agg(F.max("at").alias("at")))
        return self.save.rows("gone") - rows

    def live(self, rows: DataFrame | None) -> DataFrame | None:
        """State rows that were written after their key went for the last time."""
        gone = load_runs(self.spark, self.save.commit, "gone")
        if rows is None or gone is None:
            return rows
        gone = gone.groupBy(*self.keys).agg(F.max("at").alias("_gone"))
        return null_safe_join(rows, gone, self.keys, "left").where(F.col("_gone").isNull() | (F.col("at") >= F.col("_gone"))).drop("_gone")

    def dated(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("at", F.lit(self.save.commit.batch).cast("bigint"))

    def merging(self, merge: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        """Merge live rows; what is merged is as of this batch."""
        return lambda runs: self.dated(merge(self.live(runs).drop("at")))

    def finish(self, batch: DataFrame, merges: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, int]:
        """Note this batch's arrivals, write the tables without what has gone if it is much; returns counters."""
        def latest_of(runs: DataFrame) -> DataFrame:
            kept = runs.groupBy(*self.keys).agg(F.max("last").alias("last"))
            kept = kept if self.horizon is None else kept.where(F.col("last") >= self.horizon)
            return kept.repartitionByRange("last").sortWithinPartitions("last")

        own = batch.groupBy(*self.keys).agg(F.max(self.arrival).cast("bigint").alias("last")).where("last IS NOT NULL")
        top = self.save.add("arrivals", own).agg(F.max("last")).first()[0]
        self.save.merge("arrivals", latest_of)
        if self.save.rows("gone") and 2 * self.save.rows("gone") >= self.save.rows("key_wm"):
            for name, merge in {**merges, "arrivals": latest_of}.items():
                self.save.merge_from(name, 0, merge)
            self.save.commit.runs["gone"] = []
        latest = max([x for x in (self.latest, top) if x is not None], default=None)
        return {"latest": latest, "horizon": self.horizon if self.horizon is not None else self.past, "expired": self.went}
