"""State of a stream as runs of increments, with one commit per micro-batch.

A state table is a set of mergeable rows (watermarks of keys: the maximum; open windows:
the accumulators' sums, counts, minima and maxima). A batch adds one run: only what its own
rows contribute. Nothing is rewritten in place; when enough small runs have gathered behind a
run no larger than all of them together, they are merged into one (size-tiered), so a row is
rewritten a logarithmic number of times and the bytes that a batch writes follow
the batch, not the state. How many files a run has follows from its size (adaptive execution).

    <base>/state/<table>/run=<batch>     what batch N contributed, or runs merged by it
    <base>/state/commits/<batch>.json    the runs of each table, watermark, counters, gauge

A commit is written last, to a new name and then renamed. Batch N needs the commit of batch
N-1; a sink that belongs to another query or is ahead of the checkpoint is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventide.plans.materialize import delete

#: Runs that are merged at once, at least.
MERGED_RUNS = 4
#: Keys with the lowest watermarks that a commit lists, for the gauge.
LISTED_KEYS = 200


@dataclass
class Commit:
    """What a batch left behind."""

    batch: int
    query: str | None = None
    wm: int | None = None
    horizon: int = 0
    """A window keeps its state while the watermark is below ``window_end - 1 + horizon``."""
    schemas: dict[str, str] = field(default_factory=dict)
    runs: dict[str, list[dict]] = field(default_factory=dict)
    """Per table, oldest first: ``path`` and ``rows``."""
    counters: dict[str, int] = field(default_factory=dict)
    gauge: dict = field(default_factory=dict)


class _Files:
    """Small files on whatever file system the sink is on."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark.sparkContext._jvm
        self.folder = f"{base}/state/commits"
        path = self.path("")
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(""))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def read(self, batch: int) -> Commit:
        stream = self.fs.open(self.path(f"{batch:09d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Commit(**json.loads(text))

    def write(self, commit: Commit) -> None:
        part, whole = self.path(f"{commit.batch:09d}.part"), self.path(f"{commit.batch:09d}.json")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(json.dumps(vars(commit)).encode()))
        finally:
            stream.close()
        self.fs.delete(whole, False)  # a retried batch
        if not self.fs.rename(part, whole):
            raise RuntimeError(f"the commit of batch {commit.batch} could not be put in place in {self.folder}")


def commits(spark: SparkSession, base: str) -> list[Commit]:
    """The commits that are kept, oldest first."""
    files = _Files(spark, base)
    return [files.read(n) for n in files.numbers()]


def last_commit(spark: SparkSession, base: str) -> Commit | None:
    files = _Files(spark, base)
    numbers = files.numbers()
    return files.read(numbers[-1]) if numbers else None


def load_commit(spark: SparkSession, base: str, batch_id: int) -> Commit | None:
    """What the batch before ``batch_id`` committed; None only before the first batch of a new sink."""
    files = _Files(spark, base)
    numbers = files.numbers()
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if numbers and numbers[-1] > batch_id:
        raise RuntimeError(f"batch {batch_id} finds later commits, up to {numbers[-1]}, in {files.folder}: "
                           "the sink belongs to another checkpoint; start a new query with a new sink")
    if batch_id == 0:
        if numbers and query and files.read(0).query not in (None, query):
            raise RuntimeError(f"{files.folder} holds the state of another query; start a new query with a new sink")
        return None
    if batch_id - 1 not in numbers:
        raise RuntimeError(f"batch {batch_id} needs the state of batch {batch_id - 1}, which {base}/state does not hold: "
                           "restore the sink folder that belongs to this checkpoint, or start with a new checkpoint and sink")
    commit = files.read(batch_id - 1)
    if query and commit.query not in (None, query):
        raise RuntimeError(f"{files.folder} holds the state of another query; start a new query with a new sink")
    return commit


def load_runs(spark: SparkSession, commit: Commit | None, name: str) -> DataFrame | None:
    """All rows of a state table, not merged; None before the first batch. A file that is missing or damaged fails the batch."""
    if commit is None or name not in commit.schemas:
        return None
    paths = [r["path"] for r in commit.runs[name]]
    if not paths:
        return spark.createDataFrame([], commit.schemas[name])
    return spark.read.schema(commit.schemas[name]).parquet(*paths)


def together(*steps: Callable[[], object]) -> None:
    """Independent steps of one batch as concurrent Spark jobs. All have ended when the first failure is raised."""
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(s)) for s in steps]
    for r in running:
        r.result()


class Save:
    """The state after a batch: runs are added table by table, then the commit is written."""

    def __init__(self, spark: SparkSession, base: str, batch_id: int, before: Commit | None, wm: int | None = None, horizon: int = 0):
        self.spark, self.base = spark, base
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        self.commit = Commit(batch_id, query, wm, horizon)
        if before:
            self.commit.runs = {n: list(r) for n, r in before.runs.items()}
            self.commit.schemas = dict(before.schemas)
            self.commit.gauge = dict(before.gauge)

    def add(self, name: str, increments: DataFrame) -> DataFrame:
        """Write this batch's run of a table; returns the run."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in increments.schema.fields)
        self.commit.schemas[name] = schema
        path = f"{self.base}/state/{name}/run={self.commit.batch:09d}"
        written = Observation()
        increments.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        runs = self.commit.runs.setdefault(name, [])
        if written.get["rows"]:
            runs.append({"path": path, "rows": written.get["rows"]})
        return self.spark.read.schema(schema).parquet(path)

    def merge(self, name: str, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Merge runs of a table if it is time."""
        runs = self.commit.runs[name]
        for i in range(len(runs) - MERGED_RUNS + 1):
            if sum(r["rows"] for r in runs[i + 1:]) >= runs[i]["rows"]:
                self.merge_from(name, i, merge)
                break

    def merge_from(self, name: str, i: int, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Merge the runs of a table from number ``i`` on into one."""
        runs, schema = self.commit.runs[name], self.commit.schemas[name]
        path = f"{self.base}/state/{name}/run={self.commit.batch:09d}-merged"
        merge(self.spark.read.schema(schema).parquet(*[r["path"] for r in runs[i:]])).write.mode("overwrite").parquet(path)
        runs[i:] = [{"path": path, "rows": self.spark.read.schema(schema).parquet(path).count()}]

    def rows(self, name: str) -> int:
        return sum(r["rows"] for r in self.commit.runs.get(name, []))

    def finish(self, counters: dict[str, int]) -> None:
        self.commit.counters = counters
        files = _Files(self.spark, self.base)
        files.write(self.commit)
        retain = max(2, int(self.spark.conf.get("spark.sql.streaming.minBatchesToRetain", "100")))
        old = self.commit.batch - retain
        if old >= 0 and files.fs.exists(files.path(f"{old:09d}.json")):
            # a run that a merge has replaced never comes back: it goes with the last commit that lists it
            kept = {r["path"] for runs in files.read(old + 1).runs.values() for r in runs}
            delete(self.spark, [r["path"] for runs in files.read(old).runs.values() for r in runs if r["path"] not in kept])
            files.fs.delete(files.path(f"{old:09d}.json"), False)

    # ---- the gauge: lowest and highest watermark of all keys

    def gauge_keys(self, run: DataFrame, keys: list[str], table: Callable[[], DataFrame] | None = None, again: bool = False) -> None:
        """Carry the gauge on from this batch's run of key watermarks.

        The commit lists the keys with the lowest watermarks and a bound that every other
        key's watermark has reached. Watermarks only rise, so a batch has to look at its own keys
        alone: those listed and those below the bound. When no listed key is left
        at or below the bound, the table is read again. ``table`` reads it (all rows of ``key_wm``, by
        default); ``again``: keys have gone, read it now.
        """
        gauge = {} if again else self.commit.gauge
        listed, bound = dict(gauge.get("listed", [])), gauge.get("bound")
        own = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key")
        anew = F.collect_list(F.when(own.isin(list(listed)), F.struct(own, "wm"))) if listed else F.array()
        top = run.agg(F.max("wm").alias("top"), anew.alias("anew")).first()
        highest = max([x for x in (self.commit.gauge.get("highest"), top["top"]) if x is not None], default=None)
        listed.update({r["key"]: r["wm"] for r in top["anew"]})
        if bound is not None:
            below = run.where(F.col("wm") < F.lit(bound).cast("bigint")).select(own, "wm").orderBy("wm").limit(2 * LISTED_KEYS).collect()
            listed.update({r["key"]: r["wm"] for r in below})
            if len(below) == 2 * LISTED_KEYS:
                bound = below[-1]["wm"]
        if bound is None or not listed or min(listed.values()) > bound:
            whole = table() if table else load_runs(self.spark, self.commit, "key_wm")
            lows = whole.groupBy(*keys).agg(F.max("wm").alias("wm")).select(own, "wm").orderBy("wm").limit(LISTED_KEYS + 1).collect()
            listed = {r["key"]: r["wm"] for r in lows[:LISTED_KEYS]}
            bound = lows[-1]["wm"] if lows else None
        elif len(listed) > 4 * LISTED_KEYS:
            lows = sorted(listed.items(), key=lambda e: e[1])
            listed, bound = dict(lows[:LISTED_KEYS]), min(bound, lows[LISTED_KEYS][1])
        self.commit.gauge = {"listed": [[k, w] for k, w in listed.items()], "bound": bound, "highest": highest,
                             "lowest": min(listed.values(), default=None)}

    def gauge_one(self, wm: int | None) -> None:
        self.commit.gauge = {"lowest": wm, "highest": wm}
