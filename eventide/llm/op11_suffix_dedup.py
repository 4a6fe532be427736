"""Removal of byte passages that occur more than once, by a distributed sort of suffixes.

Every string of ``LENGTH`` bytes (a window) holds cores of ``CORE`` bytes; the leftmost
core with the smallest hash is its anchor, so equal windows have equal anchors at equal
distances. The windows of one anchor place start next to each other: one row, with the
hash of its core and of all the bytes of its windows (its kind), stands for about a
hundred windows, and only cores met in several kinds need their bytes compared:

1. Whole copies are found by digest; the rest of the work is on one text of each.
2. Places of one kind are copies of each other. Of each kind of a core with several
   kinds, one suffix (from the anchor to the end of its last window) is sorted: tasks sort runs, code
   each suffix by the length it shares with the one before, and send them by core.
3. A loser tree merges the runs of a shard. Each head knows the length that it shares
   with the last winner: a longer one wins at once, equal ones are compared behind it.
4. Neighbours sharing a core form a group; the shared lengths bound the windows that can be
   equal, and what stands before the anchors decides.

A core with more than ``HOT_KINDS`` kinds would be a large group in one task: its windows
are counted by digest with Spark's aggregation instead, to the same result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import dropped, pick, read, written

LENGTH, CORE = 400, 200
HOT_KINDS = 20_000
#: Bytes hashed at once, of a run that a task sorts, and of the suffixes of one shard.
HASHED_BYTES, RUN_BYTES, SHARD_BYTES = 1 << 20, 16 << 20, 16 << 20
_PLACE = np.uint64((1 << 22) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------- anchors

@lru_cache(maxsize=1)
def _powers() -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Powers of each base and of its inverse, modulo 2^64."""
    out = []
    for base in _BASES:
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(2 * HASHED_BYTES, b, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        out.append(tuple(tables))
    return tuple(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    powers = _powers()[which][0]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[:len(data)])])


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: of a block's tail and the next block's head."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, width)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tails[:n], heads[width - 1:width - 1 + n])


def anchors(pieces: Sequence[bytes], length: int, core: int) -> tuple[np.ndarray, ...]:
    """Anchor places of the windows within each piece: piece, hash of the core, hash of the kind, and the
    places in the piece of the anchor, the first and the last window that it stands for."""
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < length or not (sizes >= length).any():
        return none
    sums, inverse = _sums(data, 0), _powers()[0][1]
    n = len(data) - core + 1
    cores = _mixed((sums[core:] - sums[:-core]) * inverse[:n])
    least = _smallest(cores & ~_PLACE | np.arange(n, dtype=np.uint64), length - core + 1)
    inside = np.zeros(len(data) + 1, np.int8)
    fitting = sizes >= length
    inside[ends[fitting] - sizes[fitting]] += 1
    inside[ends[fitting] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside)[:len(least)])
    place = (least[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    anchor, first, last = place[new], at[new], at[np.append(new[1:], len(at)) - 1]
    sums = _sums(data, 1)
    kinds = (sums[last + length] - sums[first]) * _powers()[1][1][first]
    kinds = _mixed(kinds + _mixed((anchor - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)))
    piece = np.searchsorted(ends, first, side="right")
    starts = (ends - sizes)[piece]
    return piece, cores[anchor].view(np.int64), kinds.view(np.int64), anchor - starts, first - starts, last - starts


def _anchored(docs: DataFrame, length: int, core: int) -> DataFrame:
    """``docs`` (doc_id, text) with ``n_bytes``, ``content`` (digest) and the arrays of its anchor places."""
    names = ["core", "kind", "anchor", "first", "last"]
    lists = [pa.list_(pa.int64())] * 5
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("content", T.BinaryType()),
                           *[T.StructField(n, T.ArrayType(T.LongType())) for n in names]])

    def found(texts: list[bytes]) -> list[list[np.ndarray]]:
        """Per text the five arrays; long texts are hashed in pieces that share ``length - 1`` bytes."""
        out = [[[] for _ in names] for _ in texts]
        pieces, owners, held = [], [], 0

        def close():
            piece, *columns = anchors(pieces, length, core)
            bounds = np.searchsorted(piece, np.arange(len(pieces) + 1))
            for i, (text, start) in enumerate(owners):
                a, b = bounds[i], bounds[i + 1]
                for k, c in enumerate(columns):
                    out[text][k].append(c[a:b] + (start if k > 1 else 0))

        for number, text in enumerate(texts):
            for start in range(0, max(1, len(text) - length + 1), HASHED_BYTES - length):
                part = text[start:start + HASHED_BYTES - 1]
                if held + len(part) > HASHED_BYTES and pieces:
                    close()
                    pieces, owners, held = [], [], 0
                pieces.append(part)
                owners.append((number, start))
                held += len(part)
        if pieces:
            close()
        return [[np.concatenate(k) if k else np.zeros(0, np.int64) for k in columns] for columns in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                columns = found(texts)
                arrays = [*part.columns, pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
                arrays += [pa.array([c[k] for c in columns], kind) for k, kind in enumerate(lists)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


# ---------------------------------------------------------------- sorted runs and their merge

def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    for at in range(start, n, 64):
        x, y = a[at:at + 64], b[at:at + 64]
        if x != y:
            k = min(len(x), len(y))
            x, y = int.from_bytes(x[:k], "little"), int.from_bytes(y[:k], "little")
            return at + (((x ^ y) & -(x ^ y)).bit_length() - 1) // 8 if x != y else at + k
    return n


def front_coded(suffixes: Sequence[bytes]) -> tuple[list[int], list[bytes]]:
    """Lengths shared with the suffix before, and the rests, of sorted suffixes."""
    lengths, rests, before = [], [], b""
    for s in suffixes:
        n = shared(before, s)
        lengths.append(n)
        rests.append(s[n:])
        before = s
    return lengths, rests


def merged(runs: Sequence[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Loser-tree merge of runs of (length shared with the suffix before, suffix, payload), in the same form."""
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (leaves - len(runs))
    known = [0] * leaves  # length that each head shares with the last winner
    losers = [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); what the loser shares with the winner is noted."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if known[a] != known[b]:  # the one that shares more with the last winner is the smaller
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        n = shared(x, y, known[a])
        won, lost = (a, b) if n == len(x) or (n < len(y) and x[n] < y[n]) else (b, a)
        known[lost] = n
        return won, lost

    def first_round(node: int) -> int:
        if node >= leaves:
            return node - leaves
        won, losers[node] = play(first_round(2 * node), first_round(2 * node + 1))
        return won

    winner = first_round(1)
    while heads[winner] is not None:
        yield known[winner], heads[winner][1], heads[winner][2]
        heads[winner] = next(runs[winner], None)
        known[winner] = heads[winner][0] if heads[winner] else 0
        node = (winner + leaves) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


_RUN = pa.schema([("shard", pa.int32()), ("lengths", pa.list_(pa.int32())), ("rests", pa.list_(pa.binary())), ("befores", pa.list_(pa.binary())),
                  ("cores", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int64())), ("lows", pa.list_(pa.int32()))])
_RUN_DDL = ("shard int, lengths array<int>, rests array<binary>, befores array<binary>, cores array<bigint>, kinds array<bigint>, lows array<int>")


def _places(batch: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """(core, kind, bytes before the anchor, suffix, smallest distance of a window) of rows (text, places)."""
    for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        data = (text or "").encode()
        for p in places:
            yield p["core"], p["kind"], data[p["first"]:p["anchor"]], data[p["anchor"]:p["last"] + length], p["anchor"] - p["last"]


def _runs(places: DataFrame, shards: int, length: int) -> DataFrame:
    """Front-coded sorted runs, one row per run and shard. ``places``: text and its anchor places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0

        def spill():
            for shard, entries in held.items():
                entries.sort(key=lambda e: e[0])
                lengths, rests = front_coded([e[0] for e in entries])
                row = [shard, lengths, rests, *[[e[i] for e in entries] for i in range(1, 5)]]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _RUN)], schema=_RUN)

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                for core, kind, before, suffix, low in _places(whole.slice(at, 64), length):
                    held[core % shards].append((suffix, before, core, kind, low))
                    size += len(suffix) + len(before) + 200
                    if size >= RUN_BYTES:
                        yield from spill()
                        held, size = defaultdict(list), 0
        yield from spill()

    return places.mapInArrow(run, _RUN_DDL)


def _decoded(row: dict) -> Iterator[tuple[int, bytes, tuple]]:
    before = b""
    for n, rest, *payload in zip(*(row[f.name] for f in _RUN if f.name != "shard")):
        before = before[:n] + rest
        yield n, before, tuple(payload)


def equal_windows(group: list[tuple[int, bytes, tuple]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(core, kind, lowest, highest distance) of the windows that some other member of the group has too.

    ``group``: (shared length, suffix, (bytes before, core, kind, lowest distance)) in sorted order.
    """
    if len(group) == 2:
        (_, x, (x_before, *_, x_low)), (n, y, (y_before, *_, y_low)) = group
        back = shared(x_before[::-1], y_before[::-1])
        low, high = max(length - n, x_low, y_low), back
        if low <= high:
            for _, _, (_, core, kind, _) in group:
                yield core, kind, low, high
        return
    bounds = []
    for i, (n, _, (before, _, _, low)) in enumerate(group):
        most = max(n if i else 0, group[i + 1][0] if i + 1 < len(group) else 0)  # shared with a neighbour: with anyone
        bounds.append((max(low, length - most), len(before)))
    found = defaultdict(list)
    for d in range(min(a for a, _ in bounds), max(b for _, b in bounds) + 1):
        members = defaultdict(list)
        for i, (low, high) in enumerate(bounds):
            if low <= d <= high:
                before, suffix = group[i][2][0], group[i][1]
                members[before[len(before) - d:] + suffix[:length - d]].append(i)
        for same in members.values():
            if len(same) > 1:
                for i in same:
                    found[i].append(d)
    for i, distances in found.items():
        _, core, kind, _ = group[i][2]
        start = before = distances[0]
        for d in distances[1:] + [None]:
            if d != before + 1:
                yield core, kind, start, before
                start = d
            before = d


def _compared(runs: DataFrame, shards: int, length: int, core: int) -> DataFrame:
    """Windows (``core``, ``kind``, ``low``, ``high`` distance) that two kinds share: each shard's runs merged."""
    names = ["core", "kind", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(batch.num_rows):
                    yield batch.slice(at, 1).to_pylist()[0]

        def shares(shard: list[dict]) -> Iterator[tuple]:
            group: list = []
            for entry in merged([_decoded(r) for r in shard]):
                if entry[0] < core:
                    if len(group) > 1:
                        yield from equal_windows(group, length)
                    group = []
                group.append(entry)
            if len(group) > 1:
                yield from equal_windows(group, length)

        def results():
            own: list[dict] = []
            for row in rows():
                if own and own[0]["shard"] != row["shard"]:
                    yield from shares(own)
                    own = []
                own.append(row)
            if own:
                yield from shares(own)

        out = []
        for found in results():
            out.append(found)
            if len(out) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return runs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "core bigint, kind bigint, low bigint, high bigint")


def _counted(places: DataFrame, length: int) -> DataFrame:
    """The same as ``_compared`` for cores of any number of kinds: windows counted by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                out = []
                for core, kind, before, suffix, low in _places(whole.slice(at, 1), length):
                    out += [(core, kind, d, hashlib.blake2b(before[len(before) - d:] + suffix[:length - d], digest_size=16).digest())
                            for d in range(low, len(before) + 1)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 3 + [pa.binary()])],
                                                     names=["core", "kind", "low", "window"])

    windows = written(places.mapInArrow(run, "core bigint, kind bigint, low bigint, window binary"), "windows")
    many = windows.groupBy("core", "low", "window").count().where("count > 1")
    return windows.join(many, ["core", "low", "window"], "left_semi").select("core", "kind", "low", F.col("low").alias("high"))


# ---------------------------------------------------------------- the operator

def repeated_spans(docs: DataFrame, length: int, core: int) -> tuple[DataFrame, DataFrame]:
    """The stored texts (``row``, ``doc_id``, ``text``, ``n_bytes``) and the spans of repeated windows
    (``row``, ``start``, ``end``; they may overlap)."""
    anchored = written(_anchored(docs, length, core).withColumn("row", F.monotonically_increasing_id()), "anchored")
    texts = anchored.select("row", "doc_id", "text", "n_bytes")
    contents = written(anchored.groupBy("content").agg(F.min("row").alias("row"), F.count("*").alias("copies")), "contents")
    copied = anchored.where(F.col("n_bytes") >= length).select("row", "n_bytes", "content").join(
        contents.where("copies > 1").select("content"), "content").select("row", F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end"))

    one_each = anchored.select("row", "core", "kind", "anchor", "first", "last").join(contents.select("row"), "row")
    places = written(one_each.select("row", F.explode(F.arrays_zip("core", "kind", "anchor", "first", "last")).alias("p")).select("row", "p.*"), "places")
    kinds = written(places.groupBy("core", "kind").agg(F.count("*").alias("many"), F.min(F.struct("row", "anchor", "first", "last")).alias("one")), "kinds")
    again = kinds.where("many > 1").select("core", "kind", (F.col("one.anchor") - F.col("one.last")).alias("low"), (F.col("one.anchor") - F.col("one.first")).alias("high"))

    several = kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1")
    unsure = written(kinds.join(several, "core").select("core", "kind", "kinds", "one.*"), "unsure")
    size = unsure.agg(F.sum(F.col("last") - F.col("first") + length + 100).alias("size"), F.max("kinds").alias("most")).first()
    found = again
    if size["size"]:
        def with_text(which: DataFrame) -> DataFrame:
            own = which.groupBy("row").agg(F.collect_list(F.struct("core", "kind", "anchor", "first", "last")).alias("places"))
            return own.join(texts.select("row", "text"), "row").select("text", "places")

        shards = 1 + int(size["size"]) // SHARD_BYTES
        runs = _runs(with_text(unsure.where(F.col("kinds") <= HOT_KINDS)), shards, length)
        found = found.unionByName(_compared(runs, shards, length, core))
        if size["most"] > HOT_KINDS:
            found = found.unionByName(_counted(with_text(unsure.where(F.col("kinds") > HOT_KINDS)), length))
    stored = written(found, "found")
    spans = places.join(stored, ["core", "kind"]).select(
        "row", (F.col("anchor") - F.col("high")).alias("start"), (F.col("anchor") - F.col("low") + length).alias("end"))
    whole = written(copied.unionByName(spans), "spans")
    dropped(contents, places, kinds, unsure, stored)
    return texts, whole


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, core: int | None = None,
                   with_kept: bool = False) -> DataFrame:
    """Every text without the bytes of its ``length``-byte strings that also start at another place, in it or in another text.

    One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs of removed
    bytes), ``kept_sha256`` (hex, of the remaining bytes), ``spans`` (start and end of each run) and,
    with ``with_kept``, ``kept`` (the bytes: a run may end within a character). Texts are UTF-8
    bytes; null is empty; texts shorter than ``length`` stay whole. Repeated rows are copies of each other;
    null ids stay; other columns are not read; an empty table gives no rows.
    ``core``: bytes of an anchor's core, by default half of ``length``.
    """
    core = core or max(1, length // 2)
    if not 0 < core < length or length - core >= 1 << 20 or length >= HASHED_BYTES // 2:
        raise ValueError(f"a core of {core} bytes does not fit strings of {length}")
    own = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    texts, spans = repeated_spans(own, length, core)
    marked = texts.join(spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "row", "left")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([own.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", span)]
                          + [T.StructField("kept", T.BinaryType())] * with_kept)
    kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] + [pa.binary()] * with_kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                out = []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data, runs = (text or "").encode(), []
                    for a, b in sorted((s["start"], s["end"]) for s in found or []):
                        if runs and a <= runs[-1]["end"]:
                            runs[-1]["end"] = max(runs[-1]["end"], b)
                        else:
                            runs.append({"start": a, "end": b})
                    edges = [0, *[e for r in runs for e in (r["start"], r["end"])], len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    row = [len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), runs]
                    out.append(row + [kept] * with_kept)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=schema.names)

    return marked.select("doc_id", "text", "spans").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("spans")
