"""Token ids as range-ANS coded blocks, written in document order and read back.

Format (two Parquet tables in one folder):

* ``table``: ``token``, ``freq`` - the frequency table that all blocks share;
  frequencies sum to 2**20 and every id that occurs has at least 1.
* ``blocks``: one row per block of whole documents - ``shard`` and ``block``
  (their order is document order), ``start`` (ids of the shard before the block),
  ``n_tokens``, ``doc_ids`` and ``doc_tokens`` (its documents and their ids with
  the end id), ``words`` (the coded stream, unsigned 32 bit), ``checkpoints``
  (every ``CHECKPOINT_STEPS`` steps: the stream position and the lanes' states,
  unsigned 64 bit), ``crc32`` of the ids as little-endian unsigned 32-bit numbers.

A block interleaves ``LANES`` coders: id i belongs to lane i mod LANES, and the
lanes read one stream. A decoder can start at any checkpoint of any block, so
blocks and the stretches within them decode in parallel; numpy steps through all
stretches of a batch at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.llm.common import pick, read, written
from eventide.llm.tokens import library_encoder, text_groups
from eventide.session import scratch_dir

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
SCALE, LANES, BLOCK_TOKENS, CHECKPOINT_STEPS = 20, 32, 65_536, 512
#: States stay in [LOW, LOW << 32): one 32-bit word at most leaves or enters per id.
LOW = np.uint64(1 << 31)
_SCALE, _MASK, _WORD = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64(32)
#: A task codes about this many ids together.
_TOGETHER = 1 << 22


class Frequencies:
    """Frequencies scaled to a sum of 2**SCALE, and the tables that coding needs."""

    def __init__(self, tokens: np.ndarray, freqs: np.ndarray):
        size = int(tokens.max()) + 1
        self.freq = np.zeros(size, np.uint64)
        self.freq[tokens] = freqs
        self.before = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        self.token_at = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        """Counts scaled to a sum of 2**SCALE, each at least 1; the largest take up the rounding."""
        whole = 1 << SCALE
        if len(counts) > whole:
            raise ValueError(f"more than {whole} different ids")
        spare = whole - len(counts)
        freqs = 1 + (counts.astype(np.float64) / counts.sum() * spare).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        left = whole - int(freqs.sum())
        while left > 0:
            step = order[:left]
            freqs[step] += 1
            left -= len(step)
        while left < 0:
            step = order[freqs[order] > 1][:-left]
            freqs[step] -= 1
            left += len(step)
        return freqs


def encode_blocks(blocks: list[np.ndarray], table: Frequencies, pad: int) -> list[tuple[bytes, bytes]]:
    """Stream and checkpoints of each block; all blocks step together, from the last id to the first."""
    order = sorted(range(len(blocks)), key=lambda b: -len(blocks[b]))
    steps = np.array([-(-len(blocks[b]) // LANES) for b in order])
    longest = int(steps[0])
    ids = np.full((longest, len(blocks) * LANES), pad, np.uint32)
    for row, b in enumerate(order):
        own = np.full(int(steps[row]) * LANES, pad, np.uint32)
        own[:len(blocks[b])] = blocks[b]
        ids[:steps[row], row * LANES:(row + 1) * LANES] = own.reshape(-1, LANES)
    state = np.full(ids.shape[1], LOW, np.uint64)
    sent = np.zeros(ids.shape, bool)
    words = np.zeros(ids.shape, np.uint32)
    saved: dict[int, np.ndarray] = {}
    active_at = np.searchsorted(-steps, -np.arange(longest), "left") * LANES  # lanes with more than t steps
    room = np.uint64(63 - SCALE)
    for t in range(longest - 1, -1, -1):
        n = active_at[t]
        x, token = state[:n], ids[t, :n]
        f = table.freq[token]
        out = x >= f << room
        sent[t, :n] = out
        words[t, :n] = x.astype(np.uint32)
        x = np.where(out, x >> _WORD, x)
        q = x // f
        state[:n] = (q << _SCALE) + (x - q * f) + table.before[token]
        if t % CHECKPOINT_STEPS == 0:
            saved[t] = state.copy()
    found: list[tuple[bytes, bytes]] = [(b"", b"")] * len(blocks)
    for row, b in enumerate(order):
        lanes = slice(row * LANES, (row + 1) * LANES)
        out = sent[:steps[row], lanes]
        at = np.concatenate([[0], np.cumsum(out.sum(1))])
        marks = [np.concatenate([[np.uint64(at[t])], saved[t][lanes]]) for t in range(0, int(steps[row]), CHECKPOINT_STEPS)]
        found[b] = words[:steps[row], lanes][out].astype("<u4").tobytes(), np.concatenate(marks).astype("<u8").tobytes()
    return found


def decode_blocks(blocks: list[tuple[int, bytes, bytes]], table: Frequencies) -> list[np.ndarray]:
    """Ids of blocks given as (number of ids, stream, checkpoints); all stretches step together."""
    stream = np.frombuffer(b"".join(w for _, w, _ in blocks), "<u4")
    base, begin, states, length = 0, [], [], []
    for n, words, marks in blocks:
        marks = np.frombuffer(marks, "<u8").reshape(-1, LANES + 1)
        steps = -(-n // LANES)
        begin.append(marks[:, 0].astype(np.int64) + base)
        states.append(marks[:, 1:])
        length += [min(CHECKPOINT_STEPS, steps - at) for at in range(0, steps, CHECKPOINT_STEPS)]
        base += len(words) // 4
    order = np.argsort(-np.array(length), kind="stable")
    length = np.array(length)[order]
    at, state = np.concatenate(begin)[order], np.concatenate(states)[order].copy()
    ids = np.zeros((len(length), int(length[0]), LANES), np.uint32)
    for t in range(int(length[0])):
        n = int(np.searchsorted(-length, -t, "left"))
        x = state[:n]
        slot = x & _MASK
        token = table.token_at[slot]
        ids[:n, t] = token
        x = table.freq[token] * (x >> _SCALE) + slot - table.before[token]
        low = x < LOW
        place = at[:n, None] + np.cumsum(low, axis=1) - 1
        x[low] = x[low] << _WORD | stream[place[low]]
        at[:n] = place[:, -1] + 1
        state[:n] = x
    row_of = np.empty(len(order), np.int64)
    row_of[order] = np.arange(len(order))
    found, first = [], 0
    for n, _, _ in blocks:
        count = -(-(-(-n // LANES)) // CHECKPOINT_STEPS)
        parts = [ids[r, :length[r]].reshape(-1) for r in row_of[first:first + count]]
        found.append(np.concatenate(parts)[:n])
        first += count
    return found


def _tokenise(path: str, end_id: int):
    """Documents as zstandard-packed ids, the end id included: 16 bit where the vocabulary allows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = library_encoder(path, True), zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for batch in text_groups(whole):
                packed = []
                for coded in encoder.ids_of(batch.column(1).to_pylist()):
                    ids = np.append(np.frombuffer(coded, "<u4"), np.uint32(end_id))
                    small = int(ids.max()) < 1 << 16
                    packed.append((b"2" if small else b"4") + squeeze(ids.astype("<u2" if small else "<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    return run


def _unpacked(packed: list[bytes]) -> Iterator[np.ndarray]:
    """The ids of each packed document, unsigned 32 bit."""
    unsqueeze = zstandard.ZstdDecompressor().decompress
    for one in packed:
        yield np.frombuffer(unsqueeze(one[1:]), "<u2" if one[:1] == b"2" else "<u4").astype("<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1, np.int64)
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            new = np.bincount(np.concatenate(list(_unpacked(whole.slice(at, 256).column(0).to_pylist()))))
            if len(new) > len(counts):
                counts, new = new, counts
            counts[:len(new)] += new
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["token", "n"])


def write_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                    tokenizer_path: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text and write the files described above, ascending by id (nulls first).

    The texts are read and tokenised once; their packed ids are stored. These are
    counted (one row per distinct id and task reaches the shuffle, one per
    distinct id, a vocabulary at most, the driver) and sorted by id range; each
    range is coded as one shard.
    The rows of one id can be spread over shards. A null text is an empty one:
    the end id alone. An empty table makes two empty tables.
    """
    vocabulary = tokenizer_path or public_tokenizers.path(VOCABULARY)
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    own = written(pick(docs, doc_id=id_col, text=text_col).mapInArrow(
        _tokenise(vocabulary, end_id), f"doc_id {kind}, packed binary"), "tokens")
    counted = own.select("packed").mapInArrow(_count, "token bigint, n bigint")
    counts = counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy("token").collect()
    tokens = np.array([r.token for r in counts], np.int64)
    freqs = Frequencies.scaled(np.array([r.n for r in counts], np.int64)) if counts else tokens
    rows = list(zip(tokens.tolist(), freqs.tolist()))
    spark.createDataFrame(rows, "token bigint, freq bigint").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((tokens, freqs))  # bounded by the vocabulary

    def code(group: list, table: Frequencies) -> pa.RecordBatch:
        blocks = [np.concatenate(texts) for _, _, texts, _, _ in group]
        coded = encode_blocks(blocks, table, end_id)
        columns = [
            pa.array([TaskContext.get().partitionId()] * len(group), pa.int32()),
            pa.array([number for number, _, _, _, _ in group], pa.int32()),
            pa.array([start for _, start, _, _, _ in group], pa.int64()),
            pa.array([len(b) for b in blocks], pa.int64()),
            pa.array([ids for _, _, _, ids, _ in group], pa.list_(group[0][4])),
            pa.array([[len(t) for t in texts] for _, _, texts, _, _ in group], pa.list_(pa.int64())),
            pa.array([w for w, _ in coded], pa.binary()), pa.array([c for _, c in coded], pa.binary()),
            pa.array([zlib.crc32(b.tobytes()) for b in blocks], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _blocks_schema(kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, group, held, number, start = None, [], 0, 0, 0  # closed blocks and their ids; the next block and its place
        texts, ids, size, id_type = [], [], 0, None
        for whole in batches:
            table = table or Frequencies(*shared.value)
            id_type = whole.schema.field(0).type
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for doc_id, coded in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1).to_pylist())):
                    if size and size + len(coded) > BLOCK_TOKENS:
                        group.append((number, start, texts, ids, id_type))
                        number, start, held = number + 1, start + size, held + size
                        texts, ids, size = [], [], 0
                        if held >= _TOGETHER:
                            yield code(group, table)
                            group, held = [], 0
                    if len(coded) > 2 * BLOCK_TOKENS and group:  # a long one would make the others' matrix long
                        yield code(group, table)
                        group, held = [], 0
                    texts.append(coded)
                    ids.append(doc_id)
                    size += len(coded)
                    if size > 2 * BLOCK_TOKENS:
                        yield code([(number, start, texts, ids, id_type)], table)
                        number, start, texts, ids, size = number + 1, start + size, [], [], 0
        if texts:
            group.append((number, start, texts, ids, id_type))
        if group:
            yield code(group, table)

    ranged = own.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("doc_id", "row")
    ordered = ranged.sortWithinPartitions("doc_id", "row").drop("row")
    ordered.mapInArrow(run, ", ".join(_blocks_schema(kind))).write.parquet(f"{path}/blocks")
    shared.unpersist()


def _blocks_schema(kind: str) -> list[str]:
    return ["shard int", "block int", "start bigint", "n_tokens bigint", f"doc_ids array<{kind}>",
            "doc_tokens array<bigint>", "words binary", "checkpoints binary", "crc32 bigint"]


def read_documents(spark: SparkSession, path: str, id_kind: str = "bigint", with_ids: bool = False) -> DataFrame:
    """Decode the files of ``write_documents``: ``doc_id``, ``start``, ``n_tokens``,
    ``ids_crc32`` and, with ``with_ids``, ``ids``. A block whose checksum differs fails the job."""
    rows = spark.read.schema("token bigint, freq bigint").parquet(f"{path}/table").collect()  # a vocabulary at most
    shared = spark.sparkContext.broadcast((np.array([r.token for r in rows], np.int64), np.array([r.freq for r in rows], np.int64)))
    names = ["shard", "doc_id", "start", "n_tokens", "ids_crc32", "ids"][:6 if with_ids else 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for whole in batches:
            table = table or Frequencies(*shared.value)
            sizes, at = whole.column(2).to_pylist(), 0
            while at < whole.num_rows:
                to, held = at + 1, sizes[at]
                while to < whole.num_rows and held + sizes[to] <= _TOGETHER // 4:
                    held, to = held + sizes[to], to + 1
                part = whole.slice(at, to - at).to_pydict()
                blocks = decode_blocks(list(zip(part["n_tokens"], part["words"], part["checkpoints"])), table)
                yield from _documents(part, blocks, whole.schema.field(3).type.value_type)
                at = to

    def _documents(part: dict, blocks: list[np.ndarray], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for i, ids in enumerate(blocks):
            raw = ids.astype("<u4").tobytes()
            if zlib.crc32(raw) != part["crc32"][i]:
                raise ValueError(f"checksum of block {part['block'][i]} in shard {part['shard'][i]} differs")
            ends = np.cumsum(part["doc_tokens"][i])
            starts = ends - part["doc_tokens"][i]
            spans = [raw[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
            found = [pa.array([part["shard"][i]] * len(spans), pa.int32()), pa.array(part["doc_ids"][i], id_type),
                     pa.array(starts + part["start"][i]), pa.array(part["doc_tokens"][i], pa.int64()),
                     pa.array([zlib.crc32(s) for s in spans], pa.int64())]
            if with_ids:
                found.append(pa.array(spans, pa.binary()))
            yield pa.RecordBatch.from_arrays(found, names=names)

    blocks = spark.read.schema(", ".join(_blocks_schema(id_kind))).parquet(f"{path}/blocks")
    # the shards' places: one row per shard, as many as the writing job had tasks
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("size")).withColumn(
        "base", F.sum("size").over(W.orderBy("shard")) - F.col("size")).select("shard", "base")
    schema = f"shard int, doc_id {id_kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    decoded = blocks.select("shard", "block", "n_tokens", "doc_ids", "doc_tokens", "words", "checkpoints", "crc32", "start").mapInArrow(run, schema)
    return decoded.join(F.broadcast(shards), "shard").withColumn("start", F.col("start") + F.col("base")).drop("shard", "base")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "rans")
    write_documents(read(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
