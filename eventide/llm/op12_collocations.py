"""Phrase collocations from exact phrase counts in counting quotient filters.

1. Blocks: a task cuts its texts into pieces and words and stores them block by block as
   numbers of a block's own word list, with the words' counts.
2. Words: counts per language; a phrase is frequent only if its words are, so only frequent
   words get an id, dense over all languages (so an id names its language too). Each block's
   list is joined with the ids: the vocabulary is never broadcast.
3. Filters: the word ids of a phrase are packed into one number, an
   invertible permutation mixes it, and its high bits (shard and quotient) place it while
   all remaining bits are kept as the remainder. So a filter, which stores a bit vector of
   quotients and runs, the remainders and counters of variable length, loses nothing.
   A block emits one filter of its pairs of words per shard; a shard merges its sorted filters, undoes the
   permutation for pairs that are frequent enough, and replies to each filter with one bit per entry.
4. A longer phrase is frequent only if all its pairs are: blocks send filters of those in a second round.
5. Scores, containment and ranks are joins of the frequent phrases, in DataFrame operations.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.llm.common import dropped, pick, read, small_batches, written

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
#: A longer phrase with this share (in hundredths) of a candidate's count replaces it.
CONTAINED = 80
#: Characters of text per block, and distinct phrases of one length in a shard, at most.
BLOCK_BYTES, SHARD_PHRASES = 16 << 20, 2_000_000
#: A-Z to a-z, every character that ends a piece to ``.``, tab to space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def tokens(text: str | None) -> list[bytes]:
    """Words of a whole text, lower-cased; ``b"."`` stands between pieces."""
    return (text or "").encode().translate(_FOLD).replace(b".", b" . ").split(b" ")


# ---------------------------------------------------------------- packed phrases and their permutation

def _scramble(half: np.ndarray, constant: int, bits: int) -> np.ndarray:
    """A hash of ``half`` of ``bits`` bits."""
    x = half * np.uint64(constant)
    x ^= x >> np.uint64(29)
    x *= np.uint64(_MIX[1])
    return (x ^ x >> np.uint64(32)) & np.uint64((1 << bits) - 1)


def permute(x: np.ndarray, y: np.ndarray, x_bits: int, y_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Invertible permutation of the numbers ``x << y_bits | y``: rounds that add to one half a hash of the other."""
    for i in range(0, len(_MIX), 2):
        y = y ^ _scramble(x, _MIX[i], y_bits)
        x = x ^ _scramble(y, _MIX[i + 1], x_bits)
    return x, y


def unpermute(x: np.ndarray, y: np.ndarray, x_bits: int, y_bits: int) -> tuple[np.ndarray, np.ndarray]:
    for i in reversed(range(0, len(_MIX), 2)):
        x = x ^ _scramble(y, _MIX[i + 1], x_bits)
        y = y ^ _scramble(x, _MIX[i], y_bits)
    return x, y


def _halves(n: int, id_bits: int) -> tuple[int, int]:
    """Bits of the two halves of a packed phrase of ``n`` words."""
    return (n + 1) // 2 * id_bits, n // 2 * id_bits


def pack(ids: list[np.ndarray], id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the packed phrases whose first, second, ... word ids are ``ids``."""
    first = (len(ids) + 1) // 2

    def joined(parts):
        out = parts[0].astype(np.uint64)
        for p in parts[1:]:
            out = out << np.uint64(id_bits) | p.astype(np.uint64)
        return out

    return joined(ids[:first]), joined(ids[first:])


def unpack(x: np.ndarray, y: np.ndarray, n: int, id_bits: int) -> list[np.ndarray]:
    first, mask = (n + 1) // 2, np.uint64((1 << id_bits) - 1)
    spread = [(half >> np.uint64(id_bits * i) & mask).astype(np.int64) for half, k in ((x, first), (y, n - first)) for i in reversed(range(k))]
    return spread


def counted(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None, y_bits: int, one_word: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (x, y) and their counts, added up."""
    if len(x) == 0:
        return x, y, np.zeros(0, np.int64)
    if one_word:  # both halves fit one machine word
        key = x << np.uint64(y_bits) | y
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
    else:
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        counts = None if counts is None else counts[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    starts = np.flatnonzero(new)
    total = np.diff(np.append(starts, len(new))) if counts is None else np.add.reduceat(counts, starts)
    if one_word:
        key = key[starts]
        return key >> np.uint64(y_bits), key & np.uint64((1 << y_bits) - 1), total.astype(np.int64)
    return x[starts], y[starts], total.astype(np.int64)


# ---------------------------------------------------------------- the filter

class QuotientFilter:
    """Sorted phrases as quotient bits, full remainders and counters; all from and to plain arrays.

    The quotient is the high ``q`` bits of ``x`` below the shard's bits. ``bits``
    has, for each quotient, one 1 per remainder of its run and a closing 0. A counter
    is one byte; 255 points to the next number of ``large``.
    """

    @staticmethod
    def dump(x: np.ndarray, y: np.ndarray, counts: np.ndarray, low_bits: int, q: int, y_bits: int) -> dict[str, bytes]:
        rest = low_bits - q
        quotients = (x >> np.uint64(rest)).astype(np.int64) & ((1 << q) - 1)
        bits = np.zeros((1 << q) + len(x), np.uint8)
        bits[quotients + np.arange(len(x))] = 1
        tail = [(x & np.uint64((1 << rest) - 1), rest), (y, y_bits)]
        if rest + y_bits <= 64:
            tail = [(tail[0][0] << np.uint64(y_bits) | y, rest + y_bits)]
        return {"bits": np.packbits(bits).tobytes(), "rests": b"".join(_narrow(v, w) for v, w in tail),
                "counters": np.minimum(counts, 255).astype(np.uint8).tobytes(), "large": counts[counts >= 255].astype("<i8").tobytes()}

    @staticmethod
    def load(row: dict, size: int, shard: int, low_bits: int, q: int, y_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest = low_bits - q
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=(1 << q) + size)
        at = np.flatnonzero(bits)
        quotients = (at - np.arange(size)).astype(np.uint64)
        if rest + y_bits <= 64:
            both, _ = _widen(row["rests"], 0, size, rest + y_bits)
            low, y = both >> np.uint64(y_bits), both & np.uint64((1 << y_bits) - 1)
        else:
            low, end = _widen(row["rests"], 0, size, rest)
            y, _ = _widen(row["rests"], end, size, y_bits)
        counts = np.frombuffer(row["counters"], np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(row["large"], "<i8")
        return np.uint64(shard << low_bits) | quotients << np.uint64(rest) | low, y, counts


def _narrow(values: np.ndarray, bits: int) -> bytes:
    """Numbers of ``bits`` bits as that many whole bytes each."""
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return wide[:, :(bits + 7) // 8].tobytes()


def _widen(data: bytes, at: int, size: int, bits: int) -> tuple[np.ndarray, int]:
    width = (bits + 7) // 8
    wide = np.zeros((size, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, size * width, at).reshape(size, width)
    return wide.view("<u8").ravel().astype(np.uint64), at + size * width


# ---------------------------------------------------------------- blocks and words

def planes(ids: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: all lowest bytes first. The high bytes, mostly equal, compress well."""
    return ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


_BLOCK_DDL = "lang string, words array<binary>, counts array<bigint>, ids binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of one language: its distinct words, their counts, and the text as their numbers (0: between pieces). Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(lang, words, parts):
            ids = np.concatenate(parts)
            counts = np.bincount(ids, minlength=len(words) + 1)[1:]
            row = [[lang], [list(words)], [counts.tolist()], [planes(ids)]]
            kinds = [pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["lang", "words", "counts", "ids"])

        held, size = {}, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = [t for t in tokens(text) if t]
                    words, parts = held.setdefault(lang, (defaultdict(count(1).__next__), []))
                    own = np.fromiter((0 if t == b"." else words[t] for t in found), np.int32, len(found))
                    parts.append(np.append(own, np.int32(0)))  # phrases do not cross texts
                    size += len(text or "") + 8
                    if size >= BLOCK_BYTES:
                        for name, (words, parts) in held.items():
                            yield block(name, words, parts)
                        held, size = {}, 0
        for name, (words, parts) in held.items():
            yield block(name, words, parts)

    cut = docs.select("lang", "text").mapInArrow(run, _BLOCK_DDL)
    return written(cut.withColumn("block", F.monotonically_increasing_id()), "blocks")  # numbered once, stored


def _frequent_words(blocks: DataFrame, min_count: int) -> DataFrame:
    """Where frequent words are: ``block``, ``place`` in its list, ``id``; ``lang``, ``word``, ``n`` in one row of each word. Stored.

    Words are dealt by hash into as many parts as tasks, and a part's words are counted and numbered in one sort: id = number * parts +
    part, so ids are dense but for the parts' uneven sizes. As many rows as the blocks have distinct words are shuffled, once.
    """
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select(
        "block", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("own"))
    dealt = each.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))
    same = W.partitionBy("part").orderBy("lang", "word")
    total = F.sum("own").over(same.rangeBetween(W.currentRow, W.currentRow))
    kept = dealt.withColumn("n", total).where(F.col("n") >= min_count)
    rank = F.dense_rank().over(same)
    kept = kept.withColumn("id", ((rank - 1) * parts + F.col("part")).cast("bigint")).withColumn("before", F.lag("id").over(same))
    first = F.col("before").isNull() | (F.col("before") != F.col("id"))
    return written(kept.select("block", "place", "id", *[F.when(first, F.col(c)).alias(c) for c in ("lang", "word", "n")]), "word-places")


def _coded(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """``block`` and its text as word ids plus one (0: a rare word, or between pieces). Stored."""
    known = places.groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                row = whole.slice(at, 1)
                own = row.column("known").flatten()
                ids = np.zeros(row.column("size")[0].as_py() + 1, np.int32)
                ids[own.field("place").to_numpy() + 1] = own.field("id").to_numpy() + 1
                text = ids[from_planes(row.column("ids")[0].as_buffer())]
                yield pa.RecordBatch.from_arrays([row.column("block"), pa.array([planes(text)], pa.binary())], names=["block", "ids"])

    joined = blocks.select("block", "ids", F.size("words").alias("size")).join(known, "block")
    return written(joined.mapInArrow(run, "block bigint, ids binary"), "coded")


# ---------------------------------------------------------------- phrases

def _phrases_of(ids: np.ndarray, at: np.ndarray, n: int, id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Permuted phrases of ``n`` words that begin at the places ``at``."""
    return permute(*pack([ids[at + i] - 1 for i in range(n)], id_bits), *_halves(n, id_bits))


def _by_shard(x: np.ndarray, low_bits: int, shards: int) -> np.ndarray:
    """Bounds of the shards in sorted ``x``."""
    return np.searchsorted(x >> np.uint64(low_bits), np.arange((1 << shards) + 1, dtype=np.uint64))


def _filters(coded: DataFrame, id_bits: int, shard_bits: int, lengths: range) -> DataFrame:
    """A filter per block, phrase length and shard. With ``masks`` in ``coded``, only phrases whose pairs are all frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                row = whole.slice(at, 1)
                ids = from_planes(row.column("ids")[0].as_buffer()).astype(np.int64)
                linked = (ids[:-1] > 0) & (ids[1:] > 0)  # pairs of frequent words
                if "masks" in row.schema.names:
                    linked = _frequent_pairs(ids, linked, row.column("masks")[0].as_py() or [], id_bits, shard_bits)
                for n in lengths:
                    x_bits, y_bits = _halves(n, id_bits)
                    starts = linked[:max(0, len(linked) - n + 2)].copy()
                    for i in range(1, n - 1):
                        starts &= linked[i:len(starts) + i]
                    x, y = _phrases_of(ids, np.flatnonzero(starts), n, id_bits)
                    x, y, counts = counted(x, y, None, y_bits, x_bits + y_bits <= 64)
                    low_bits = x_bits - shard_bits
                    bounds = _by_shard(x, low_bits, shard_bits)
                    out = []
                    for shard in np.flatnonzero(np.diff(bounds)).tolist():
                        a, b = bounds[shard], bounds[shard + 1]
                        q = min(low_bits, max(1, int(b - a).bit_length()))
                        out.append({"block": row.column("block")[0].as_py(), "n": n, "shard": shard, "size": int(b - a), "q": q,
                                    **QuotientFilter.dump(x[a:b], y[a:b], counts[a:b], low_bits, q, y_bits)})
                    if out:
                        yield pa.RecordBatch.from_pylist(out, _FILTER)

    return coded.mapInArrow(run, _FILTER_DDL)


def _frequent_pairs(ids: np.ndarray, linked: np.ndarray, masks: list[dict], id_bits: int, shard_bits: int) -> np.ndarray:
    """``linked``, but only for pairs that the shards' replies mark: one bit per entry of the block's filter of pairs."""
    x_bits, y_bits = _halves(2, id_bits)
    at = np.flatnonzero(linked)
    x, y = _phrases_of(ids, at, 2, id_bits)
    pair = x << np.uint64(y_bits) | y  # 2 * id_bits <= 64
    entries, place = np.unique(pair, return_inverse=True)
    bounds = _by_shard(entries >> np.uint64(y_bits), x_bits - shard_bits, shard_bits)
    frequent = np.zeros(len(entries), bool)
    for m in masks:
        a, b = bounds[m["shard"]], bounds[m["shard"] + 1]
        frequent[a:b] = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=int(b - a)).astype(bool)
    out = np.zeros(len(linked), bool)
    out[at] = frequent[place]
    return out


_FILTER = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("shard", pa.int32()), ("size", pa.int64()), ("q", pa.int32()), ("bits", pa.binary()),
                     ("rests", pa.binary()), ("counters", pa.binary()), ("large", pa.binary())])
_FILTER_DDL = "block bigint, n int, shard int, size bigint, q int, bits binary, rests binary, counters binary, large binary"
_MERGED = pa.schema([("ids", pa.list_(pa.int64())), ("a", pa.int64()), ("block", pa.int64()), ("shard", pa.int32()), ("mask", pa.binary())])


def _merged(filters: DataFrame, id_bits: int, shard_bits: int, min_count: int, reply: bool) -> DataFrame:
    """Frequent phrases (``ids``, ``a``) of all filters: each shard's sorted filters merged, like sizes first. With ``reply`` also one row
    per filter (``block``, ``shard``, ``mask``): which of its phrases are frequent. A shard holds its filters meanwhile."""

    def phrases(n: int, shard: int, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        x_bits, y_bits = _halves(n, id_bits)
        low_bits, one_word = x_bits - shard_bits, x_bits + y_bits <= 64
        stack, held = [], []
        for row in rows:
            own = QuotientFilter.load(row, row["size"], shard, low_bits, row["q"], y_bits)
            if reply:
                held.append((row["block"], own[0] << np.uint64(y_bits) | own[1]))
            stack.append(own)
            while len(stack) > 1 and len(stack[-1][0]) * 2 >= len(stack[-2][0]):
                last, other = stack.pop(), stack.pop()
                stack.append(counted(*[np.concatenate(c) for c in zip(other, last)], y_bits, one_word))
        x, y, counts = counted(*[np.concatenate(c) for c in zip(*stack)], y_bits, one_word)
        kept = np.flatnonzero(counts >= min_count)
        frequent = x[kept] << np.uint64(y_bits) | y[kept]
        for block, own in held:
            at = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
            found = frequent[at] == own if len(frequent) else np.zeros(len(own), bool)
            if found.any():
                yield _result([None], [None], [block], [shard], [np.packbits(found).tobytes()])
        ids = unpack(*unpermute(x[kept], y[kept], x_bits, y_bits), n, id_bits)
        for a in range(0, len(kept), 8192):
            size = len(kept[a:a + 8192])
            flat = np.stack([i[a:a + 8192] for i in ids], axis=1).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * n), pa.array(flat))
            yield _result(lists, counts[kept[a:a + 8192]], [None] * size, [None] * size, [None] * size)

    def _result(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _MERGED)], schema=_MERGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(batch.num_rows):
                    yield batch.slice(at, 1).to_pylist()[0]

        stream = rows()
        pending = next(stream, None)
        while pending:
            now = (pending["n"], pending["shard"])

            def own():
                nonlocal pending
                while pending and (pending["n"], pending["shard"]) == now:
                    row, pending = pending, next(stream, None)
                    yield row

            yield from phrases(*now, own())

    tasks = int(filters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = filters.repartition(tasks, "n", "shard").sortWithinPartitions("n", "shard")
    return written(dealt.mapInArrow(run, "ids array<bigint>, a bigint, block bigint, shard int, mask binary"), "phrases")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (``ids``, ``a``) of 1 to ``longest`` words, their words (``lang``, ``word``, ``n``, ``id``), and word totals (``lang``, ``n``).

    ``docs`` has ``lang`` (no null) and ``text``.
    """
    blocks = _blocks(docs)
    totals = written(blocks.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (s, c) -> s + c)")).alias("n")).where("n > 0"), "totals")
    places = _frequent_words(blocks, min_count)
    words = places.where("word IS NOT NULL").select("lang", "word", "n", "id")
    most = words.agg(F.max("id")).first()[0] or 1
    id_bits = most.bit_length()
    if id_bits > 31:
        raise ValueError(f"{most} frequent words: packed phrases hold up to 2^31 of them")
    coded = _coded(blocks, places)
    positions = totals.agg(F.sum("n")).first()[0] or 0  # an upper bound of the distinct phrases of each length
    shard_bits = min((positions // SHARD_PHRASES).bit_length(), id_bits - 1)
    pairs = _merged(_filters(coded, id_bits, shard_bits, range(2, 3)), id_bits, shard_bits, min_count, True)
    masks = pairs.where("mask IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("shard", "mask")).alias("masks"))  # one per shard at most
    longer = _merged(_filters(coded.join(masks, "block"), id_bits, shard_bits, range(3, longest + 1)), id_bits, shard_bits, min_count, False)
    found = pairs.unionByName(longer).where("ids IS NOT NULL").select("ids", "a").unionByName(words.select(F.array("id").alias("ids"), F.col("n").alias("a")))
    dropped(blocks, coded)
    return found, words, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST,
                 top: int | None = TOP) -> DataFrame:
    """The ``top`` phrases of each language (all with None): ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Counts are of all occurrences, overlaps included; a phrase lies within a piece
    of one text. Null text is empty, null language ``und``. The lowest-scoring cut counts, ties to the
    shortest first part; candidates inside a longer one with at least ``CONTAINED`` % of their count
    go. Ties of the rank: count, then phrase. Repeated rows count again; other columns are not
    read; an empty table, and one without a frequent phrase, gives no rows.
    """
    own = pick(docs, lang=lang_col, text=text_col)
    own = own.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):  # the counting is written, so it runs here
        phrases, words, totals = phrase_counts(own, min_count, longest)
    candidates = phrases.where(F.size("ids") >= 2)
    cuts = candidates.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("left"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    sides = cuts.join(phrases.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left").join(
        phrases.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr("cast(2000000 as decimal(20,0)) * a div (l + r)")
    best = sides.groupBy("ids").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    parts = candidates.where(F.size("ids") > 2).select("a", F.explode(F.expr(
        "flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), i -> slice(ids, i, m))))")).alias("ids"))
    longer = parts.groupBy("ids").agg(F.max("a").alias("longer"))
    kept = best.join(longer, "ids", "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * CONTAINED))
    kept = kept.select("ids", "a", "cut.*").join(words.select("lang", F.col("id").alias("first")), F.col("ids")[0] == F.col("first")).drop("first", "k")
    if top is not None:  # ties of score and count stay: their order needs the words
        among = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        kept = kept.withColumn("place", F.rank().over(among)).where(F.col("place") <= top).drop("place")
    named = kept.select("*", F.posexplode("ids").alias("i", "id")).join(words.select("id", "word"), "id").groupBy("ids", "lang", "a", "l", "r", "score").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(i, word))), w -> decode(w.word, 'UTF-8')), ' ')").alias("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def oracle_sql(min_count: int = MIN_COUNT, top: int = TOP) -> str:
    """The same for DuckDB (up to four words): phrases as strings, all of them."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = [f"lead(w, {i}) OVER same" for i in range(1, 4)]
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS n, array_to_string([{', '.join(['w', 'w2', 'w3', 'w4'][:n])}], ' ') AS phrase FROM ahead WHERE {['w', 'w2', 'w3', 'w4'][n - 1]} IS NOT NULL"
        for n in range(1, 5))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
pieces AS (SELECT r, lang, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM (SELECT r, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS ps FROM docs)),
each AS (SELECT r, lang, pi, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, lang, pi, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces)),
ahead AS (SELECT lang, w, {words[0]} AS w2, {words[1]} AS w3, {words[2]} AS w4 FROM each WINDOW same AS (PARTITION BY r, pi ORDER BY i)),
f AS (SELECT lang, n, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {min_count}),
cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE n >= 2),
cuts AS (SELECT *, unnest(range(1, n)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.n, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.n = k AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.n = c.n - k AND y.phrase = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, a, ws, n, unnest(range(2, n)) AS m FROM cand WHERE n > 2),
inside AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, n - m + 2)) AS i FROM parts)),
longer AS (SELECT lang, phrase, max(a) AS a FROM inside GROUP BY ALL),
total AS (SELECT lang, count(*) AS n FROM each GROUP BY lang),
ranked AS (
  SELECT b.lang, b.phrase, b.a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100::HUGEINT * o.a < {CONTAINED} * b.a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= {top}"""
