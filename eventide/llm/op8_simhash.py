"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The perfect binary
Golay code (23, 12) covers every 23-bit word within distance three of exactly one codeword;
words at distance exactly three have five more codewords at distance four. If two
words differ in at most one bit, the nearest codeword of either is among the codewords
within four of the other: a fingerprint is stored under the numbers of its nearest codewords and
looked up under those of all nearby ones.

Three differing bits fall on the segments in one of two ways (pigeonhole):

* a segment has none and another at most one: the key is the whole first segment and the codeword
  number of the second (33 or 34 bits, six ordered pairs of segments);
* every segment has exactly one: the key is the codeword numbers of the first two segments and the
  half of the third that has none (34 or 35 bits, two halves).

Every link is met, and each candidate is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import pick, read, written
from eventide.llm.components import components

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
#: First bit and width of the three segments, and of the halves of the third.
SEGMENTS, HALVES = ((0, 22), (22, 21), (43, 21)), ((43, 11), (54, 10))
#: A generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
_BLOCK = 65_536


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text; zero if it has no words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters, ASCII white space only
    if not words:
        return 0
    if len(words) < shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, n = b" ".join(words), len(words) - shingle_words + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        to = min(n, at + _BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + shingle_words - 1:to + shingle_words - 1].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _syndrome(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; per syndrome the error
    patterns to the codewords nearby (the nearest first) and how many they are."""
    low = np.array([_syndrome(w) for w in range(1 << 12)], np.int64)
    high = np.array([_syndrome(w << 12) for w in range(1 << 11)], np.int64)
    unit = [_syndrome(1 << b) for b in range(23)]
    near, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            if weight < 4 or bin(int(near[s, 0])).count("1") == 3:
                near[s, count[s]] = sum(1 << b for b in bits)
                count[s] += 1
    return low, high, near, count


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the codewords near 23-bit words, shape (n, 6), the nearest first; how many count."""
    low, high, near, count = _tables()
    s = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ near[s]) >> 11, count[s]


def _bits(prints: np.ndarray, at: int, width: int) -> np.ndarray:
    return (prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)


def keys(prints: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key of each entry: eight per fingerprint, or all lookups if ``probe``."""
    segments = [_bits(prints, at, width) for at, width in SEGMENTS]
    near = [codewords(s) for s in segments]
    choices = range(6 if probe else 1)
    rows, found = [], []

    def add(kind: int, at: np.ndarray, exact: np.ndarray, numbers: np.ndarray) -> None:
        rows.append(at)
        found.append(kind << 36 | exact[at] << (24 if kind >= 6 else 12) | numbers)

    for kind, (i, j) in enumerate(permutations(range(3), 2)):
        code, count = near[j]
        for x in choices:
            at = np.flatnonzero(count > x)
            add(kind, at, segments[i], code[at, x])
    (first, n_first), (second, n_second) = near[:2]
    halves = [_bits(prints, at, width) for at, width in HALVES]
    for x in choices:
        for y in choices:
            at = np.flatnonzero((n_first > x) & (n_second > y))
            for kind, half in enumerate(halves, 6):
                add(kind, at, half, first[at, x] << 12 | second[at, y])
    return np.concatenate(rows), np.concatenate(found)


def _keyed(prints: DataFrame, probe: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                own = whole.slice(at, 2048).column(0).to_numpy()
                rows, found = keys(own.view(np.uint64), probe)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(own[rows])], names=["key", "fp"])

    return prints.mapInArrow(run, "key bigint, fp bigint")


def close_pairs(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs ``a < b`` (as signed numbers) of distinct fingerprints that differ in at most ``max_bits``.

    ``prints`` has one column ``fp`` without repeats.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the segments guarantee links of at most three differing bits")
    stored = _keyed(prints, False).select("key", F.col("fp").alias("b"))
    probes = _keyed(prints, True).select("key", F.col("fp").alias("a"))
    met = probes.join(stored, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return met.select("a", "b").distinct()


def _fingerprinted(docs: DataFrame, text_col: str, shingle_words: int) -> DataFrame:
    """``docs`` with a last column ``fp``: the fingerprint as a signed number."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                found = np.array([fingerprint(t, shingle_words) for t in batch.column(at).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, "fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def _least_members(rows: DataFrame, max_bits: int) -> DataFrame:
    """``fp`` and ``least``: the smallest ``member`` of the fingerprint's component. ``rows`` has ``fp`` and ``member``."""
    classes = written(rows.groupBy("fp").agg(F.min("member").alias("first")), "classes")
    roots = components(close_pairs(classes.select("fp"), max_bits))
    rooted = written(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")
    return written(rooted.join(least, "root").select("fp", "least"), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Fingerprint and component of every document.

    One row per input row: ``doc_id``, ``fingerprint`` (16 lower-case hex digits),
    ``component_id``. Words are runs outside ASCII white space, A-Z lower-cased.
    Texts of fewer words than a shingle are one shingle; null texts and texts
    without words have fingerprint zero and link like any other. Equal
    fingerprints are one node, so exact copies, however many, never become pairs.
    ``component_id`` is the smallest id of the component (null only if all its ids
    are null). Repeated rows stay; other input columns are not read; an empty
    table gives no rows.
    """
    own = pick(docs, doc_id=id_col, text=text_col)
    rows = written(_fingerprinted(own, "text", shingle_words).select("doc_id", "fp"), "fingerprints")
    labels = _least_members(rows.select("fp", F.col("doc_id").alias("member")), max_bits)
    return rows.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of ``near_duplicates``, all columns as they are: the one with the
    smallest id (null ids last; of rows with one id the first stored)."""
    found = _fingerprinted(docs, text_col, shingle_words).toDF(*[f"c{i}" for i in range(len(docs.columns))], "fp")
    # the numbers are stored: a second scan may be split otherwise and would count otherwise
    numbered = written(found.withColumn("row", F.monotonically_increasing_id()), "documents")
    own = F.col(f"c{docs.columns.index(id_col)}")
    rows = written(numbered.select("fp", F.struct(own.isNull().alias("without"), own.alias("id"), "row").alias("member")), "members")
    firsts = _least_members(rows, max_bits).select(F.col("least.row").alias("row")).distinct()
    return numbered.join(firsts, "row", "left_semi").drop("row", "fp").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
