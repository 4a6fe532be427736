"""Byte-level BPE with a segment tree over byte positions.

Every leaf of the tree stands for a byte position and holds the rank of the pair
that starts at the live token there (its own token and the next live one), or
``NONE``. Leaves hold ``rank * width + position``, so the root is the leftmost pair
of least rank. A merge drops one position and changes two pairs: three point
updates, each a climb of log2(width) levels.

``merge_batch`` runs the same tree for many short matches at once, one row of a
matrix each; ``merge_one`` is the plain form for a single long match.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from eventide.llm.common import pick, read
from eventide.llm.tokens import PieceEncoder

RANKS = "byte_bpe_multi_50k.tiktoken"
NONE = np.int64(1) << 60
#: Longer matches take ``merge_one``: a wide row would make its whole batch wide.
BATCH_BYTES = 64
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks (= ids) from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class BytePairs:
    """Encoder and decoder over one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pairs = pairs

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_matches(self, matches: list[bytes]) -> list[bytes]:
        """Ids of each match as little-endian unsigned 32-bit bytes.

        A match that is itself a token is that token; the others are merged.
        """
        out: list[bytes] = [b""] * len(matches)
        by_width: dict[int, list[int]] = {}
        for i, match in enumerate(matches):
            rank = self.ranks.get(match)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(match) > BATCH_BYTES:
                out[i] = np.array(self.merge_one(match), "<u4").tobytes()
            elif match:
                by_width.setdefault(max(2, 1 << (len(match) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            for at in range(0, len(rows), 4096):
                part = rows[at:at + 4096]
                for i, ids in zip(part, self.merge_batch([matches[i] for i in part], width)):
                    out[i] = ids
        return out

    def merge_batch(self, matches: list[bytes], width: int) -> list[bytes]:
        """Merge matches of at most ``width`` bytes (a power of two), one tree per row."""
        n = len(matches)
        size = np.array([len(m) for m in matches], np.int64)
        raw = np.frombuffer(b"".join(m.ljust(width, b"\0") for m in matches), np.uint8).reshape(n, width)
        token = self.single[raw]
        place = np.arange(width)
        after = np.minimum(place + 1, size[:, None])  # next live position, or the size
        before = np.broadcast_to(place - 1, (n, width)).copy()
        live = place < size[:, None]
        tree = np.full((n, 2 * width), NONE)
        rank = self._rank(token[:, :-1], token[:, 1:])
        tree[:, width:-1] = np.where((rank >= 0) & live[:, 1:], rank * width + place[:-1], NONE)
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            least = tree[rows, 1]
            at, merged = least % width, least // width
            gone = after[rows, at]
            nxt = after[rows, gone]
            token[rows, at] = merged
            after[rows, at] = nxt
            live[rows, gone] = False
            inner = nxt < size[rows]
            before[rows[inner], nxt[inner]] = at[inner]
            self._point(tree, width, rows, gone, np.full(len(rows), NONE))
            pair = self._rank(merged, token[rows, np.minimum(nxt, width - 1)])
            self._point(tree, width, rows, at, np.where(inner & (pair >= 0), pair * width + at, NONE))
            prev = before[rows, at]
            has = prev >= 0
            pair = self._rank(token[rows[has], prev[has]], merged[has])
            self._point(tree, width, rows[has], prev[has], np.where(pair >= 0, pair * width + prev[has], NONE))
            rows = rows[tree[rows, 1] < NONE]
        ids = token[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _point(tree: np.ndarray, width: int, rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        """Set one leaf of each row's tree and refresh the nodes above it."""
        node = at + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def merge_one(self, match: bytes) -> list[int]:
        """Merge one match of any length."""
        n = len(match)
        width = 1 << max(1, (n - 1).bit_length())
        none, pairs = int(NONE), self.pairs
        token = [int(self.single[b]) for b in match]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        tree = [none] * (2 * width)

        def leaf(i: int) -> int:
            if i < 0 or after[i] >= n:
                return none
            rank = pairs.get(token[i] << 32 | token[after[i]])
            return none if rank is None else rank * width + i

        for i in range(n):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            merged, at = divmod(tree[1], width)
            gone = after[at]
            token[at], after[at], live[gone] = merged, after[gone], False
            if after[at] < n:
                before[after[at]] = at
            for i, value in ((gone, none), (at, leaf(at)), (before[at], leaf(before[at]))):
                node = (i if i >= 0 else gone) + width
                tree[node] = value
                while node > 1:
                    node >>= 1
                    tree[node] = min(tree[2 * node], tree[2 * node + 1])
        return [t for t, keep in zip(token, live) if keep]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian unsigned 32-bit ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, tuple[BytePairs, PieceEncoder]] = {}


def coder(path: str) -> tuple[BytePairs, PieceEncoder]:
    """The table and the text encoder of a rank file, loaded once per worker."""
    if path not in _LOADED:
        pairs = BytePairs(load_ranks(path))
        matches = regex.compile(public_tokenizers.PATTERN).findall

        def encode_many(texts: list[str]) -> list[bytes]:
            split = [[m.encode() for m in matches(t)] for t in texts]
            distinct = list({m for part in split for m in part})
            ids = dict(zip(distinct, pairs.encode_matches(distinct)))
            return [b"".join([ids[m] for m in part]) for part in split]

        _LOADED[path] = pairs, PieceEncoder(encode_many, spaced=True)
    return _LOADED[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    One row per input row: ``doc_id``, ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and, with ``with_ids``, ``ids`` (binary, unsigned 32 bit,
    little-endian) and ``decoded`` (binary). Null and empty texts give no ids and
    the digests of nothing; null ids and repeated rows stay as they are; other
    columns of the input are not read. The file of ranks has to lie at the same
    path on every executor. Rows are independent: no shuffle.
    """
    path = ranks_path or public_tokenizers.path(RANKS)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][:6 if with_ids else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, encoder = coder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = encoder.ids_of(batch.column(1).to_pylist())
                back = [pairs.decode(x) for x in ids]
                sha = [[hashlib.sha256(x).hexdigest() for x in part] for part in (ids, back)]
                found = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *map(pa.array, sha)]
                if with_ids:
                    found += [pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays(found, names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = SCHEMA.replace("bigint", kind, 1) + (", ids binary, decoded binary" if with_ids else "")
    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))
