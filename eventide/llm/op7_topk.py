"""Exact top-k inner products with vector-approximation files.

Candidates are stored in blocks: for every coordinate the block's range is cut into
``2**BITS`` cells, and a vector's approximation is its cell numbers. For a block of
queries the approximations are scanned first: cells give an upper and a lower
bound of every score. The k-th largest lower bound discards most vectors; the
exact vectors of the others are read in the order of their upper bounds until no
unread one can still reach the k-th score. Query blocks meet candidate blocks through
an equi-join on the block number; each meeting is one small piece of work whose
result is k rows per query, and the best k per query remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.llm.common import pick, read, written

K, SCALE, EVERY = 5, 256, 50
BITS, CANDIDATES, QUERIES = 6, 4096, 512
_EXACT = 2.0 ** 53  # sums below are exact in double precision
_CHUNK = 32


def cells(vectors: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers (n, d) and cell edges (cells + 1, d) over each coordinate's range."""
    low, high = vectors.min(0), vectors.max(0)
    steps = np.linspace(0.0, 1.0, (1 << bits) + 1)[:, None]
    edges = np.floor(low + steps * (high - low))
    edges[0], edges[-1] = low, high
    found = np.empty(vectors.shape, np.uint8)
    for j in range(vectors.shape[1]):
        found[:, j] = np.clip(np.searchsorted(edges[:, j], vectors[:, j], "right") - 1, 0, (1 << bits) - 1)
    return found, edges


def _whole(x: float, scale: int) -> int:
    """``scale * x``, a whole number that may pass the doubles."""
    return int(x * scale) if abs(x) < _EXACT else int(x) * scale


def _long(score: int) -> int:
    """A score cut to 64 bits."""
    return max(-(1 << 63), min((1 << 63) - 1, score))


def best(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, approx: np.ndarray, edges: np.ndarray,
         ids: np.ndarray, rows: np.ndarray, k: int = K, scale: int = 1) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query; ties to the smaller id; not its own row.

    ``queries`` and ``vectors`` are ``scale``-ths of whole numbers, cells are of the whole numbers.
    """
    divided = queries, vectors
    with np.errstate(over="ignore"):
        queries, vectors = queries * scale, vectors * scale
        reach = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, vectors.shape[1])
    if not reach < _EXACT:  # too large for exact doubles: whole numbers of any size
        asked, whole = ([[_whole(x, scale) for x in v] for v in side.tolist()] for side in divided)
        for q, own in enumerate(asked):
            scored = [(-_long(sum(map(int.__mul__, own, v))), int(ids[c]), c) for c, v in enumerate(whole) if rows[c] != query_rows[q]]
            for score, _, c in sorted(scored)[:k]:
                yield q, c, -score
        return
    at = np.arange(vectors.shape[1])
    low, high = edges[approx, at], edges[approx + 1, at]
    middle, half = (low + high) / 2, (high - low) / 2
    centre, width = queries @ middle.T, np.abs(queries) @ half.T
    upper, lower = centre + width, centre - width
    own_query, own_candidate = np.nonzero(query_rows[:, None] == rows[None, :])
    upper[own_query, own_candidate] = lower[own_query, own_candidate] = -np.inf
    n = vectors.shape[0]
    floor = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(queries), -np.inf)
    for q, query in enumerate(queries):
        may = np.flatnonzero((upper[q] >= floor[q]) & (upper[q] > -np.inf))
        may = may[np.lexsort((ids[may], -upper[q][may]))]
        top: list[tuple[float, int, int]] = []
        for first in range(0, len(may), _CHUNK):
            if len(top) == k and upper[q][may[first]] < -top[-1][0]:
                break
            part = may[first:first + _CHUNK]
            scores = vectors[part] @ query
            top = sorted(top + list(zip((-scores).tolist(), ids[part].tolist(), part.tolist())))[:k]
        for score, _, c in top:
            yield q, c, int(-score)


def _blocks(rows: DataFrame, size: int, approximate: bool, scale: int) -> DataFrame:
    """Rows (row, id, vector) of a task as blocks of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            row, ids, parts = zip(*waiting.pop(dim))
            vectors = np.array(parts, np.float64).reshape(len(row), dim)
            found = [pa.array([dim], pa.int32()), pa.array([np.array(row, "<i8").tobytes()], pa.binary()),
                     pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([vectors.astype("<f8").tobytes()], pa.binary())]
            names = ["dim", "rows", "ids", "vectors"]
            if approximate:
                approx, edges = cells(np.clip(vectors, -_EXACT, _EXACT) * scale)  # larger ones are not looked up by cells
                found += [pa.array([approx.tobytes()], pa.binary()), pa.array([edges.astype("<f8").tobytes()], pa.binary())]
                names += ["approx", "edges"]
            return pa.RecordBatch.from_arrays(found, names=names)

        for batch in batches:
            for row, own, vector in zip(*(batch.column(k).to_pylist() for k in range(3))):
                waiting.setdefault(len(vector), []).append((row, own, vector))
                if len(waiting[len(vector)]) == size:
                    yield block(len(vector))
        for dim in list(waiting):
            yield block(dim)

    schema = "dim int, rows binary, ids binary, vectors binary" + (", approx binary, edges binary" if approximate else "")
    return rows.select("row", "id", "vector").mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          scale: int = SCALE) -> DataFrame:
    """The k highest integer scores of each query among all other rows.

    ``is_query`` selects the queries by the column ``id``. Components x become
    floor(scale * x), ``scale`` a power of two. Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``;
    ties go to the smaller id. Vectors that are null, empty or hold null or non-finite
    components and rows without an id take no part; a query meets vectors of its own length. Every
    row is a candidate once, also if its id repeats (each repeated query row has its own
    ranks); scores beyond 64 bits are cut to them before they are ranked. An empty table gives no rows.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError(f"the scale must be a power of two: {scale}")
    element = F.col("vector")
    usable = F.col("id").isNotNull() & element.isNotNull() & (F.size(element) > 0) & ~F.exists(
        element, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = pick(vectors, id=id_col, vector=vector_col).where(usable).select(
        F.monotonically_increasing_id().alias("row"), F.col("id").cast("bigint").alias("id"),
        F.col("vector").cast("array<double>").alias("vector"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            x = lists.flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                scaled = np.floor(scale * x)
            values = pa.array(np.where(np.isfinite(scaled), scaled / scale, x))  # exact: the scale is a power of two
            offsets = pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, values)],
                                             names=["row", "id", "vector"])

    stored = written(rows.mapInArrow(whole, "row bigint, id bigint, vector array<double>"), "vectors")
    candidates = written(_blocks(stored, CANDIDATES, True, scale), "candidates")
    queries = written(_blocks(stored.where(is_query), QUERIES, False, scale), "queries").withColumn("block", F.monotonically_increasing_id())
    queries = written(queries, "numbered")
    numbers = written(queries.select("dim", "block").withColumn(  # two numbers per query block
        "number", F.row_number().over(W.partitionBy("dim").orderBy("block"))), "numbers")
    count = numbers.groupBy("dim").agg(F.max("number").alias("last"))  # one row per vector length: small at any size
    asked = queries.join(numbers, ["dim", "block"]).select(
        "dim", "number", F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    meetings = candidates.join(F.broadcast(count), "dim").withColumn(
        "number", F.explode(F.sequence(F.lit(1), F.col("last")))).join(asked, ["dim", "number"]).select("dim", "rows", "ids", "vectors", "approx", "edges", "q_rows", "q_ids", "q_vectors")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                raw = [batch.column(j)[i].as_buffer() for j in range(1, 9)]
                row, ids, q_row, q_ids = (np.frombuffer(raw[j], "<i8") for j in (0, 1, 5, 6))
                own, edges, asked = (np.frombuffer(raw[j], "<f8").reshape(-1, dim) for j in (2, 4, 7))
                approx = np.frombuffer(raw[3], np.uint8).reshape(-1, dim)
                found = list(best(asked, q_row, own, approx, edges, ids, row, k, scale))
                if found:
                    q, c, score = (np.array(x, np.int64) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(q_row[q]), pa.array(q_ids[q]), pa.array(ids[c]), pa.array(row[c]), pa.array(score)],
                                                     names=["q_row", "query_id", "vec_id", "row", "score"])

    local = meetings.mapInArrow(meet, "q_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint")
    order = W.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


def oracle_sql() -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({SCALE} * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}"""
