"""Embedding near-duplicates by randomised-rotation binary codes.

Each distinct vector, scaled to length one and turned by a random rotation, is
stored as the signs of its coordinates (the code), the correction factor
``f = <code / sqrt(d), vector>``, and its turned coordinates in eight bits. For two
vectors ``<code of a, turned b> / (sqrt(d) f)`` is an unbiased estimate of their inner
product; its deviation is ``sqrt(1 - f^2) / f * sqrt(1 - c^2) / sqrt(d - 1)`` at the
true value c. A pair is recomputed exactly only if the estimate does not exclude the
threshold with confidence ``SIGMAS``.

Candidates share, in one of several tables, the signs along a few random
directions. The number of tables follows from the threshold: a pair exactly at it
is missed by all of them with probability ``MISS`` at most. Buckets larger than ``BLOCK``
are dealt into blocks, and blocks are compared pair by pair, each in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import pick, read, written
from eventide.llm.components import components

THRESHOLD, MISS, SIGMAS, BLOCK, SEED = 0.95, 1e-3, 4.5, 1024, 5


@lru_cache(maxsize=8)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random rotations of ``dim`` dimensions, stacked; the first one makes the codes."""
    rng = np.random.default_rng([SEED, dim])
    found = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        found.append(q * np.sign(np.diag(r)))
    return np.concatenate(found)


def table_plan(classes: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits per table, growing with the logarithm of the number of vectors, and the tables needed."""
    bits = min(30, max(4, round(math.log2(max(2, classes))) - 6))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if same >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def describe(vectors: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, ...]:
    """Table keys (n, tables), packed codes, eight-bit coordinates, their scale and the correction factors."""
    n, dim = vectors.shape
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ rotations(dim, 1 + -(-bits * tables // dim)).T
    signs = turned[:, dim:dim + bits * tables] > 0
    keys = signs.reshape(n, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
    own = turned[:, :dim]
    scale = np.maximum(np.abs(own).max(1), 1e-30) / 127
    return (keys.astype("<i4"), np.packbits(own > 0, axis=1), np.rint(own / scale[:, None]).astype(np.int8), scale,
            np.abs(own).sum(1) / math.sqrt(dim))


def close(code: np.ndarray, factor: np.ndarray, coords: np.ndarray, scale: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """Which pairs (row of the codes, row of the coordinates) may reach the threshold."""
    sign = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = (sign @ coords.astype(np.float32).T) * scale[None, :] / (math.sqrt(dim) * factor[:, None])
    if dim == 1:
        return np.ones_like(estimate, bool)
    spread = np.sqrt(np.maximum(0, 1 - factor ** 2)) / factor * math.sqrt(max(0.0, 1 - threshold ** 2) / (dim - 1))
    rounding = scale[None, :] * math.sqrt(dim) / factor[:, None]  # at most half a step per coordinate
    return estimate >= threshold - SIGMAS * spread[:, None] - rounding - 1e-6


def candidates(classes: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """Pairs ``a``, ``b`` of class nodes that need exact recomputation, each once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                node, dims = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    vectors = np.array(batch.column(1).take(pa.array(own)).flatten().to_numpy(), np.float64).reshape(-1, dim)
                    keys, code, coords, scale, factor = describe(vectors, bits, tables)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[own]), pa.array([dim] * len(own), pa.int32()), pa.array(keys.tolist(), pa.list_(pa.int32())),
                         pa.array([x.tobytes() for x in keys], pa.binary()), pa.array([x.tobytes() for x in code], pa.binary()),
                         pa.array([x.tobytes() for x in coords], pa.binary()), pa.array(scale), pa.array(factor)],
                        names=["node", "dim", "keys", "packed", "code", "coords", "scale", "factor"])

    schema = "node bigint, dim int, keys array<int>, packed binary, code binary, coords binary, scale double, factor double"
    coded = written(classes.select("node", "vector").mapInArrow(encode, schema), "codes")
    bucket = ["dim", "table", "key"]
    slim = coded.select("node", "dim", F.posexplode("keys").alias("table", "key"))
    large = slim.groupBy(*bucket).count().where(F.col("count") > BLOCK).select(
        *bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = written(large, "buckets")
    rows = coded.select("node", "dim", "packed", "code", "coords", "scale", "factor", F.posexplode("keys").alias("table", "key"))
    blocked = rows.join(large, bucket, "left").withColumn(
        "own", F.coalesce(F.pmod(F.xxhash64("node", "table"), F.col("blocks")).cast("int"), F.lit(0)))
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    group = [*bucket, "low", "high"]
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).select(
        *group, "own", "node", "packed", "code", "coords", "scale", "factor")
    ordered = dealt.repartition(*group).sortWithinPartitions(*group, "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(part: pa.RecordBatch) -> pa.RecordBatch | None:
            dim, table, _, low, high = (part.column(k)[0].as_py() for k in range(5))
            node, own = part.column(6).to_numpy(zero_copy_only=False), part.column(5).to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(part.column(7).to_pylist()), "<i4").reshape(len(node), -1)
            code = np.frombuffer(b"".join(part.column(8).to_pylist()), np.uint8).reshape(len(node), -1)
            coords = np.frombuffer(b"".join(part.column(9).to_pylist()), np.int8).reshape(len(node), -1)
            scale, factor = (part.column(k).to_numpy(zero_copy_only=False) for k in (10, 11))
            left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
            may = close(code[left], factor[left], coords[right], scale[right], dim, threshold)
            x, y = np.nonzero(np.triu(may, 1) if low == high else may)
            x, y = left[x], right[y]
            first = ~(keys[x, :table] == keys[y, :table]).any(axis=1)  # an earlier table has the pair as well
            x, y = x[first], y[first]
            a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

        held: list[pa.RecordBatch] = []  # the rows of one pair of blocks that ran over a batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            if held and any(held[-1].column(k)[0].as_py() != key[0, k] for k in range(5)):
                found = pairs(_one(held))
                held = []
                if found:
                    yield found
            for a, b in zip(cuts, cuts[1:]):
                held.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    found = pairs(_one(held)) if len(held) > 1 or b - a > 1 else None
                    held = []
                    if found:
                        yield found
        if held:
            found = pairs(_one(held))
            if found:
                yield found

    return ordered.mapInArrow(meet, "a bigint, b bigint")


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``a < b`` of class nodes whose cosine, in double precision, reaches the threshold."""
    bits, tables = table_plan(classes.count(), threshold)
    pairs = written(candidates(classes, bits, tables, threshold), "candidates")
    left = classes.select(F.col("node").alias("a"), F.col("vector").alias("x"))
    right = classes.select(F.col("node").alias("b"), F.col("vector").alias("y"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                dims = batch.column(2).value_lengths().to_numpy()
                for dim in np.unique(dims).tolist():
                    own = pa.array(np.flatnonzero(dims == dim))
                    x, y = (np.array(batch.column(k).take(own).flatten().to_numpy(), np.float64).reshape(-1, dim) for k in (2, 3))
                    cosine = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                    keep = own.filter(pa.array(cosine >= threshold))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(exact, "a bigint, b bigint")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """Links and components of all vectors by cosine.

    One row per input row: ``vec_id``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable), ``kept`` (the id is the component's).
    Equal vectors are one class with a size (recognised by 128 hash bits), so copies,
    however many, never become pairs. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing and are components of their own;
    vectors of different lengths never link. Null ids are never a component's id unless
    it has no other. Other input columns are not read; an empty table gives no rows.
    """
    element = F.col("vector")
    clean = element.isNotNull() & (F.size(element) > 0) & ~F.exists(
        element, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(element, lambda x: x != 0)
    rows = pick(vectors, vec_id=id_col, vector=vector_col).withColumn("vector", element.cast("array<double>"))
    rows = rows.withColumn("clean", F.coalesce(clean, F.lit(False)))
    twice = [F.when(F.col("clean"), F.xxhash64("vector")).alias("h1"), F.when(F.col("clean"), F.xxhash64(F.lit(9), "vector")).alias("h2")]
    rows = written(rows.select("vec_id", *twice, F.when(F.col("clean"), element).alias("vector")), "vectors")
    grouped = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("size"), F.first("vector").alias("vector"))
    classes = written(grouped, "grouped").withColumn("node", F.monotonically_increasing_id())
    classes = written(classes, "classes")
    found = written(links(classes.select("node", "vector"), threshold), "found")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("node").alias("b"), "size")
    degree = both.join(sizes, "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("linked"))
    rooted = classes.select("node", "h1", "h2", "first", "size").join(degree, "node", "left").join(
        components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    labels = written(rooted.join(least, "root").select(
        "h1", "h2", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"), "labels")
    out = rows.drop("vector").join(labels, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS clean FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.clean AND b.clean
          WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.id = vec_id LEFT JOIN degree ON degree.a = vec_id"""
