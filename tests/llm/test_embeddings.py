import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm.op5_embedding_dedup import close, describe, near_duplicates, rotations, table_plan
from eventide.llm.op7_topk import best, cells, top_k

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, kept STRING, n_links INT, rank INT, row STRING"
NAN, INF = float("nan"), float("inf")
ODD = [None, [], [0.0] * 8, [1.0, None] * 4, [NAN] * 8, [INF] * 8, [1.0, 2.0], [2.0, 4.0], [3.0]]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1, 2, "y") for i, v in vectors], SCHEMA).repartition(4)


def usable(v, zero=False):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(8)
        rows += [(centre + rng.standard_normal(8) * rng.choice([0, 0.03, 0.1, 0.2])).tolist() for _ in range(rng.integers(1, 14))]
    rows = [np.float32(r).tolist() for r in rows] + [np.float32(np.arange(8) + 1).tolist()] * 40 + ODD
    ids = random.Random(1).sample(range(1000), len(rows))
    return [*zip(ids, rows), (None, rows[0]), (ids[1], rows[1])]


def test_near_duplicates_equal_brute_force(spark, clustered):
    good = [k for k, (_, v) in enumerate(clustered) if usable(v)]
    links = defaultdict(set)
    for a in good:
        for b in good:
            x, y = np.array(clustered[a][1], float), np.array(clustered[b][1], float)
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[a].add(b)
    want = []
    for k, (i, _) in enumerate(clustered):
        group, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        ids = [clustered[j][0] for j in group if clustered[j][0] is not None]
        least = min(ids, default=None)
        want.append((i, len(links[k]), least, i is not None and i == least))
    got = [tuple(r) for r in near_duplicates(frame(spark, clustered)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_large_buckets_are_compared_in_blocks(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    rows = [(i, np.float32(centre + 0.02 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    got = near_duplicates(frame(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(1499, 0)} and sum(r.kept for r in got) == 1


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    y = x + rng.standard_normal((400, 64)) * rng.uniform(0.05, 0.5, (400, 1))
    r = rotations(64, 2)
    assert np.allclose(r[:64] @ r[:64].T, np.eye(64))
    bits, tables = table_plan(50_000, 0.95)
    _, code, _, _, factor = describe(x, bits, tables)
    _, _, coords, scale, _ = describe(y, bits, tables)
    sign = np.unpackbits(code, axis=1, count=64) * 2.0 - 1
    true = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
    estimate = np.einsum("ij,ij->i", sign, coords * scale[:, None]) / (8 * factor)
    assert abs((estimate - true).mean()) < 0.01
    may = np.diag(close(code, factor, coords, scale, 64, 0.95))
    assert may[true >= 0.95].all() and not may[true < 0.5].any()


def test_enough_tables_for_the_recall():
    for n in (10, 1000, 10**6, 10**9):
        bits, tables = table_plan(n, 0.95)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= 1e-3


def plain_top(vectors, every, k=5):
    rows = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(vectors) if i is not None and usable(v, True)]
    out = []
    for n, i, q in rows:
        if i % every == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for m, j, v in rows if m != n and len(v) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, clustered):
    got = sorted(tuple(r) for r in top_k(frame(spark, clustered), F.col("id") % 7 == 0).collect())
    assert got == plain_top(clustered, 7)


def test_top_k_of_very_large_components(spark):
    rows = [(i, [float(np.float32(10.0 ** (i % 12))), -3.5, float(i)]) for i in range(40)]
    got = sorted(tuple(r) for r in top_k(frame(spark, rows), F.col("id") % 5 == 0).collect())
    assert got == plain_top(rows, 5) and any(r[3] == 2**63 - 1 for r in got)


def test_bounds_never_lose_a_result():
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.standard_normal((600, 12)) * 40)
    approx, edges = cells(vectors)
    at = np.arange(12)
    assert (edges[approx, at] <= vectors).all() and (vectors <= edges[approx + 1, at]).all()
    ids, queries = rng.permutation(600), vectors[:30]
    found = defaultdict(list)
    for q, c, score in best(queries, np.arange(30), vectors, approx, edges, ids, np.arange(600)):
        found[q].append((-score, int(ids[c])))
    for q in range(30):
        scores = vectors @ queries[q]
        assert found[q] == sorted((-int(scores[c]), int(ids[c])) for c in range(600) if c != q)[:5]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(none).collect() == [] and top_k(none, F.col("id") % 50 == 0).collect() == []
    assert [tuple(r) for r in near_duplicates(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_top_k_of_huge_components(spark):
    """Finite components whose scores pass the doubles: whole numbers, cut to 64 bits."""
    rows = [(0, [1e308, 0.0]), (1, [1.0, 2.0]), (2, [-1e308, 1e308]), (3, [1e308, 1e308]), (4, [1e16, 3.0]), (5, [0.5, -1.0])]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = sorted(map(tuple, top_k(df, F.col("id") >= 0, k=3).collect()))
    whole = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    want = []
    for q in whole:
        scored = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[c])))), c) for c in whole if c != q)
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:3])]
    assert got == sorted(want)
    with pytest.raises(ValueError, match="power of two"):
        top_k(df, F.col("id") >= 0, scale=100)
