import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from eventide.llm import op12_collocations as op

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, phrase STRING, rank INT"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def plain(rows, min_count, longest=4, top=2000):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in cands.items():
            score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cands.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def documents(n, seed):
    rng = random.Random(seed)
    pool = ["New", "york", "city", "of", "the", "a\x1cb", "漢字", "x'y", "\x00", "São", "-", "—"]
    rows = []
    for i in range(n):
        words = rng.choices(pool, weights=[9, 8, 7, 6, 6, 3, 3, 2, 2, 2, 1, 1], k=rng.randint(0, 30))
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for w in words)
        rows.append((i, text + "new york city hall " * rng.randint(0, 2), rng.choice(["a", "b", None, "und", ""]), "clash", 1))
    return rows


@pytest.mark.parametrize("min_count,block", [(3, 200), (8, 8 << 20)])
def test_equals_brute_force(spark, monkeypatch, min_count, block):
    rows = documents(160, 2) + [(1, None, None, "", 0), (2, "", "a", "", 0), (3, "the " * 3000, "a", "", 0)]
    monkeypatch.setattr(op, "BLOCK_BYTES", block)
    monkeypatch.setattr(op, "SHARD_PHRASES", block * 10)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(op.collocations(df, min_count=min_count)) == plain(rows, min_count)


def test_a_short_list_keeps_the_order_of_ties(spark):
    rows = [(i, "z y. b a. y z. a b", "l", "", 0) for i in range(40)]
    got = rows_of(op.collocations(spark.createDataFrame(rows, SCHEMA), top=3))
    assert got == plain(rows, 30, top=3) and [r[2] for r in got] == ["a b", "b a", "y z"]


def test_longer_phrases_and_all_ranks(spark):
    rows = documents(80, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(op.collocations(df, min_count=4, longest=6, top=None)) == plain(rows, 4, longest=6, top=10**9)


@pytest.mark.parametrize("n,id_bits", [(2, 1), (2, 17), (3, 20), (4, 16), (4, 20), (4, 32), (3, 32)])
def test_phrases_survive_permutation_and_filter(n, id_bits):
    rng = np.random.default_rng(n * 100 + id_bits)
    ids = [rng.integers(0, 1 << id_bits, 5000) for _ in range(n)]
    for i in ids:
        i[:50], i[50:60] = i[0], (1 << id_bits) - 1
    x_bits, y_bits = op._halves(n, id_bits)
    x, y = op.permute(*op.pack(ids, id_bits), x_bits, y_bits)
    assert int(x.max()) < 1 << x_bits and int(y.max()) < 1 << y_bits
    back = op.unpack(*op.unpermute(x, y, x_bits, y_bits), n, id_bits)
    assert all((a == b).all() for a, b in zip(ids, back))
    x, y, counts = op.counted(x, y, rng.integers(1, 2000, len(x)), y_bits, x_bits + y_bits <= 64)
    want = Counter(zip(x.tolist(), y.tolist()))
    assert set(want.values()) == {1} and counts.max() >= 255
    shards = min(2, x_bits - 1)
    low = x_bits - shards
    for shard in range(1 << shards):
        at = (x >> np.uint64(low)) == shard
        q = min(low, max(1, int(at.sum()).bit_length()))
        row = op.QuotientFilter.dump(x[at], y[at], counts[at], low, q, y_bits)
        got = op.QuotientFilter.load(row, int(at.sum()), shard, low, q, y_bits)
        assert all((a == b).all() for a, b in zip(got, (x[at], y[at], counts[at])))


def test_numbers_survive_their_planes():
    ids = np.array([0, 1, 255, 256, 70_000, 2**31 - 1, 5], np.int32)
    assert (op.from_planes(pa.py_buffer(op.planes(ids))) == ids).all() and len(op.from_planes(pa.py_buffer(op.planes(ids[:0])))) == 0


def test_tokens_are_the_pattern():
    for t in ("", None, "A b\tc.D,,e\n\nf  g\rh\x0bi\x0cj", "\x1ca\x00 É\xa0x", ". . .", "a:b;c!d?e"):
        got, now = [], []
        for w in op.tokens(t) + [b"."]:
            if w == b".":
                got.append(now)
                now = []
            elif w:
                now.append(w.decode())
        assert got == pieces(t)


def test_edge_rows(edge, empty):
    rows = [(r.doc_id, r.text, r.lang) for r in edge.collect()]
    assert rows_of(op.collocations(edge, min_count=2)) == plain(rows, 2)
    assert rows_of(op.collocations(edge)) == plain(rows, 30)
    assert op.collocations(empty).collect() == []
