import random
from collections import Counter

import numpy as np
import pytest

from eventide.llm import op13_divergence as op

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, rank STRING, value INT"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            out += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out


def plain(rows, min_docs=3, top=200):
    docs = [(r[2] or "", r[3] or "", words(r[1])) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= min_docs]
        freq = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= min_docs) for s in {d[1] for d in own}}
        every = sum(freq.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in freq.items():
            pairs = [(-sum((p(c, t) - p(o, t)) ** 2 // p(o, t) for t in kept), x) for x, o in freq.items() if x != s]
            terms = [(-((p(c, t) - p(every, t)) ** 2 // p(every, t)), t) for t in kept if c[t] > 0 and p(c, t) > p(every, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def documents(n, seed):
    rng = random.Random(seed)
    pool = [f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["é漢", "Ünï", "x1y", "and"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(pool, weights=[1 / (k + 1) for k in range(len(pool))], k=rng.randint(0, 40)))
        rows.append((i, text + rng.choice([".", "!\n", ""]), rng.choice(["a", "b", None, ""]), "hot" if i % 3 == 0 else f"s{rng.randint(0, 5)}", "x", 1))
    return rows


def test_terms_are_the_pattern():
    for t in ("", "A b-C9d", "naïve\x1fÉ_x\x7fy\xa0z", "漢字 \x00 Q", "a@b[c`d{e"):
        assert [w.decode() for w in op.terms(t)] == words(t)


@pytest.mark.parametrize("block", [20, 4_000_000])
def test_equals_brute_force(spark, monkeypatch, block):
    rows = documents(150, 3) + documents(40, 3)[:20]
    rows += [(900, None, "a", None, "x", 1), (901, "only here", "lonely", "one", "x", 1), (902, "...", "a", "empty group", "x", 1)]
    monkeypatch.setattr(op, "BLOCK_TOKENS", block)
    monkeypatch.setattr(op, "CHUNK_POSTINGS", 7)
    monkeypatch.setattr(op, "MERGED_POSTINGS", 15)
    monkeypatch.setattr(op, "PAIRS", 50)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(op.divergence(df)) == plain(rows)


def chunk(lang, *entries):
    sources = sorted({s for e in entries for s in e[2]})
    return {"lang": lang, "first": entries[0][0], "terms": [e[0] for e in entries], "sources": sources, "docs": np.array([e[1] for e in entries], "<i8").tobytes(),
            "sizes": np.array([len(e[2]) for e in entries], "<i4").tobytes(), "which": np.array([sources.index(s) for e in entries for s in e[2]], "<i4").tobytes(),
            "counts": np.array([n for e in entries for n in e[2].values()], "<i8").tobytes()}


@pytest.mark.parametrize("at_once", [1, 3, 10**6])
def test_runs_merge_in_order(monkeypatch, at_once):
    monkeypatch.setattr(op, "MERGED_POSTINGS", at_once)
    chunks = [chunk("a", (b"a", 1, {"x": 2}), (b"c", 1, {"x": 1})), chunk("a", (b"b", 2, {"y": 3}), (b"c", 1, {"y": 1}), (b"d", 9, {"y": 1})),
              chunk("a", (b"c", 4, {"x": 5, "y": 1})), chunk("a", (b"c", 1, {"z": 1})), chunk("b", (b"a", 2, {"z": 1}))]

    def found(min_docs):
        out = []
        for lang, names, sources, term, source, n in op.merged_runs(iter(chunks), min_docs):
            out += [(lang, names[t], sources[s], k) for t, s, k in zip(term, source, n)]
        assert [o[:2] for o in out] == sorted(o[:2] for o in out)
        return sorted(out)

    assert found(1) == [("a", b"a", "x", 2), ("a", b"b", "y", 3), ("a", b"c", "x", 6), ("a", b"c", "y", 2), ("a", b"c", "z", 1), ("a", b"d", "y", 1), ("b", b"a", "z", 1)]
    assert found(7) == [("a", b"c", "x", 6), ("a", b"c", "y", 2), ("a", b"c", "z", 1), ("a", b"d", "y", 1)]
    assert list(op.merged_runs(iter([]), 1)) == []


def test_partial_sums_of_a_full_table_are_added(spark, monkeypatch):
    monkeypatch.setattr(op, "HELD_SUMS", 1)
    rows = documents(60, 8)
    assert rows_of(op.divergence(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_large_counts_stay_exact(spark):
    rows = [(i, ("a " * 30_000 + "b ") if i % 2 else "b a " * 9, "l", f"s{i % 2}", "", 0) for i in range(12)]
    assert rows_of(op.divergence(spark.createDataFrame(rows, SCHEMA), top_terms=1)) == plain(rows, top=1)


def test_edge_rows(spark, edge, empty):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in edge.collect()]
    assert rows_of(op.divergence(edge)) == plain(rows)
    assert rows_of(op.divergence(edge, min_docs=1)) == plain(rows, min_docs=1)
    assert op.divergence(empty).collect() == []
