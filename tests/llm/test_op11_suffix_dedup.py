import hashlib
import random

import pytest

from eventide.llm import op11_suffix_dedup as op


def plain(texts, length):
    """(removed, spans, digest) of every text, by a table of all strings of ``length`` bytes."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for t in data:
        for i in range(len(t) - length + 1):
            w = t[i:i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, row STRING, core INT").repartition(4)
    rows = op.remove_repeats(df, with_kept=True, **options).orderBy("doc_id").collect()
    length = options.get("length", op.LENGTH)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == plain(texts, length)
    for r, t in zip(rows, texts):
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return rows


def corpus(seed, n, passage, alphabet="abcdé "):
    """Texts that share passages of lengths around ``passage``, cut anywhere, with single changes."""
    rng = random.Random(seed)
    fresh = lambda k: "".join(rng.choices(alphabet, k=k))
    shared = [fresh(rng.randint(passage - 3, passage + 40)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(fresh(rng.randint(0, passage)))
            s = rng.choice(shared)
            a, b = sorted(rng.choices(range(len(s) + 1), k=2)) if rng.random() < 0.5 else (0, len(s))
            s = s[a:b]
            if s and rng.random() < 0.3:
                k = rng.randrange(len(s))
                s = s[:k] + "#" + s[k + 1:]
            parts.append(s)
        texts.append("".join(parts))
    return texts + texts[:3]


@pytest.mark.parametrize("seed,length,core", [(1, 40, None), (2, 25, 5), (3, 16, 15), (4, 30, 1)])
def test_equals_brute_force(spark, seed, length, core):
    rows = compare(spark, corpus(seed, 60, length), length=length, core=core)
    assert sum(r.n_removed for r in rows) > 0


@pytest.mark.parametrize("name,value", [("HOT_KINDS", 1), ("RUN_BYTES", 2000), ("SHARD_BYTES", 500), ("HASHED_BYTES", 97)])
def test_other_paths_and_sizes_give_the_same(spark, monkeypatch, name, value):
    monkeypatch.setattr(op, name, value)
    op._powers.cache_clear()
    compare(spark, corpus(5, 40, 40), length=40)
    op._powers.cache_clear()


def test_full_length_passages(spark):
    rng = random.Random(7)
    fresh = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    p399, p400, p650, q = fresh(399), fresh(400), fresh(650), fresh(500)
    texts = [fresh(300) + p399 + "x", "y" + p399 + fresh(10), fresh(20) + p400 + fresh(9), "z" + p400, p650 + fresh(700), fresh(3) + p650[:410] + "!" + p650[411:],
             q, q, q + "1", "2" + q[1:], p650[100:], fresh(5) + p650[40:600] + fresh(5), "w" * 2000, "ab" * 600, None, "", "short", fresh(450)]
    rows = compare(spark, texts)
    assert rows[0].n_removed == 0 and rows[2].n_removed == 400 and rows[6].n_removed == 500 and rows[12].n_removed == 2000


def test_many_kinds_of_one_core(spark):
    rng = random.Random(11)
    fresh = lambda k: "".join(rng.choices("abc", k=k))
    core = fresh(30)
    compare(spark, [fresh(rng.randint(0, 30)) + fresh(4) + core + fresh(4) + fresh(rng.randint(0, 30)) for _ in range(150)], length=36)


def test_merge_is_sorted_and_knows_shared_lengths():
    rng = random.Random(3)
    runs, everything = [], []
    for _ in range(7):
        own = sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 40)))
        everything += own
        runs.append(iter([(n, s, ()) for n, s in zip(op.front_coded(own)[0], own)]))
    got = list(op.merged(runs))
    assert [s for _, s, _ in got] == sorted(everything)
    assert [n for n, _, _ in got][1:] == [op.shared(a, b) for a, b in zip(sorted(everything), sorted(everything)[1:])]
    assert list(op.merged([])) == [] and list(op.merged([iter([])])) == []
    for _ in range(300):
        a, b = (bytes(rng.choices(b"ab", weights=[40, 1], k=rng.randint(0, 200))) for _ in range(2))
        assert op.shared(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_edge_rows(spark, edge, empty):
    rows = edge.collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.remove_repeats(edge).collect())
    assert got == sorted((str(r.doc_id), *p) for r, p in zip(rows, plain([r.text for r in rows], 400)))
    assert op.remove_repeats(empty).collect() == []
    with pytest.raises(ValueError):
        op.remove_repeats(edge, length=10, core=10)


def test_given_documents(spark, plain_documents=None):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = sorted(op.remove_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect())
    want = plain([d.text for d in docs], 400)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == {d.doc_id: w for d, w in zip(docs, want)}
