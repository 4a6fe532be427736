import random

import numpy as np
import pytest
import xxhash

from eventide.llm.components import components
from eventide.llm.op8_simhash import close_pairs, codewords, fingerprint, first_of_groups, keys, near_duplicates


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id by breadth first over all pairs of rows; rows without an id take part."""
    rest, label = set(range(len(prints))), {}
    while rest:
        group, todo = set(), {rest.pop()}
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in rest if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3}
            rest -= near
            todo |= near
        least = min((prints[i][0] for i in group if prints[i][0] is not None), default=None)
        label.update({i: least for i in group})
    return [label[i] for i in range(len(prints))]


def compare(docs, rows):
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str) == want


def test_fingerprints():
    for text in (None, "", " \n", "One", "one two", "A b C", "a b c a b c a b c", "naïve\xa0x ÀÉ y\x85z w", "Q " * 200_000):
        assert fingerprint(text) == plain_fingerprint(text) if text is None or len(text) < 1000 else fingerprint(text) >= 0


def test_spark_hash_is_the_same(spark):
    (row,) = spark.sql("SELECT xxhash64('the quick brown') AS h").collect()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"the quick brown", 42)


def test_code_is_perfect_and_keys_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    _, count = codewords(words)
    assert set(count.tolist()) <= {1, 6}
    prints = rng.integers(0, 2**64, 400, dtype=np.uint64)
    rows, found = keys(prints, True)
    lookups = set(zip(rows.tolist(), found.tolist()))
    for bits in range(4):
        other = prints.copy()
        for i in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        stored = zip(*(x.tolist() for x in keys(other, False)))
        assert len({r for r, k in stored if (r, k) in lookups}) == len(prints)


def test_candidates_of_random_prints_stay_few():
    """Keys are long enough that unrelated fingerprints hardly meet: candidates beyond a print itself, per print."""
    rng = np.random.default_rng(3)
    for n, most in ((20_000, 0.01), (200_000, 0.02)):
        prints = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        stored, probes = np.sort(keys(prints, False)[1]), keys(prints, True)[1]
        met = np.searchsorted(stored, probes, "right") - np.searchsorted(stored, probes, "left")
        assert met.sum() - len(stored) <= most * n


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(25)]
    prints = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)} | {0, 1, 2**63}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = close_pairs(spark.createDataFrame([(p,) for p in signed], "fp BIGINT")).collect()
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 3}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    with pytest.raises(ValueError):
        close_pairs(spark.createDataFrame([], "fp BIGINT"), 4)


def test_components_of_chains_and_stars(spark):
    chain = list(range(100))
    random.Random(3).shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(500, i) for i in range(501, 560)] + [(700, 700), (None, 3), (1000, 900), (900, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    assert got == {**{i: 0 for i in range(100)}, **{i: 500 for i in range(500, 560)}, 900: 900, 1000: 900}
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).collect() == []


def test_edge_rows(edge, empty):
    compare(edge.collect(), near_duplicates(edge).collect())
    assert near_duplicates(empty).collect() == []


def test_given_documents_with_copies(spark, plain):
    docs = plain.collect()
    rng = random.Random(5)
    near = []
    for n, r in enumerate(docs[:40]):  # one word in a long text
        words = r.text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        near.append((10_000 + n, " ".join(words)))
    frame = plain.select("doc_id", "text").unionByName(spark.createDataFrame(near * 3, "doc_id BIGINT, text STRING"))
    compare(frame.collect(), near_duplicates(frame).collect())


def test_first_of_groups(edge, empty):
    kept = first_of_groups(edge)
    assert kept.columns == edge.columns
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in edge.collect()]
    groups = {c for c in plain_components(rows) if c is not None}
    found = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in found if x is not None) == sorted(groups) and found.count(None) <= 1
    assert first_of_groups(empty).collect() == []


def test_rows_keep_their_numbers_when_scans_are_split_otherwise(spark, tmp_path):
    texts = [(i, f"word{i} other{i} third{i} fourth{i} " * 3) for i in range(200)]
    docs = spark.createDataFrame(texts + texts[::2], "doc_id BIGINT, text STRING").repartition(16)
    docs.write.parquet(str(tmp_path / "docs"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    kept = first_of_groups(spark.read.parquet(str(tmp_path / "docs")))
    try:
        spark.conf.set(key, "1k")
        rows = kept.collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(map(tuple, rows)) == texts
