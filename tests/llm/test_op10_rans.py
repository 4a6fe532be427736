import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventide.llm.op10_rans import (
    BLOCK_TOKENS, CHECKPOINT_STEPS, END_ID, LANES, VOCABULARY, Frequencies, decode_blocks, encode_blocks, read_documents,
    write_documents,
)
from eventide.session import scratch_dir


def test_blocks_round_trip_near_the_entropy():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 400_000), 50_000).astype(np.uint32)
    tokens, counts = np.unique(ids, return_counts=True)
    freqs = Frequencies.scaled(counts)
    assert freqs.sum() == 1 << 20 and freqs.min() >= 1
    table = Frequencies(tokens.astype(np.int64), freqs)
    cuts = [0, 1, LANES, LANES + 1, 100, 100 + CHECKPOINT_STEPS * LANES, 100_000, 400_000]
    blocks = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
    coded = encode_blocks(blocks, table, int(tokens[0]))
    back = decode_blocks([(len(b), *c) for b, c in zip(blocks, coded)], table)
    assert all((a == b).all() for a, b in zip(blocks, back))
    p = counts / counts.sum()
    assert len(coded[-1][0]) * 8 / len(blocks[-1]) < -(p * np.log2(p)).sum() * 1.01 + 0.1


def test_one_id_alone():
    table = Frequencies(np.array([2]), Frequencies.scaled(np.array([5])))
    blocks = [np.full(n, 2, np.uint32) for n in (1, 70_000)]
    coded = encode_blocks(blocks, table, 2)
    assert [b.tolist() for b in decode_blocks([(len(b), *c) for b, c in zip(blocks, coded)], table)] == [b.tolist() for b in blocks]


def check(docs, rows):
    tok = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    tok.encode_special_tokens = True
    want = []
    for r in docs:
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [END_ID], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    key = lambda x: (x[0] is not None, x)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=lambda x: (x[0] is not None, str(x))) == sorted(
        want, key=lambda x: (x[0] is not None, str(x)))
    at = 0
    for r in sorted(rows, key=lambda r: r.start):  # gapless, ascending by id, null ids first
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: key((i or 0,))[1] if i is not None else (-1,))


def test_edge_rows(spark, edge):
    path = scratch_dir(spark, "rans-test")
    write_documents(edge, path)
    check(edge.collect(), read_documents(spark, path).collect())


def test_given_documents_and_several_blocks(spark, plain):
    path = scratch_dir(spark, "rans-test")
    write_documents(plain, path)
    rows = read_documents(spark, path, with_ids=True).collect()
    check(plain.collect(), rows)
    assert sum(r.n_tokens for r in rows) > 2 * BLOCK_TOKENS
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)


def test_damage_is_found(spark, plain):
    path, bad = scratch_dir(spark, "rans-test"), scratch_dir(spark, "rans-bad")
    write_documents(plain.limit(20), path)
    spark.read.parquet(f"{path}/table").write.parquet(f"{bad}/table")
    spark.read.parquet(f"{path}/blocks").selectExpr("* except (crc32)", "crc32 + 1 AS crc32").write.parquet(f"{bad}/blocks")
    with pytest.raises(Exception, match="checksum"):
        read_documents(spark, bad).collect()


def test_empty(spark, empty):
    path = scratch_dir(spark, "rans-test")
    write_documents(empty, path)
    assert read_documents(spark, path).collect() == []


def test_random_lengths():
    rng = random.Random(4)
    table = Frequencies(np.arange(300), Frequencies.scaled(np.arange(1, 301)))
    blocks = [np.array([rng.randrange(300) for _ in range(rng.choice([1, 31, 32, 33, 500, 20_000]))], np.uint32) for _ in range(12)]
    coded = encode_blocks(blocks, table, 0)
    assert all((a == b).all() for a, b in zip(blocks, decode_blocks([(len(b), *c) for b, c in zip(blocks, coded)], table)))
