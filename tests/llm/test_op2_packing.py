import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventide.llm.op2_packing import END_ID, VOCABULARY, best_fit, fillings, pack, pack_documents


def check(rows, texts, size):
    """Every piece is the library's, and every sequence is gapless and not too long."""
    tok = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    tok.encode_special_tokens = True
    want = Counter()
    for doc_id, text in texts:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [END_ID], "<u4")
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at:at + size]
            want[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_edge_rows(edge):
    texts = [(r.doc_id, r.text) for r in edge.collect()]
    check(pack_documents(edge).collect(), texts, 4096)


def test_groups_and_given_documents(plain):
    texts = [(r.doc_id, r.text) for r in plain.collect()]
    rows = pack_documents(plain, size=512, group_pieces=100).collect()
    assert check(rows, texts, 512) <= -(-sum(r.length for r in rows) // 512) + 20


def test_rows_are_numbered_once(plain):
    plan = pack_documents(plain, size=512)._jdf.queryExecution().toString()
    assert "Scan parquet" in plan and "monotonically_increasing_id" not in plan


def test_empty(empty):
    assert pack_documents(empty).collect() == []


def optimum(lengths, size):
    """Fewest sequences, by trying every subset (small inputs)."""
    best = {0: (0, 0)}
    full = (1 << len(lengths)) - 1
    for mask in range(1, full + 1):
        best[mask] = min((lambda b, room: (b, room + x) if room + x <= size else (b + 1, x))(*best[mask & ~(1 << i)])
                         for i, x in enumerate(lengths) if mask >> i & 1)
    return best[full][0] + 1


@pytest.mark.parametrize("seed", range(8))
def test_small_inputs_are_packed_optimally(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(15, 60) for _ in range(11)]
    found = pack(lengths, 100)
    assert Counter(x for s in found for x in s) == Counter(lengths) and max(map(sum, found)) <= 100
    assert len(found) == optimum(lengths, 100) <= len(best_fit(lengths, 100))


def test_search_beats_best_fit():
    rng = random.Random(1)
    lengths = [rng.randint(1200, 2100) for _ in range(300)]
    assert len(pack(lengths)) <= len(best_fit(lengths, 4096))


@pytest.mark.parametrize("n, most", [(300, 82), (3_000, 818)])
def test_levels_cut_short_are_met_again(n, most):
    rng = random.Random(1)
    lengths = [rng.randint(700, 1500) for _ in range(n)]
    found = pack(lengths)
    assert Counter(x for s in found for x in s) == Counter(lengths) and max(map(sum, found)) <= 4096
    assert len(found) <= most < len(best_fit(lengths, 4096))


def test_many_short_pieces_beside_long_ones():
    rng = random.Random(2)
    lengths = [rng.randint(1200, 2100) for _ in range(100)] + [1] * 3_000
    found = pack(lengths, max_steps=20_000)
    assert Counter(x for s in found for x in s) == Counter(lengths) and max(map(sum, found)) <= 4096


def test_fillings_are_maximal_and_undominated():
    left = Counter([50, 45, 40, 30, 30, 20, 10, 5])
    found, _ = fillings(60, left, sorted(left), 60)
    assert found[0][0] == 0
    for rest, filling in found:
        spare = left - Counter(filling)
        assert rest == 60 - sum(filling) and all(x > rest for x in spare)
        assert not any(x < y <= x + rest for x in filling for y in spare)
        assert not any(a + b <= y <= a + b + rest for a, b in combinations(filling, 2) for y in spare)
