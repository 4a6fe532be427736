import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from eventide.llm.op3_bpe import RANKS, coder, encode_documents, load_ranks

PATH = public_tokenizers.path(RANKS)
PAIRS, ENCODER = coder(PATH)
THEIRS = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def ids(text):
    return np.array(THEIRS.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abeéß漢😀 \n\t\r \x1c'.,!09stre"), max_size=80))
def test_any_text_as_the_library(text):
    assert ENCODER.ids(text) == ids(text)
    assert PAIRS.decode(ids(text)) == text.encode()


def test_tree_for_one_and_for_many_agree():
    rng = random.Random(2)
    matches = [bytes(rng.choice(b"aehinorst ") for _ in range(rng.randint(2, 60))) for _ in range(400)]
    batch = PAIRS.merge_batch(matches, 64)
    assert batch == [np.array(PAIRS.merge_one(m), "<u4").tobytes() for m in matches]


def test_ties_merge_the_leftmost_pair():
    for n in (2, 3, 5, 63, 64, 65, 1000):
        assert ENCODER.ids("a" * n) == ids("a" * n)


def test_edge_rows(edge):
    rows = encode_documents(edge, with_ids=True).collect()
    texts = sorted((str(r.doc_id), r.text or "") for r in edge.collect())
    found = sorted((str(r.doc_id), r.decoded.decode()) for r in rows)
    assert found == texts
    for r in rows:
        want = ids(r.decoded.decode())
        assert bytes(r.ids) == want and r.n_tokens == len(want) // 4
        assert r.ids_sha256 == hashlib.sha256(want).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest()


def test_empty(empty):
    assert encode_documents(empty).collect() == []
