import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventide.llm.tokens import library_encoder, text_groups

FILES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
WHOLE = {}


def whole(name, text):
    if name not in WHOLE:
        WHOLE[name] = Tokenizer.from_file(public_tokenizers.path(name))
        WHOLE[name].encode_special_tokens = True
    return np.array(WHOLE[name].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name,spaced", FILES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abeÉßΣ́漢 \n\t \x1c\x85'.,!09st<|>"), max_size=60), min_size=1, max_size=4))
def test_pieces_as_the_whole_text(name, spaced, texts):
    encoder = library_encoder(public_tokenizers.path(name), spaced)
    assert encoder.ids_of(texts) == [whole(name, t) for t in texts]


@pytest.mark.parametrize("name,spaced", FILES)
def test_bounded_memory(name, spaced):
    encoder = library_encoder(public_tokenizers.path(name), spaced)
    old, encoder.max_entries = encoder.max_entries, 50
    try:
        for n in range(20):
            text = " ".join(f"piece{n}x{k}" for k in range(30)) + "\nend of " + "long" * 30
            assert encoder.ids(text) == whole(name, text)
            assert len(encoder.known) <= 50 + 40
    finally:
        encoder.max_entries = old


def test_plain_words_are_asked_of_the_model(monkeypatch):
    """The whole tokenizer meets only what is no word of letters (op2: its normalizer was most of the time)."""
    encoder, asked = library_encoder(public_tokenizers.path(FILES[0][0]), False), []
    monkeypatch.setattr(encoder, "known", {})
    monkeypatch.setattr(encoder, "heads", {})
    monkeypatch.setattr(encoder, "encode_many", lambda texts, many=encoder.encode_many: (asked.extend(texts), many(texts))[1])
    text = "Plain Words, \u00c9t\u00e9's stra\u00dfe (round) don't 4x words."
    assert encoder.ids(text) == whole(FILES[0][0], text)
    assert not {"Plain", "Words,", "words."} & set(asked) and "(round)" in asked


def test_groups_of_texts():
    """Slices hold every row once, in order; a long text is alone, nulls count nothing."""
    texts = ["a" * 10, None, "b" * (9 << 20), "", "c"] + ["d" * (1 << 20)] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"]).slice(1)
    groups = list(text_groups(batch))
    assert [i for g in groups for i in g.column(0).to_pylist()] == list(range(1, len(texts)))
    assert all(g.num_rows == 1 or sum(len(t or "") for t in g.column(1).to_pylist()) <= 8 << 20 for g in groups) and len(groups) < 8
    assert not list(text_groups(batch.slice(0, 0)))


def test_lines_of_plain_words_are_asked_of_the_model(monkeypatch):
    """op10: words at the beginning of a text or a line too; the whole tokenizer meets none of them."""
    encoder, asked = library_encoder(public_tokenizers.path(FILES[1][0]), True), []
    for name in ("known", "words", "heads"):
        monkeypatch.setattr(encoder, name, {}, raising=False)
    monkeypatch.setattr(encoder, "encode_many", lambda texts, many=encoder.encode_many: (asked.extend(texts), many(texts))[1])
    texts = ["First words of\nlines, and\nÉté others.", "of\nlines", "First"]
    assert encoder.ids_of(texts) == [whole(FILES[1][0], t) for t in texts]
    assert not asked


@pytest.mark.parametrize("name,spaced", FILES)
def test_words_and_what_stands_behind_them(name, spaced):
    """Short, long and foreign words, joined by spaces, lines and both, as in the whole text."""
    encoder = library_encoder(public_tokenizers.path(name), spaced)
    words = ["word", "Word,", "don't", "a1", "1a", "e-mail", "x_y", "Été's", "straße.", "İstanbul", "ók", "naïve!?", "(round)",
             "w" * 48, "w" * 49, "w" * 46 + ",,", "w" * 46 + ",,,", "é" * 24, "é" * 25, "don’t", "a\x1cb", "a\x85b", "\x7f", "<s>", "漢字"]
    for gap in (" ", "\n", "  ", " \n", "\n ", "\n\n", "\t"):
        texts = [gap.join(words), gap + gap.join(words[::-1]) + gap, *words, *[w + gap for w in words], *[gap + w for w in words]]
        assert encoder.ids_of(texts) == [whole(name, t) for t in texts]
