"""Whole-text tokenisation that calls the tokenizer once per distinct word.

Both pre-tokenizers in use never let a token cross from the characters before a
space to the ones after it, except inside a run of white space. So a text is cut
before its spaces, each distinct piece is encoded by the library once and the ids
of a text are the concatenation of its pieces' ids. Arrow cuts many texts at once, takes the plain
pieces apart into words and what stands behind them, and puts the ids together, so Python meets each distinct
word, ending and odd piece of a group of texts once. The memory of a worker is
bounded by ``MAX_ENTRIES`` of these of at most ``MAX_PIECE`` characters.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_ENTRIES = 800_000
MAX_PIECE = 48
#: Texts that are encoded together: at most so many, and about so many bytes.
GROUP_ROWS, GROUP_BYTES = 1024, 8 << 20
#: Cut before a space unless both its neighbours are white space (or the end).
_SPACES = {c for c in map(chr, range(0x3001)) if c.isspace()} | {""}
_CUT = re.compile(r"(?<=\S)(?= )|(?<=\s)(?= \S)")


#: A word, with the space before it where there is one, and what stands behind it: printable ASCII characters, the first
#: no letter, so that it begins a token of its own. The letters are those that every Unicode version knows.
_BEHIND = r"(?P<tail>(?:[!-@\[-`{-~][!-~]*)?)$"
_WORD = "^(?P<word> ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)" + _BEHIND
#: The same where words are composed and lower-cased first: letters whose small form is one letter.
_PLAIN_WORD = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)" + _BEHIND
_NOTHING = pa.scalar(b"", pa.large_binary())


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``encode_many`` maps a list of strings to such byte strings. ``spaced`` tells
    that a piece's ids depend on the space before it (byte-level vocabularies);
    otherwise white space is dropped by the tokenizer.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], spaced: bool,
                 encode_heads: Callable[[list[str]], list[bytes]] | None = None, max_entries: int = MAX_ENTRIES,
                 encode_words: Callable[[list[str]], list[bytes]] | None = None):
        self.encode_many, self.spaced, self.max_entries = encode_many, spaced, max_entries
        self.encode_words = encode_words  # words of letters (``spaced``: some with a space before them): pieces of the tokenizer's own cutting
        self.encode_heads = encode_heads or encode_many  # for pieces without the space
        self.known: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.feed = self.encode_many(["\n"])[0] if spaced else b""

    def _learn(self, pieces: set[str], extra: dict[str, bytes]) -> None:
        if not pieces:
            return
        column = pa.array(list(pieces), pa.large_string())
        coded = self._plain(column, self.spaced)
        plain = coded.is_valid()
        self._keep(self.known, column.filter(plain).to_pylist(), coded.filter(plain).to_pylist(), extra)
        pieces = set(column.filter(coded.is_null()).to_pylist())
        lines: dict[str, list[str]] = {}
        if self.spaced:  # a line feed between visible characters is a token of its own: both sides recur elsewhere
            for piece in pieces:
                if "\n" in piece and all(part.split() == [part] for part in piece.split("\n")):
                    lines[piece] = piece.split("\n")
            pieces = pieces.difference(lines).union({parts[0] for parts in lines.values()}.difference(self.known))
        lead = " " if self.spaced else ""
        self._keep(self.known, list(pieces), self.encode_many([lead + p for p in pieces]), extra)
        if lines:
            heads = list({part for parts in lines.values() for part in parts[1:]}.difference(self.heads))
            long_heads: dict[str, bytes] = {}
            if heads:
                self._keep(self.heads, heads, self.encode_heads(heads), long_heads)
            for piece, (first, *others) in lines.items():
                ids = self.feed.join([extra[first] if first in extra else self.known[first],
                                 *[long_heads[o] if o in long_heads else self.heads[o] for o in others]])
                (extra if len(piece) > MAX_PIECE else self.known)[piece] = ids

    def _plain(self, pieces: pa.Array, lead: bool) -> pa.Array:
        """The ids of the short pieces that are a word, or a word and what stands behind it, or (``spaced``) lines of
        such; null for the others. ``lead``: a space stands before each piece."""
        if not self.encode_words:
            return pa.nulls(len(pieces), pa.large_binary())
        short = pc.less_equal(pc.binary_length(pieces), MAX_PIECE)
        pieces = pc.if_else(short, pieces, pa.scalar(None, pa.large_string()))
        if lead:
            pieces = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pieces, pa.scalar("", pa.large_string()))
        lines = pc.split_pattern(pc.fill_null(pieces, ""), "\n") if self.spaced else None
        words, tails = pc.extract_regex(pieces if lines is None else lines.values, _WORD if self.spaced else _PLAIN_WORD).flatten()
        words = words if self.spaced else pc.utf8_lower(words)
        coded = pc.binary_join_element_wise(self._coded(words, self.words, self.encode_words), self._coded(tails, self.heads, self.encode_heads), _NOTHING)
        if lines is None:  # a line feed between visible characters is a token of its own
            return coded
        return pc.binary_join(pa.ListArray.from_arrays(lines.offsets, coded), pa.scalar(self.feed, pa.large_binary()))

    @staticmethod
    def _coded(column: pa.Array, known: dict[str, bytes], encode: Callable[[list[str]], list[bytes]]) -> pa.Array:
        """The ids of each string of a column; only those not yet known are encoded."""
        found = column.dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        known[""] = b""
        coded = list(map(known.get, distinct))
        new = [s for s, ids in zip(distinct, coded) if ids is None]
        if new:
            known.update(zip(new, encode(new)))
            coded = list(map(known.get, distinct))
        return pa.array(coded, pa.large_binary()).take(found.indices)

    def _keep(self, known: dict[str, bytes], pieces: list[str], ids: list[bytes], extra: dict[str, bytes]) -> None:
        for piece, own in zip(pieces, ids):
            if len(piece) > MAX_PIECE:
                extra[piece] = own
            else:
                known[piece] = own

    def ids(self, text: str | None) -> bytes:
        """The ids of one whole text; none for null or empty texts."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text. The texts' new pieces are learnt in one call."""
        if len(self.known) + len(self.words) + len(self.heads) > self.max_entries:  # short pieces recur most: they stay while they are few
            for kept in (self.known, self.words):
                short = {p: ids for p, ids in kept.items() if len(p) <= 8}
                kept.clear()
                kept.update(short if len(short) < self.max_entries // 4 else {})
            self.heads = {}
        column = pa.array([t or "" for t in texts], pa.large_string())
        split = pc.split_pattern(column, " ") if self.spaced else pc.ascii_split_whitespace(column)
        pieces, ends, heads, begins = split.values, np.asarray(split.offsets).astype(np.int64), [""] * len(texts), [None] * len(texts)
        if self.spaced:  # the first piece has no space before it
            first = pieces.take(pa.array(ends[:-1]))
            heads, begins = first.to_pylist(), self._plain(first, False).to_pylist()
            inner = np.ones(len(pieces), bool)
            inner[ends[:-1]] = False
            pieces, ends = pieces.filter(pa.array(inner)), ends - np.arange(len(ends))
        found = pieces.dictionary_encode()
        kinds, coded = np.asarray(found.indices), self._plain(found.dictionary, self.spaced)
        others = np.flatnonzero(coded.is_null())
        distinct = found.dictionary.take(pa.array(others)).to_pylist()
        new = set(distinct).difference(self.known)
        apart = {}
        odd = [(k, p) for k, p in zip(others.tolist(), distinct) if p[:1] in _SPACES] if self.spaced else []
        if odd:  # white space next to a space: cut only where it is safe
            places = np.flatnonzero(np.isin(kinds, [k for k, _ in odd]))
            for i in np.unique(np.searchsorted(ends, places, "right") - 1).tolist():
                head, *rest = _CUT.split(texts[i])
                heads[i], begins[i], rest = ("", None, [head, *rest]) if head[:1] == " " else (head, None, rest)
                apart[i] = [p[1:] for p in rest]
            new.difference_update([p for _, p in odd])
            new.update(set().union(*apart.values()).difference(self.known))
        extra: dict[str, bytes] = {}
        self._learn(new, extra)
        rest = [extra[p] if p in extra else self.known.get(p) for p in distinct]
        place = np.arange(len(coded))
        place[others] = len(coded) + np.arange(len(others))
        joined = pa.concat_arrays([coded, pa.array(rest, pa.large_binary())]).take(pa.array(place[kinds]))
        if len(joined):
            data, at = memoryview(joined.buffers()[2] or b""), np.frombuffer(joined.buffers()[1], np.int64)[ends].tolist()
        else:
            data, at = memoryview(b""), [0] * len(ends)
        out = []
        for i, (head, begin) in enumerate(zip(heads, begins)):
            if begin is None:
                begin = (self.heads[head] if head in self.heads else self.encode_many([head])[0]) if head else b""
            out.append(begin + (b"".join([self._one(p, extra) for p in apart[i]]) if i in apart else data[at[i]:at[i + 1]]))
        return out

    def _one(self, piece: str, extra: dict[str, bytes]) -> bytes:
        return extra[piece] if piece in extra else self.known[piece]


def text_groups(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``GROUP_ROWS`` rows whose texts have about ``GROUP_BYTES``, at least one row each."""
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, upto[at] + GROUP_BYTES, "right")) - 1
        end = min(max(end, at + 1), at + GROUP_ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


_LOADED: dict[tuple[str, bool], PieceEncoder] = {}


def library_encoder(path: str, spaced: bool) -> PieceEncoder:
    """A ``tokenizers`` file, loaded once per worker and kept between its tasks."""
    if (path, spaced) not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        _LOADED[path, spaced] = (
            PieceEncoder(_by_tabs(tok), True, _by_feeds(tok), encode_words=_by_model(tok)) if spaced
            else PieceEncoder(_by_offsets(tok), False, encode_words=_by_plain_model(tok)))
    return _LOADED[path, spaced]


def _one_by_one(tok, texts: list[str]) -> list[bytes]:
    return [np.asarray(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]


def _by_offsets(tok) -> Callable[[list[str]], list[bytes]]:
    """White space is dropped: one call over the pieces joined by spaces, cut again by character offsets."""

    def encode_many(texts: list[str]) -> list[bytes]:
        found = tok.encode(" ".join(texts), add_special_tokens=False)
        if not found.ids:
            return [b""] * len(texts)
        ids = np.asarray(found.ids, "<u4").tobytes()
        ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = (4 * np.searchsorted([a for a, _ in found.offsets], ends, "left")).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    return encode_many


def _cut_at(tok, joined: str, cut: int) -> list[bytes]:
    fast = getattr(tok, "encode_batch_fast", tok.encode_batch)
    ids = np.asarray(fast([joined], add_special_tokens=False)[0].ids, "<u4")
    cuts = np.append(4 * np.flatnonzero(ids == cut), 4 * len(ids)).tolist()
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], cuts)]


def _by_model(tok) -> Callable[[list[str]], list[bytes]] | None:
    """Byte level with the usual cutting: a space and letters are one piece, so the merges can be asked for directly."""
    own = json.loads(tok.to_str())
    cut = own["pre_tokenizer"] or {}
    if own["normalizer"] is not None or own["model"]["type"] != "BPE" or (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) != ("ByteLevel", True, False):
        return None
    letters = _letters()
    feed, tokenize = chr(letters[0x0A]), tok.model.tokenize

    def encode_words(words: list[str]) -> list[bytes]:
        """Of words of letters, some with a space before them."""
        shown = "\n".join(words).encode().decode("latin-1").translate(letters).split(feed)
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in shown] if words else []

    return encode_words


def _letters() -> dict[int, int]:
    """What byte-level vocabularies show each byte as."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from 256 on
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(shown)))}


#: Texts are composed, white space is one space, letters are small; runs of letters are pieces of their own.
_PLAIN = ({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
          {"type": "Sequence", "pretokenizers": [
              {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
              {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})


def _by_plain_model(tok) -> Callable[[list[str]], list[bytes]] | None:
    """The same for a vocabulary that drops white space: a run of small letters is one piece."""
    own = json.loads(tok.to_str())
    if own["model"]["type"] != "BPE" or (own["normalizer"], own["pre_tokenizer"]) != _PLAIN:
        return None
    letters, tokenize = _letters(), tok.model.tokenize

    def encode_words(words: list[str]) -> list[bytes]:
        """Of words of small letters."""
        shown = " ".join(words).encode().decode("latin-1").translate(letters).split(chr(letters[0x20]))
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in shown] if words else []

    return encode_words


def _by_tabs(tok) -> Callable[[list[str]], list[bytes]]:
    """Byte level: a tab before a space and a visible character is a token of its own, so tabs mark the cuts."""
    (tab,) = tok.encode("\t", add_special_tokens=False).ids

    def encode_many(texts: list[str]) -> list[bytes]:
        joined = "\t".join(texts)
        if joined.count("\t") != len(texts) - 1 or not all(t[0] == " " and not t[1:2].isspace() and len(t) > 1 for t in texts):
            return _one_by_one(tok, texts)
        return _cut_at(tok, joined, tab)

    return encode_many


def _by_feeds(tok) -> Callable[[list[str]], list[bytes]]:
    """The same with line feeds for pieces without any white space."""
    (feed,) = tok.encode("\n", add_special_tokens=False).ids
    return lambda texts: _cut_at(tok, "\n".join(texts), feed)
