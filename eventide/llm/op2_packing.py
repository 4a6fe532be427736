"""Packing documents into sequences by bin completion with branch and bound.

Pieces are dealt evenly into groups of about ``GROUP_PIECES``; each group is
packed on its own (at most one badly filled sequence a group, so the loss is a few
sequences in tens of thousands). Inside a group the largest unplaced piece opens a
sequence, and the search enumerates undominated fillings of the room around it:

* a filling is kept only if no unplaced piece still fits;
* it is dominated if one of its pieces, or two together, can be exchanged for a
  larger unplaced piece that still fits;
* a branch is cut when the waste so far exceeds what one sequence fewer than the
  incumbent would allow.

The incumbent starts as best-fit decreasing. A pass of the search enumerates each
level up to a width; a level that was cut short is met again by the next pass, which
is wider. The search ends when the incumbent meets the lower bound ceil(total / size),
when a pass cut no level short (nothing better exists), or after the last of
``PASSES``; every piece is placed in either case.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import pick, read, written
from eventide.llm.tokens import library_encoder, text_groups

VOCABULARY, END_ID, SEQUENCE_TOKENS = "word_bpe_49k.json", 1, 4096
GROUP_PIECES = 20_000
#: Passes of the search: fillings tried per opened sequence, steps spent on enumerating them, whether the
#: first filling without waste is taken alone, and steps per piece.
PASSES = ((6, 60, True, 12), (6, 400, True, 200), (24, 3_200, False, 300))
#: Steps that a pass takes besides those per piece.
FIXED_STEPS = 60_000


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes to the fullest sequence that it fits."""
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # sorted rooms that have sequences
    out: list[list[int]] = []
    for length in sorted(lengths, reverse=True):
        at = bisect_right(rooms, length - 1)
        if at < len(rooms):
            room = rooms[at]
            number = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            out[number].append(length)
        else:
            room, number = size, len(out)
            out.append([length])
        room -= length
        if room:
            if not by_room[room]:
                rooms.insert(bisect_right(rooms, room), room)
            by_room[room].append(number)
    return out


def fillings(room: int, left: Counter, lengths: list[int], waste: int, branches: int = PASSES[0][0],
             fill_steps: int = PASSES[0][1], first_exact: bool = True) -> tuple[list[tuple[int, list[int]]], int]:
    """Undominated fillings of ``room`` from the unplaced ``left``, least waste first.

    ``lengths`` are the distinct unplaced lengths, ascending. Fillings that leave
    more than ``waste`` are cut. Also returns the steps taken; the enumeration was
    cut short if there are ``branches`` fillings, more steps than ``fill_steps`` or,
    with ``first_exact``, a filling without waste.
    """
    found: dict[tuple[int, ...], int] = {}
    chosen: list[int] = []
    used: Counter = Counter()

    def free(limit: int) -> int:
        """The largest unplaced and unchosen length up to ``limit``, or 0."""
        at = bisect_right(lengths, limit) - 1
        while at >= 0 and used[lengths[at]] >= left[lengths[at]]:
            at -= 1
        return lengths[at] if at >= 0 else 0

    def dominated(rest: int) -> bool:
        kinds = sorted(set(chosen))
        if rest and any(free(x + rest) > x for x in kinds):
            return True
        twice = {x for x in kinds if used[x] > 1}
        return any(free(x + y + rest) >= x + y for i, x in enumerate(kinds) for y in kinds[i + (x not in twice):]
                   if x + y <= lengths[-1])

    def end(rest: int) -> bool:
        """Keeps a filling to which nothing can be added; whether it ends the enumeration."""
        if rest <= waste and free(rest) == 0 and not dominated(rest):
            found[tuple(chosen)] = rest
        return first_exact and rest == 0 and bool(found) or len(found) >= branches or steps > fill_steps

    steps, rest, tried = 1, room, [free(room)]  # what is tried after each of the chosen
    if not tried[0]:
        end(rest)
    while tried:
        length = tried[-1]
        if length:
            chosen.append(length)
            used[length] += 1
            rest -= length
            steps += 1
            after = free(min(rest, length))
            if after:
                tried.append(after)
                continue
            if end(rest):
                break
        else:
            tried.pop()
            if not tried:
                break
        last = chosen.pop()
        used[last] -= 1
        rest += last
        tried[-1] = free(last - 1)
    return sorted((rest, list(filling)) for filling, rest in found.items()), steps


def _search(lengths: list[int], size: int, best: list[list[int]], bound: int, branches: int, fill_steps: int,
            first_exact: bool, budget: int) -> tuple[list[list[int]], bool]:
    """One pass: ``best`` or fewer sequences, and whether nothing better exists."""
    total = sum(lengths)
    left = Counter(lengths)
    distinct = sorted(left)
    placed: list[list[int]] = []
    waste = 0
    whole = True
    stack: list[tuple[Iterator[tuple[int, list[int]]], int]] = []  # alternatives of each open sequence and its largest piece

    def take(items: list[int], sign: int) -> None:
        for x in items:
            left[x] -= sign
            if left[x] == 0:
                distinct.pop(bisect_right(distinct, x) - 1)
            elif sign < 0 and left[x] == 1:
                distinct.insert(bisect_right(distinct, x), x)

    def allowed() -> int:
        return (len(best) - 1) * size - total - waste

    def options() -> tuple[Iterator[tuple[int, list[int]]], int]:
        nonlocal budget, whole
        largest, choice, steps = distinct[-1], [], 1
        take([largest], 1)
        room = size - largest
        if allowed() >= 0:
            choice, steps = fillings(room, left, distinct, min(room, allowed()), branches, fill_steps, first_exact)
            whole = whole and steps <= fill_steps and len(choice) < branches and not (first_exact and choice and choice[0][0] == 0)
        take([largest], -1)
        budget -= steps
        return iter(choice), largest

    while len(best) > bound:
        if budget <= 0:
            return best, False
        if not distinct:
            if len(placed) < len(best):
                best = [list(x) for x in placed]
            if len(best) <= bound:
                break
        else:
            stack.append(options())
        moved = False
        while stack and not moved:
            if len(placed) == len(stack):  # undo the last choice of this level
                last = placed.pop()
                waste -= size - sum(last)
                take(last, -1)
            rest, filling = next(stack[-1][0], (None, None))
            if filling is None or rest > allowed():
                stack.pop()
                continue
            chosen = [stack[-1][1], *filling]
            take(chosen, 1)
            placed.append(chosen)
            waste += rest
            moved = True
        if not moved:
            return best, whole
    return best, True


def pack(lengths: list[int], size: int = SEQUENCE_TOKENS, max_steps: int | None = None) -> list[list[int]]:
    """Lengths (1..size) as sequences of at most ``size``."""
    best = best_fit(lengths, size)
    bound = max(-(-sum(lengths) // size), sum(1 for x in lengths if 2 * x > size))
    for branches, fill_steps, first_exact, per_piece in PASSES:
        budget = max_steps if max_steps is not None else per_piece * len(lengths) + FIXED_STEPS
        best, whole = _search(lengths, size, best, bound, branches, fill_steps, first_exact, budget)
        if whole:
            break
    return best


def document_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
                    end_id: int = END_ID, size: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """Ids of every whole text with an end id, cut only where longer than ``size``.

    One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and,
    with ``with_ids``, ``ids``. A null or empty text is one piece of one id.
    """
    path, kind = tokenizer_path or public_tokenizers.path(VOCABULARY), dict(docs.dtypes)[id_col]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:6 if with_ids else 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(path, False), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in text_groups(whole):
                row, number, parts = [], [], []
                for i, coded in enumerate(encoder.ids_of(batch.column(1).to_pylist())):
                    coded += end
                    for k, a in enumerate(range(0, len(coded), 4 * size)):
                        row.append(i)
                        number.append(k)
                        parts.append(coded[a:a + 4 * size])
                found = [batch.column(0).take(pa.array(row)), pa.array(number, pa.int32()),
                         pa.array([size * k for k in number], pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()),
                         pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    found.append(pa.array(parts, pa.binary()))
                yield pa.RecordBatch.from_arrays(found, names=names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
                   end_id: int = END_ID, size: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES,
                   with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset`` (gapless from 0).

    Columns of ``document_pieces`` and these two, one row per piece. Null ids,
    null or empty texts and repeated rows are packed like any other row; other
    input columns are not read; an empty table gives no rows. A piece's group
    comes from its place in the stored table, so equal rows spread evenly.
    """
    pieces = document_pieces(docs, id_col, text_col, tokenizer_path, end_id, size, with_ids)
    # the numbers are stored: a second scan may be split otherwise and would count otherwise
    numbered = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // group_pieces))
    dealt = numbered.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        waiting: dict[int, list[int]] = {}
        for i, length in enumerate(group["length"].tolist()):
            waiting.setdefault(length, []).append(i)
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        base = int(group["group"].iloc[0]) << 32 if len(group) else 0
        for number, items in enumerate(pack(group["length"].tolist(), size)):
            at = 0
            for length in items:
                i = waiting[length].pop()
                sequence[i], offset[i] = base + number, at
                at += length
        return pd.DataFrame({"row": group["row"], "sequence_id": sequence, "offset": offset})

    placed = dealt.groupBy("group").applyInPandas(place, "row bigint, sequence_id bigint, offset bigint")
    return numbered.join(placed, "row").drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
