"""Aggregates and window functions written in Python (G3, G6), over Arrow data.

A :class:`CodeAccumulator` has the form of the built-in aggregates (``functions/aggregates.py``): tasks make
partial states of their rows, partial states of a group are merged after one shuffle, and the
state of a stream is the same state. Late refires fold a group's late rows in order on top of its
state, cut into ranges of equal rows like any prefix scan, so a hot window is not one task.

An :class:`ArrowFunction` turns batches of firings into any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventide.packaging import ship_package
from eventide.plans import prefix

#: Groups whose partial states a task holds before it passes them on.
HELD_GROUPS = 20_000


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, pa.RecordBatch, int]]:
    """(values of the first ``n`` columns, batch, row number) of every row."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(n)]
        for at in range(batch.num_rows):
            yield tuple(c[at] for c in columns), batch, at


class _Out:
    """Rows collected into batches of a schema."""

    def __init__(self, schema: T.StructType, size: int = 4096):
        self.schema, self.size, self.rows = to_arrow_schema(schema), size, []

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
            self.rows = []


@dataclass(frozen=True)
class CodeAccumulator:
    """A user-defined aggregate in Python.

    columns: the input, name -> column. state, result: DDL of the state and of the result.
    zero() -> state; add(state, batch) -> state, ``batch`` an Arrow batch of the input columns with some
    of the group's rows, in no order; merge(state, state) -> state; finish(state) -> result. States and results are
    tuples in the order of their DDL; a state that was passed in must not be used afterwards.
    """

    columns: tuple[tuple[str, Column | str], ...]
    state: str
    result: str
    zero: Callable[[], tuple]
    add: Callable[[tuple, pa.RecordBatch], tuple]
    merge_states: Callable[[tuple, tuple], tuple]
    finish_state: Callable[[tuple], tuple]

    @property
    def field_names(self) -> list[str]:
        return ["_state"]

    @property
    def result_names(self) -> list[str]:
        return _schema(self.result).names

    def inputs(self) -> list[Column]:
        return [(F.col(c) if isinstance(c, str) else c).alias(f"_in_{n}") for n, c in self.columns]

    def _input(self) -> Column:
        return F.struct(*[F.col(f"_in_{n}").alias(n) for n, _ in self.columns])

    def _state_type(self) -> T.StructType:
        return _schema(self.state)

    def _with_state(self, df: DataFrame, by: Sequence[str]) -> T.StructType:
        return T.StructType([*[df.schema[c] for c in by], T.StructField("_state", self._state_type())])

    def _as_dict(self) -> Callable[[tuple], dict]:
        names = self._state_type().names
        return lambda state: dict(zip(names, state))

    def increments(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        """Partial states per task and group, merged."""
        ship_package(rows.sparkSession)
        schema, n, zero, add, as_dict = self._with_state(rows, by), len(by), self.zero, self.add, self._as_dict()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, tuple] = {}
            out = _Out(schema)
            for batch in batches:
                places: dict[tuple, list[int]] = {}
                for key, _, at in _rows(iter([batch]), n):
                    places.setdefault(key, []).append(at)
                values = pa.RecordBatch.from_struct_array(batch.column(n))
                for key, own in places.items():
                    held[key] = add(held[key] if key in held else zero(), values.take(pa.array(own)))
                if len(held) >= HELD_GROUPS:
                    for key, state in held.items():
                        yield from out.add((*key, as_dict(state)))
                    held = {}
            for key, state in held.items():
                yield from out.add((*key, as_dict(state)))
            yield from out.flush()

        return self.merge(rows.select(*by, self._input().alias("_in")).mapInArrow(run, schema), by)

    def merge(self, states: DataFrame, by: Sequence[str]) -> DataFrame:
        """One row per group: its states come next to each other and are merged one by one."""
        ship_package(states.sparkSession)
        schema, n, merge, as_dict = self._with_state(states, by), len(by), self.merge_states, self._as_dict()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = _Out(schema)
            now, held = None, None
            for key, batch, at in _rows(batches, n):
                state = tuple(batch.column(n)[at].as_py().values())
                if held is not None and key == now:
                    held = merge(held, state)
                    continue
                if held is not None:
                    yield from out.add((*now, as_dict(held)))
                now, held = key, state
            if held is not None:
                yield from out.add((*now, as_dict(held)))
            yield from out.flush()

        return states.select(*by, "_state").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)

    def summary(self, states: DataFrame, by: Sequence[str]) -> DataFrame:
        return states

    def alone(self, late: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        return self.increments(late, [*by, *order])

    def refires(self, late: DataFrame, states: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        by, order = list(by), list(order)
        kinds = {f.name: f.dataType for f in late.select(*order).schema.fields}
        empty_in = F.lit(None).cast(late.select(self._input().alias("i")).schema["i"].dataType)
        no_order = [F.lit(None).cast(kinds[o]).alias(o) for o in order]
        known = states.select(*by, F.lit(0).alias("_kind"), *no_order, "_state", empty_in.alias("_in"))
        rows = late.select(*by, F.lit(1).alias("_kind"), *order, F.lit(None).cast(self._state_type()).alias("_state"), self._input().alias("_in"))
        at = ["_kind", *order]
        sample = late.select(*by, F.lit(1).alias("_kind"), *order)
        (bounds,) = prefix._cuts(sample, [by], at)
        both = known.unionByName(rows)
        if not bounds:
            return self._folded(both.repartition(*by).sortWithinPartitions(*by, *at), by, order)
        numbered, ends = prefix.in_ranges(both, by, at, bounds)
        carries = self._carries(numbered.where(ends), by).select(
            *by, F.lit(-1).alias("_kind"), *no_order, "_state", empty_in.alias("_in"), "_range")
        dealt = numbered.unionByName(carries).repartitionById(len(bounds) + 1, F.col("_range"))
        return self._folded(dealt.sortWithinPartitions("_range", *by, *at), by, order)

    def _fold(self) -> Callable[[tuple | None, pa.RecordBatch, int, int], tuple]:
        """(state so far, batch, row, place of its state) -> state with the row's own state or input."""
        zero, add, merge = self.zero, self.add, self.merge_states

        def fold(held, batch, at, place):
            own = batch.column(place)[at].as_py()
            if own is not None:
                return tuple(own.values()) if held is None else merge(held, tuple(own.values()))
            return add(zero() if held is None else held, pa.RecordBatch.from_struct_array(batch.column(place + 1).slice(at, 1)))

        return fold

    def _folded(self, rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        """The state after each late row, of rows in order."""
        schema = self._with_state(rows, [*by, *order])
        n, m, fold, as_dict = len(by), len(order), self._fold(), self._as_dict()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, now, held = _Out(schema), None, None
            for key, batch, at in _rows(batches, n + 1 + m):
                if key[:n] != now:
                    now, held = key[:n], None
                held = fold(held, batch, at, n + 1 + m)
                if key[n] == 1:
                    yield from out.add((*key[:n], *key[n + 1:], as_dict(held)))
            yield from out.flush()

        return rows.select(*by, "_kind", *order, "_state", "_in").mapInArrow(run, schema)

    def _carries(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """What earlier ranges hold of the groups at the ranges' ends: at most two rows per range."""
        schema = self._with_state(rows, [*by, "_range"])
        n, fold, merge, as_dict = len(by) + 1, self._fold(), self.merge_states, self._as_dict()

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, tuple] = {}
            for key, batch, at in _rows(batches, n):
                held[key] = fold(held.get(key), batch, at, n)
            out = _Out(schema)
            for key, state in held.items():
                yield from out.add((*key, as_dict(state)))
            yield from out.flush()

        def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, now, held = _Out(schema), None, None
            for key, batch, at in _rows(batches, n):
                own = tuple(batch.column(n)[at].as_py().values())
                if key[:-1] != now:
                    now, held = key[:-1], own
                    continue
                yield from out.add((*key, as_dict(held)))
                held = merge(tuple(held), own)
            yield from out.flush()

        whole = self.merge(rows.select(*by, "_range", "_state", "_in").mapInArrow(totals, schema), [*by, "_range"])
        return whole.repartition(*by).sortWithinPartitions(*by, "_range").mapInArrow(before, schema)

    def finish(self, firings: DataFrame, head: Sequence) -> DataFrame:
        ship_package(firings.sparkSession)
        own = firings.select(*head, "_state")
        names = own.columns[:-1]
        schema = T.StructType([*[own.schema[c] for c in names], *_schema(self.result).fields])
        n, finish = len(names), self.finish_state

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrow = to_arrow_schema(schema)
            for batch in batches:
                results = [finish(tuple(s.values())) for s in batch.column(n).to_pylist()]
                columns = list(zip(*results)) if results else [[]] * (len(arrow) - n)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[n:])]], names=arrow.names)

        return own.mapInArrow(run, schema)


@dataclass(frozen=True)
class ArrowFunction:
    """A window function in Python (G6): batches of firings in, 0..n rows per firing out.

    ``function`` gets an Arrow batch with the columns of the output (keys, window, out_ts, fire, triggers,
    results) and returns an Arrow batch or table with the columns of ``schema`` (DDL).
    """

    function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]
    schema: str

    def apply(self, firings: DataFrame) -> DataFrame:
        ship_package(firings.sparkSession)
        schema, function = _schema(self.schema), self.function

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrow = to_arrow_schema(schema)
            for batch in batches:
                found = function(batch)
                table = pa.Table.from_batches([found]) if isinstance(found, pa.RecordBatch) else found
                yield from table.select(arrow.names).cast(arrow).to_batches()

        return firings.mapInArrow(run, schema)
