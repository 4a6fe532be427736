"""Window aggregates (G1-G3): how rows become state, state a firing, and late rows a refire.

* :class:`Accumulator`: named fields, each a mergeable built-in (sum, count, min, max) of an
  input expression, plus result expressions over them.
* :class:`DistinctCount`: the number of different values; its state is one row per window and value.
* :class:`ColumnAggregate`: any Spark aggregate Column; its state is the rows themselves.
* ``functions/code.py``: an accumulator written in Python.

All have the same form, so each works in batch and in streams, with late refires. ``by`` lists the columns
of a group (of rows, or of a window):

* ``inputs()``              columns that the rows get, named ``_in_...``
* ``increments(rows, by)``  state of rows
* ``merge(states, by)``     the same state in fewer rows
* ``summary(states, by)``   one row per group, with ``field_names``
* ``refires(late, states, by, order)``  one row per late row, fields as of that row
* ``alone(late, by, order)``            one row per late row, fields of that row
* ``finish(firings, head)``             ``head`` and the results
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.plans.prefix import prefix_scan
from eventide.plans.reach import null_safe_join

OPS = ("sum", "count", "min", "max")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Accumulator:
    """fields: (name, op, input); result: (name, expression over field names)."""

    fields: tuple[tuple[str, str, Column | str], ...]
    result: tuple[tuple[str, Column], ...] | None = None

    def __post_init__(self):
        if not self.fields:
            raise ValueError("an accumulator needs at least one field")
        for name, op, _ in self.fields:
            if op not in OPS:
                raise ValueError(f"accumulator field {name!r}: op must be one of {OPS}, not {op!r}")

    @property
    def field_names(self) -> list[str]:
        return [n for n, _, _ in self.fields]

    @property
    def result_names(self) -> list[str]:
        return [n for n, _ in self.result] if self.result else self.field_names

    def inputs(self) -> list[Column]:
        """Input expressions materialised as ``_in_<field>`` columns."""
        return [_col(expr).alias(f"_in_{n}") for n, _, expr in self.fields]

    def agg_exprs(self) -> list[Column]:
        """Aggregate of many rows (over ``_in_`` columns)."""
        out = []
        for n, op, _ in self.fields:
            c = F.col(f"_in_{n}")
            out.append({"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[op](c).alias(n))
        return out

    def single_exprs(self) -> list[Column]:
        """Accumulator of one row alone."""
        out = []
        for n, op, _ in self.fields:
            c = F.col(f"_in_{n}")
            if op == "count":
                c = F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
            out.append(c.alias(n))
        return out

    def scan_sources(self) -> list[Column]:
        """Per-row sources for a running prefix: count becomes a sum of indicators."""
        out = []
        for n, op, _ in self.fields:
            c = F.col(f"_in_{n}")
            if op == "count":
                c = F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
            out.append(c.alias(f"_src_{n}"))
        return out

    def scan_ops(self) -> dict[str, str]:
        return {n: ("sum" if op == "count" else op) for n, op, _ in self.fields}

    def increments(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*self.agg_exprs())

    def merge(self, states: DataFrame, by: Sequence[str]) -> DataFrame:
        merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
        out = [(merge[op](n).cast("bigint") if op == "count" else merge[op](n)).alias(n) for n, op, _ in self.fields]
        return states.groupBy(*by).agg(*out)

    def summary(self, states: DataFrame, by: Sequence[str]) -> DataFrame:
        """``states`` is merged: one row per group already."""
        return states

    def refires(self, late: DataFrame, states: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        """The fields of ``states`` plus a running aggregate over the group's late rows."""
        ops = self.scan_ops()
        rows = late.select(*by, *order, *self.scan_sources())
        scanned = prefix_scan(rows, by, order, {f"_run_{n}": (ops[n], f"_src_{n}", True) for n in self.field_names})
        before = states.select(*by, *[F.col(n).alias(f"_on_{n}") for n in self.field_names])
        joined = null_safe_join(scanned, before, by, "left")
        return joined.select(*by, *order, *[self.merge_expr(op, F.col(f"_on_{n}"), F.col(f"_run_{n}")).alias(n) for n, op, _ in self.fields])

    def alone(self, late: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        return late.select(*by, *order, *self.single_exprs())

    def finish(self, firings: DataFrame, head: Sequence) -> DataFrame:
        return firings.select(*head, *self.result_exprs())

    @staticmethod
    def merge_expr(op: str, a: Column, b: Column) -> Column:
        if op == "max":
            return F.greatest(a, b)
        if op == "min":
            return F.least(a, b)
        if op == "count":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)

    def result_exprs(self) -> list[Column]:
        if not self.result:
            return [F.col(n) for n in self.field_names]
        return [expr.alias(n) for n, expr in self.result]


@dataclass(frozen=True)
class DistinctCount:
    """How many different values (NULL does not count) a window has, exactly.

    The state has one row per window and value. A refire at a late row counts the values whose first
    arrival is not after it: a prefix count of first arrivals, without meeting pairs of rows.
    """

    column: Column | str
    name: str = "distinct"

    @property
    def field_names(self) -> list[str]:
        return [self.name]

    @property
    def result_names(self) -> list[str]:
        return [self.name]

    def inputs(self) -> list[Column]:
        return [_col(self.column).alias("_in_value")]

    def increments(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return rows.select(*by, F.col("_in_value").alias("_value")).distinct()

    def merge(self, states: DataFrame, by: Sequence[str]) -> DataFrame:
        return states.select(*by, "_value").distinct()

    def summary(self, states: DataFrame, by: Sequence[str]) -> DataFrame:
        return states.groupBy(*by).agg(F.count("_value").alias(self.name))

    def refires(self, late: DataFrame, states: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        rows = late.select(*by, *order, F.col("_in_value").alias("_value"))
        first = rows.where("_value IS NOT NULL").groupBy(*by, "_value").agg(F.min(F.struct(*order)).alias("_first"))
        known = states.where("_value IS NOT NULL").withColumn("_known", F.lit(1))
        new = null_safe_join(first, known, [*by, "_value"], "left").where("_known IS NULL")
        moments = new.select(*by, *[F.col("_first")[o].alias(o) for o in order], F.lit(0).alias("_kind"))
        both = moments.unionByName(rows.select(*by, *order, F.lit(1).alias("_kind"))).withColumn("_new", (1 - F.col("_kind")).cast("bigint"))
        scanned = prefix_scan(both, by, [*order, "_kind"], {"_run": ("sum", "_new", True)}).where("_kind = 1")
        counted = self.summary(states, by).withColumnRenamed(self.name, "_on")
        total = F.coalesce("_on", F.lit(0)) + F.coalesce("_run", F.lit(0))
        return null_safe_join(scanned, counted, by, "left").select(*by, *order, total.alias(self.name))

    def alone(self, late: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        return late.select(*by, *order, F.col("_in_value").isNotNull().cast("bigint").alias(self.name))

    def finish(self, firings: DataFrame, head: Sequence) -> DataFrame:
        return firings.select(*head, self.name)


@dataclass(frozen=True)
class ColumnAggregate:
    """Any aggregate Columns over the input's ``columns``. The state holds the rows.

    Refires are the aggregates as window functions over the group's rows, on-time ones first: one sort. Aggregates
    that Spark does not take as window functions (DISTINCT ones: see ``DistinctCount``)
    meet each late row with the group's rows before it instead.
    """

    aggregates: dict[str, Column]
    columns: tuple[str, ...]

    @property
    def field_names(self) -> list[str]:
        return list(self.aggregates)

    @property
    def result_names(self) -> list[str]:
        return list(self.aggregates)

    def inputs(self) -> list[Column]:
        return []

    def _aggs(self) -> list[Column]:
        return [c.alias(n) for n, c in self.aggregates.items()]

    def increments(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return rows.select(*dict.fromkeys([*by, *self.columns]))

    def merge(self, states: DataFrame, by: Sequence[str]) -> DataFrame:
        return self.increments(states, by)

    def summary(self, states: DataFrame, by: Sequence[str]) -> DataFrame:
        return states.groupBy(*by).agg(*self._aggs())

    def refires(self, late: DataFrame, states: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        own = self.increments(late, by).withColumn("_late", F.lit(1))
        rows = self.increments(states, by).withColumn("_late", F.lit(0)).unionByName(own)
        w = Window.partitionBy(*by).orderBy("_late", *order).rowsBetween(Window.unboundedPreceding, 0)
        try:
            return rows.select(*by, *order, "_late", *[c.over(w).alias(n) for n, c in self.aggregates.items()]).where("_late = 1").drop("_late")
        except AnalysisException:
            moments = late.select(*by, *[F.col(o).alias(f"_at_{o}") for o in order])
            both = null_safe_join(rows, moments, by, "inner")
            before = (F.col("_late") == 0) | (F.struct(*order) <= F.struct(*[F.col(f"_at_{o}").alias(o) for o in order]))
            return both.filter(before).groupBy(*by, *[f"_at_{o}" for o in order]).agg(*self._aggs()).withColumnsRenamed({f"_at_{o}": o for o in order})

    def alone(self, late: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        return late.groupBy(*by, *order).agg(*self._aggs())

    def finish(self, firings: DataFrame, head: Sequence) -> DataFrame:
        return firings.select(*head, *self.field_names)


def count_of(name: str = "n") -> Accumulator:
    """Count per key and window (G1)."""
    return Accumulator(((name, "count", F.lit(1)),))


def sum_of(column: Column | str, name: str = "total") -> Accumulator:
    """Sum per key and window."""
    return Accumulator(((name, "sum", _col(column)),))


def spread_of(column: Column | str, name: str = "spread") -> Accumulator:
    """User-defined example (G3): max minus min of a value."""
    c = _col(column)
    return Accumulator(
        (("_hi", "max", c), ("_lo", "min", c)),
        ((name, F.col("_hi") - F.col("_lo")),),
    )


def distinct_of(column: Column | str, name: str = "distinct") -> DistinctCount:
    """Number of different values per key and window."""
    return DistinctCount(column, name)


def mean_of(column: Column | str, name: str = "mean") -> Accumulator:
    """Average as sum and count; NULL without a value."""
    c = _col(column)
    return Accumulator((("_sum", "sum", c), ("_count", "count", c)),
                       ((name, F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count"))),))


def combine(*accs: Accumulator) -> Accumulator:
    """Several accumulators side by side (field names must not clash)."""
    fields = tuple(f for a in accs for f in a.fields)
    names = [n for n, _, _ in fields]
    if len(set(names)) != len(names):
        raise ValueError(f"accumulator field names clash: {names}")
    result = tuple(r for a in accs for r in (a.result or tuple((n, F.col(n)) for n in a.field_names)))
    return Accumulator(fields, result)
