"""Running (prefix) aggregates in arrival order without a single hot task.

``max(ts) over (partition by key order by arrival)`` puts every row of a key in
one task, and the global watermark (no key at all) puts the whole table in one
task. Both are unacceptable when one key holds a third of the data, or when all rows
of a bulk load carry one arrival value.

The scan here cuts the rows themselves: their places (hash of the keys, then the whole
order) are sampled, and the sample's quantiles cut them into as many ranges of equal
rows as there are shuffle partitions. Every task gets one range, so a hot key is as many
tasks as it has ranges' worth of rows, whatever its arrival values. A running aggregate
inside a range lacks only what earlier ranges hold of the same keys, and only the keys at a
range's two ends lie in other ranges: a partial aggregate over those (at most two
rows per range) gives the carries, which are broadcast. The rows are shuffled and sorted once.

A cut inside a key that is small by the sample is moved to the key's beginning. If every cut lies
between keys, there is nothing to carry, and the input is read for the scan alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"max": F.max, "min": F.min, "sum": F.sum}

#: Rows that are worth a range of their own, and sampled places per range.
RANGE_ROWS, SAMPLED = 100_000, 64

Outputs = dict[str, tuple[str, str, bool]]


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: Outputs,
    sample_of: DataFrame | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Add running aggregates over rows of the same ``keys`` in ``order``.

    outputs: ``{name: (op, source_column, inclusive)}`` with op in max/min/sum;
    ``inclusive=False`` excludes the current row (frame ends one row before).
    NULL sources are ignored; a frame with no value yields NULL. ``order`` must be
    a total order within ``keys``, unless every output is inclusive and rows that tie have
    the same result.

    The rows are counted and sampled before the plan is built. ``sample_of`` has the
    columns ``keys`` and ``order`` and is counted and sampled instead: a cheaper table
    with places like those of ``df``; ``n_rows``: about how many rows are sampled, if that is
    known. The cuts decide the balance of the tasks, not the result.
    """
    return prefix_scans(df, [(keys, outputs)], order, sample_of, n_rows)


def prefix_scans(
    df: DataFrame,
    scans: Sequence[tuple[Sequence[str], Outputs]],
    order: Sequence[str],
    sample_of: DataFrame | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Several prefix scans with different partition keys over the same rows: counted and sampled once."""
    order = list(order)
    for _, outputs in scans:
        for name, (op, _, _) in outputs.items():
            if op not in _AGG:
                raise ValueError(f"unsupported prefix operation {op!r} for {name!r}")
    cuts = _cuts(df if sample_of is None else sample_of, [list(keys) for keys, _ in scans], order, n_rows)
    for (keys, outputs), bounds in zip(scans, cuts):
        df = _scan(df, list(keys), order, outputs, bounds)
    return df


def _place(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> list[Column]:
    """A row's place in the order that is cut: equal keys are next to each other. The order counts up to its
    first column that is neither a number without fraction nor a string, date or timestamp."""
    place = [F.xxhash64(*keys)] * bool(keys)
    for o in order:
        kind = df.schema[o].dataType.simpleString()
        if kind in ("bigint", "int", "smallint", "tinyint", "string"):
            place.append(F.col(o))
        elif kind in ("date", "timestamp"):
            place.append(F.unix_date(o) if kind == "date" else F.unix_micros(o))
        else:
            break
    return place


def _cuts(df: DataFrame, scans: list[list[str]], order: list[str], n_rows: int | None = None) -> list[list[tuple]]:
    """For each scan's keys the places at which its rows are cut, ascending; none for few rows.

    The driver gets about ``SAMPLED`` places per range.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_rows = df.count() if n_rows is None else n_rows
    ranges = min(tasks, ceil(n_rows / RANGE_ROWS))
    if ranges < 2:
        return [[] for _ in scans]
    fine = 1 << 30
    share = min(fine, ceil(fine * SAMPLED * ranges / n_rows))
    keyed = {k for keys in scans for k in keys}
    # rows are chosen by a hash of all their columns, so a recomputed sample is the same
    chosen = df.where(F.pmod(F.xxhash64(*sorted(keyed), *order), F.lit(fine)) < share).select(
        *[F.struct(F.lit(0), *_place(df, keys, order)) for keys in scans]).collect()
    out = []
    for i in range(len(scans)):
        places = sorted((tuple(r[i])[1:] for r in chosen), key=lambda p: tuple((v is not None, v) for v in p))
        picked = [places[len(places) * k // ranges] for k in range(1, ranges)] if places else []
        if scans[i]:
            weight = Counter(p[0] for p in places)
            picked = [(p[0], *[None] * (len(p) - 1)) if weight[p[0]] <= SAMPLED // 4 else p for p in picked]
        out.append([p for k, p in enumerate(picked) if p and (k == 0 or p != picked[k - 1])])
    return out


def _inside(bound: tuple) -> bool:
    """Whether a cut may lie inside a key: NULLs come first, so a cut at NULLs is before all rows of its key."""
    return any(v is not None for v in bound[1:])


def _array(values: Sequence, kind: str) -> Column:
    if kind in ("bigint", "int") and all(v is not None for v in values):
        return F.expr(f"array({', '.join(f'cast({v} as {kind})' for v in values)})")
    return F.array(*[F.lit(v).cast(kind) for v in values])


def _scan(df: DataFrame, keys: list[str], order: list[str], outputs: Outputs, bounds: list[tuple]) -> DataFrame:
    def frames(by: list[str], at: list[str]):
        w = Window.partitionBy(*by).orderBy(*at)
        return {True: w.rowsBetween(Window.unboundedPreceding, 0), False: w.rowsBetween(Window.unboundedPreceding, -1)}

    if not bounds:
        running = frames(keys, order)
        return df.select("*", *[_AGG[op](src).over(running[inclusive]).alias(name) for name, (op, src, inclusive) in outputs.items()])

    # what the earlier ranges hold of the keys at a range's two ends
    numbered, ends = in_ranges(df, keys, order, bounds)
    at = F.col("_range")
    if keys and not any(map(_inside, bounds)):
        running = frames(["_range", *keys], order)
        dealt = numbered.repartitionById(len(bounds) + 1, at)
        return dealt.select("*", *[_AGG[op](src).over(running[inclusive]).alias(name) for name, (op, src, inclusive) in outputs.items()]).drop("_range")
    sources = {(op, src): f"_carry{i}" for i, (op, src) in enumerate(dict.fromkeys((op, src) for op, src, _ in outputs.values()))}
    totals = numbered.where(ends).groupBy("_range", *keys).agg(*[_AGG[op](src).alias(c) for (op, src), c in sources.items()])
    before = frames(keys, ["_range"])[False]
    carries = totals.select(F.col("_range").alias("_range_c"), *[F.col(k).alias(f"_c_{k}") for k in keys],
                            *[_AGG[op](c).over(before).alias(c) for (op, _), c in sources.items()])

    dealt = numbered.repartitionById(len(bounds) + 1, at)
    running = frames(["_range", *keys], order)
    out = dealt.select("*", *[_AGG[op](src).over(running[inclusive]).alias(name) for name, (op, src, inclusive) in outputs.items()])
    same = [out["_range"] == carries["_range_c"], *[out[k].eqNullSafe(carries[f"_c_{k}"]) for k in keys]]
    out = out.join(F.broadcast(carries), same, "left")  # at most two rows per range
    whole = {}
    for name, (op, src, _) in outputs.items():
        carry, inside = F.col(sources[op, src]).cast(out.schema[name].dataType), F.col(name)
        if op == "sum":
            whole[name] = F.when(carry.isNull(), inside).when(inside.isNull(), carry).otherwise(carry + inside)
        else:
            whole[name] = F.greatest(carry, inside) if op == "max" else F.least(carry, inside)
    return out.withColumns(whole).drop("_range", "_range_c", *[f"_c_{k}" for k in keys], *sources.values())


def in_ranges(df: DataFrame, keys: list[str], order: list[str], bounds: list[tuple]) -> tuple[DataFrame, Column]:
    """``df`` with the number of each row's range, ``_range``, and whether a row's keys may go on beyond an end of its range."""
    place = _place(df, keys, order)
    kinds = [f.dataType.simpleString() for f in df.select(*place).schema.fields]
    columns = [_array(c, kind) for c, kind in zip(zip(*bounds), kinds)]
    ends = F.lit(True)
    if keys:
        own, at = F.xxhash64(*keys), F.col("_range")
        cut = _array([b[0] if _inside(b) else None for b in bounds], kinds[0])
        ends = F.coalesce(own == F.get(cut, at - 1), F.lit(False)) | F.coalesce(own == F.get(cut, at), F.lit(False))
    return _numbered(df, place, columns, len(bounds)), ends


def _numbered(df: DataFrame, place: list[Column], columns: list[Column], n: int) -> DataFrame:
    """``_range``: the number of bounds at or before each row's place, by a binary search in column expressions."""
    out = df.withColumn("_place", F.struct(*[c.alias(f"p{i}") for i, c in enumerate(place)])).withColumn("_range", F.lit(0))
    step = 1
    while step * 2 <= n:
        step *= 2
    while step:
        at = F.col("_range") + F.lit(step - 1)
        bound = F.struct(*[F.get(c, at).alias(f"p{i}") for i, c in enumerate(columns)])
        reached = (at < n) & (bound <= F.col("_place"))
        out = out.withColumn("_range", F.col("_range") + F.when(reached, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    # what follows rand() is not moved below it: a filter on the range would repeat the whole search
    return out.withColumn("_range", F.col("_range") + F.floor(F.rand(0)).cast("int")).drop("_place")
