"""When does a watermark first reach a target? (the firing moment of a window)

For every target (keys, M), find the earliest row in arrival order of the same
keys whose watermark after it is >= M. Targets and rows where the watermark advances
are put in one table in descending order of the value, rows before targets: the
first row that reaches a target is the smallest arrival among all rows before it. So
the search is one prefix scan (``plans/prefix.py``), cut into ranges of equal rows
like any other: no join, no pairs, no task that holds a whole key or all window ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.plans.prefix import prefix_scan


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join on same-named columns with NULL == NULL; keeps one copy of ``on``."""
    on = list(on)
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = [left[c].eqNullSafe(r[f"_r_{c}"]) for c in on]
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def first_reaching(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: str,
    after: str,
    targets: DataFrame,
    target: str,
    likely: Column | None = None,
    prefix: str = "trigger_",
    n_rows: int | None = None,
    few: bool = False,
) -> DataFrame:
    """targets + ``trigger_<order>`` columns: the first row with ``after >= target``.

    ``rows`` carry ``before``/``after`` watermarks (NULL = none); targets with no
    such row get NULL triggers, and so do targets that were reached before the rows began (the first row's
    ``before`` has reached them). ``likely``: a BIGINT column of ``rows`` distributed like the targets,
    so that the cuts are fit for them too (the targets themselves are not computed twice). ``n_rows``: how many ``rows`` there are, if known.
    ``few``: the targets and the rows that advance are likely much fewer than the rows: they are counted and sampled themselves.
    """
    keys, order = list(keys), list(order)
    at = ["_down", "_kind", "_tie"]
    advance = rows.filter(F.col(after).isNotNull() & (F.col(before).isNull() | (F.col(after) > F.col(before))))
    tie = F.xxhash64(*order).alias("_tie")
    advance = advance.select(*keys, F.bitwise_not(after).alias("_down"), F.lit(0).alias("_kind"), tie, F.struct(*order, F.col(before).alias("_seen")).alias("_at"))
    goals = targets.withColumns({"_down": F.bitwise_not(target), "_kind": F.lit(1), "_tie": F.xxhash64(*targets.columns)})
    both = goals.unionByName(advance, allowMissingColumns=True)
    values = [F.struct(F.bitwise_not(c).alias("_down"), F.lit(kind).alias("_kind")) for kind, c in enumerate([F.col(after), likely]) if c is not None]
    sample = rows.select(*keys, F.inline(F.array(*values)), tie).where("_down IS NOT NULL")
    scanned = prefix_scan(both, keys, at, {"_first": ("min", "_at", True)}, None if few else sample,
                          None if few or n_rows is None else n_rows * len(values))
    now = F.col("_first")["_seen"].isNull() | (F.col("_first")["_seen"] < F.col(target))
    return scanned.filter(F.col("_kind") == 1).select(*targets.columns, *[F.when(now, F.col("_first")[o]).alias(prefix + o) for o in order])
