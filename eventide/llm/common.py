"""Helpers shared by the corpus operators."""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.packaging import ship_package
from eventide.plans.materialize import delete
from eventide.session import scratch_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; also makes the package importable on the executors."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col(f"`{name}`")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names.

    Whatever else the input carries, also columns named like an output of the
    operator, is left behind here and cannot clash.
    """
    return df.select(*[col(c).alias(out) for out, c in columns.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table below ``spark.checkpoint.dir``, read back.

    Cuts the lineage: a lost executor costs a reread of files, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark, name)}/table"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PLACES[id(table)] = (weakref.ref(table), path)
    return table


#: Where ``written`` put its tables, by the identity of what it returned.
_PLACES: dict[int, tuple[weakref.ref, str]] = {}


def dropped(*tables: DataFrame) -> None:
    """Delete what ``written`` stored, for tables that no plan reads any more."""
    for table in tables:
        known, path = _PLACES.pop(id(table), (None, None))
        if known is not None and known() is table:
            delete(table.sparkSession, [path])


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Jobs that run inside send at most ``size`` bytes at once to a Python worker: for rows of large arrays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2: rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
