"""The driver's ``orders`` table as a second event stream.

Key ``o_custkey``, event time ``o_orderdate``, arrival order ``o_orderkey``
(unique). Order keys are not in date order, so per-customer and global
watermarks both see late orders. ``v`` is the total price in integer cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.sources.events import read_table, with_event_time

KEY = "o_custkey"
TS = "ts_ms"
ORDER = ("o_orderkey",)


def order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    df = with_event_time(raw, "o_orderdate")
    return df.select("o_orderkey", "o_custkey", "ts_ms",
                     F.expr("cast(round(o_totalprice * 100) as bigint)").alias("v"))


# The same stream for the oracle, under the generic column names of the SQL generator.
ORDERS_AS_EVENTS_SQL = """
  SELECT o_orderkey AS event_id, o_custkey AS user_id, epoch_us(o_orderdate) // 1000 AS ts_ms,
         o_orderkey AS arr_ms, CAST(round(o_totalprice * 100) AS BIGINT) AS v
  FROM orders
"""
