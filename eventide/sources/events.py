"""The driver's ``events`` table as an out-of-order event stream.

``events`` is stored in event-time order, so every lateness branch would stay
cold. The arrival order below (integer arithmetic only, identical in Spark and
DuckDB) gives every device (``user_id``) a constant skew and every row a jitter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the arrival recipe (must match the oracle SQL):
#   arr_ms = ts_ms + ((user_id * 7919) % 97) * 900000 + ((event_id * 104729) % 61) * 360000
SKEW_MULT, SKEW_MOD, SKEW_STEP_MS = 7919, 97, 900_000
JITTER_MULT, JITTER_MOD, JITTER_STEP_MS = 104729, 61, 360_000

KEY = "user_id"
TS = "ts_ms"
ORDER = ("arr_ms", "event_id")

# epoch milliseconds without any session time zone: a TIMESTAMP_NTZ column is
# measured from the NTZ epoch, a TIMESTAMP (instant) column by unix_micros
TS_MS_NTZ_SQL = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c}) div 1000"
TS_MS_LTZ_SQL = "unix_micros({c}) div 1000"
ARR_MS_SQL = (
    f"ts_ms + ((user_id * {SKEW_MULT}) % {SKEW_MOD}) * {SKEW_STEP_MS}"
    f" + ((event_id * {JITTER_MULT}) % {JITTER_MOD}) * {JITTER_STEP_MS}"
)
VALUE_CENTS_SQL = "cast(round(value * 100) as bigint)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_ms_sql(df: DataFrame, column: str) -> str:
    """SQL for the epoch milliseconds of a timestamp column, independent of the session time zone."""
    from pyspark.sql.types import TimestampNTZType, TimestampType

    dtype = df.schema[column].dataType
    if isinstance(dtype, TimestampNTZType):
        return TS_MS_NTZ_SQL.format(c=column)
    if isinstance(dtype, TimestampType):
        return TS_MS_LTZ_SQL.format(c=column)
    return f"cast({column} as bigint)"  # already a number of milliseconds


def with_event_time(df: DataFrame, column: str = "ts", name: str = TS) -> DataFrame:
    """Attach the event time as a BIGINT millisecond column."""
    return df.withColumn(name, F.expr(epoch_ms_sql(df, column)).cast("bigint"))


def event_stream(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("event_type", "value")) -> DataFrame:
    """events → (event_id, user_id, ts_ms, arr_ms, v, <columns>) with the arrival order.

    Only the columns needed downstream are selected, so the parquet scan reads
    just those (column pruning); ``v`` is ``value`` in integer cents so sums do
    not depend on summation order.
    """
    raw = read_table(spark, sf_dir, "events")
    keep = [c for c in columns if c not in ("event_id", "user_id", "ts", "value")]
    df = raw.select("event_id", "user_id", "ts", "value", *keep)
    df = with_event_time(df)
    df = df.withColumn("arr_ms", F.expr(ARR_MS_SQL).cast("bigint"))
    df = df.withColumn("v", F.expr(VALUE_CENTS_SQL))
    cols = ["event_id", "user_id", "ts_ms", "arr_ms", "v"] + [c for c in keep]
    if "value" in columns:
        cols.append("value")
    return df.select(*cols)


# SQL of the same stream, for DuckDB oracles (``epoch_us`` = unix_micros).
EVENT_STREAM_SQL = f"""
  SELECT event_id, user_id, ts_ms,
         ts_ms + ((user_id * {SKEW_MULT}) % {SKEW_MOD}) * {SKEW_STEP_MS}
               + ((event_id * {JITTER_MULT}) % {JITTER_MOD}) * {JITTER_STEP_MS} AS arr_ms,
         CAST(round(value * 100) AS BIGINT) AS v, event_type, value
  FROM (SELECT *, epoch_us(ts) // 1000 AS ts_ms FROM events)
"""
