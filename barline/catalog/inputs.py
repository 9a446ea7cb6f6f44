"""Tables the registered queries share, and their SQL twins.

* ``ticks``: events as a price stream per user (many short keys);
* ``hourly``: one-hour bars per event type (few heavy keys, calendar-bounded);
* ``ledger``: line items joined with orders as closed trades.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.clock import HOUR_US
from barline.operators.bars import resample
from barline.plans.series import Series
from barline.sources.readers import read_table


def ticks(spark: SparkSession, sf: str, key: str = "user_id") -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.select(
        F.col(key).cast("string").alias("series_id") if key != "user_id" else F.col(key).alias("series_id"),
        "ts",
        F.col("event_id").alias("tie"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        "event_type",
        "user_id",
    )


TICKS_SQL = """
ticks AS (SELECT user_id AS series_id, ts, event_id AS tie, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_type, user_id FROM events)"""


def hourly(spark: SparkSession, sf: str, width_us: int = HOUR_US) -> DataFrame:
    return resample(ticks(spark, sf, "event_type"), "series_id", width_us).drop("n_ticks")


HOURS_PER_KEY = 24 * 366 * 20  # rows per key of an hourly grid over twenty years


def hourly_series(spark: SparkSession, sf: str) -> Series:
    return Series(hourly(spark, sf), "series_id", ["ts"], bounded_rows=HOURS_PER_KEY)


HOURLY_SQL = """
hb AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
  first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close,
  sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume,
  date_trunc('hour', ts) + INTERVAL 1 HOUR AS available_at
  FROM events GROUP BY event_type, date_trunc('hour', ts)),
bars AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM hb)"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    od = read_table(spark, sf, "orders")
    return (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .filter("l_shipdate >= o_orderdate")
        .select(
            F.col("l_orderkey"),
            F.col("l_linenumber"),
            F.col("o_orderpriority").alias("strategy"),
            F.col("l_returnflag").alias("label"),
            F.col("l_suppkey").alias("pair"),
            F.col("o_orderdate").alias("entry_time"),
            F.col("l_shipdate").alias("exit_time"),
            (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"),
            F.col("l_quantity").alias("units"),
            F.col("l_extendedprice").alias("notional"),
            F.col("o_custkey").alias("account"),
        )
    )


LEDGER_SQL = """
ledger AS (SELECT l_orderkey, l_linenumber, o_orderpriority AS strategy, l_returnflag AS label,
  l_suppkey AS pair, o_orderdate AS entry_time, l_shipdate AS exit_time,
  l_extendedprice * (l_discount - l_tax) AS pnl, l_quantity AS units,
  l_extendedprice AS notional, o_custkey AS account
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate)"""


def with_sql(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes) + "\n" + body
