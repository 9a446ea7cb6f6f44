"""Bars, grids and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.inputs import HOURLY_SQL, TICKS_SQL, hourly, ticks, with_sql
from barline.catalog.registry import query
from barline.functions.clock import DAY_US, HOUR_US, MINUTE_US
from barline.operators import table_functions
from barline.operators import bars as B
from barline.operators import eventbars as EB
from barline.operators.asof import asof
from barline.plans.series import Series
from barline.sources.readers import read_table

OHLC = "open:f high:f low:f close:f volume:f"
OHLC_SQL = """first(price ORDER BY ts, tie) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, tie) AS close, sum(volume) AS volume"""


@query("flagship_bars_zscore_asof", "series_id:s ts:t close:f z:f h_close:f h_high:f",
       with_sql(TICKS_SQL, f"""
       m5 AS (SELECT event_type AS series_id, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, {OHLC_SQL} FROM ticks GROUP BY 1, 2),
       z AS (SELECT series_id, ts, close, CASE WHEN count(*) OVER w = 20 AND stddev_pop(close) OVER w > 0
             THEN (close - avg(close) OVER w) / stddev_pop(close) OVER w END AS z
             FROM m5 WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING)),
       h1 AS (SELECT event_type AS series_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS available_at, {OHLC_SQL} FROM ticks GROUP BY 1, 2)""",
       body="""SELECT z.series_id, z.ts, z.close, z.z, h1.close AS h_close, h1.high AS h_high
       FROM z ASOF LEFT JOIN h1 ON z.series_id = h1.series_id AND z.ts >= h1.available_at"""))
def flagship(spark, sf):
    from barline.operators.windows import zscore

    t = B.dedupe(ticks(spark, sf, "event_type").drop("event_type", "user_id"), ["series_id", "ts", "tie"], ["ts", "tie"])
    m5 = B.resample(t, "series_id", 5 * MINUTE_US)
    z = Series(m5, "series_id", ["ts"]).columns(lambda fr: {"z": zscore(fr, F.col("close"), 20, 0)}, back_rows=20)
    h1 = B.resample(t, "series_id", HOUR_US)
    return B.project_completed(z, h1, "series_id", ["close", "high"], "h_")


@query("b01_resample", f"series_id:i ts:t {OHLC} n_ticks:i",
       with_sql(TICKS_SQL, body=f"SELECT series_id, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, {OHLC_SQL}, count(*) AS n_ticks FROM ticks GROUP BY 1, 2"))
def b01(spark, sf):
    return B.resample(ticks(spark, sf), "series_id", 5 * MINUTE_US)


NY_DAILY_SQL = f"""
loc AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lt FROM tk),
bin AS (SELECT *, time_bucket(INTERVAL 4 HOUR, lt - INTERVAL 1 HOUR) + INTERVAL 1 HOUR AS ls FROM loc),
utc AS (SELECT *, (ls AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS s FROM bin),
good AS (SELECT * FROM utc WHERE NOT (
   (s AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' <> ls
   OR ((s + INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' = ls
   OR ((s - INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' = ls))"""


def dst_ticks(spark, sf):
    """Orders as ticks: their dates span years, so many clock changes; hours come from the key."""
    o = read_table(spark, sf, "orders")
    us = F.unix_micros("o_orderdate") + F.pmod(F.col("o_orderkey"), F.lit(24)) * HOUR_US
    return o.select(F.substring("o_orderpriority", 1, 1).alias("series_id"), F.timestamp_micros(us).alias("ts"),
                    F.col("o_orderkey").alias("tie"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"))


DST_TICKS_SQL = """
tk AS (SELECT substr(o_orderpriority, 1, 1) AS series_id, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS ts,
  o_orderkey AS tie, o_totalprice AS price, 1.0 AS volume FROM orders)"""


@query("b02_resample_anchored", f"series_id:s ts:t {OHLC}",
       with_sql(DST_TICKS_SQL, NY_DAILY_SQL, body=f"""SELECT series_id, s AS ts, {OHLC_SQL} FROM good GROUP BY 1, 2"""))
def b02(spark, sf):
    return B.resample_anchored(dst_ticks(spark, sf), "series_id", 4, "America/New_York", 17)


@query("b03_resample_right", f"series_id:i ts:t {OHLC}",
       with_sql(TICKS_SQL, body=f"""SELECT series_id, CASE WHEN time_bucket(INTERVAL 1 HOUR, ts) = ts THEN ts
         ELSE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR END AS ts, {OHLC_SQL.replace('ORDER BY ts', 'ORDER BY ticks.ts')} FROM ticks GROUP BY 1, 2"""))
def b03(spark, sf):
    return B.resample(ticks(spark, sf), "series_id", HOUR_US, closed="right")


@query("b04_drop_partial", f"series_id:s ts:t {OHLC}",
       with_sql(TICKS_SQL, f"""d AS (SELECT event_type AS series_id, date_trunc('day', ts) AS ts, {OHLC_SQL} FROM ticks GROUP BY 1, 2),
         l AS (SELECT event_type AS series_id, max(ts) AS last FROM ticks GROUP BY 1)""",
         body="SELECT d.* FROM d JOIN l USING (series_id) WHERE ts + INTERVAL 1 DAY <= last"))
def b04(spark, sf):
    t = ticks(spark, sf, "event_type")
    return B.drop_partial(B.resample(t, "series_id", DAY_US), t, "series_id")


@query("b05_volume_bars", f"series_id:i bar_id:i ts:t {OHLC} n_ticks:i",
       with_sql(TICKS_SQL, body=f"""SELECT series_id, bar_id, min(ts) AS ts, {OHLC_SQL}, count(*) AS n_ticks FROM (
         SELECT *, CAST(floor((sum(volume) OVER (PARTITION BY series_id ORDER BY ts, tie) - volume) / 500) AS BIGINT) AS bar_id FROM ticks) GROUP BY 1, 2"""))
def b05(spark, sf):
    return B.volume_bars(ticks(spark, sf), "series_id", 500.0)


@query("b06_tick_count_bars", f"series_id:i bar_id:i ts:t {OHLC}",
       with_sql(TICKS_SQL, body=f"""SELECT series_id, bar_id, min(ts) AS ts, {OHLC_SQL} FROM (
         SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY ts, tie) - 1) // 10 AS bar_id FROM ticks) GROUP BY 1, 2"""))
def b06(spark, sf):
    return B.tick_count_bars(ticks(spark, sf), "series_id", 10)


@query("b06_tick_reset_bars", f"series_id:i bar_id:i ts:t {OHLC} n_ticks:i")
def b06r(spark, sf):
    return EB.tick_reset_bars(ticks(spark, sf), "series_id", 500.0)


@query("b07_range_bars", f"series_id:i segment:i bar_id:i ts:t {OHLC} n_ticks:i")
def b07(spark, sf):
    return EB.range_bars(ticks(spark, sf), "series_id", 60.0, max_gap_us=DAY_US)


@query("b08_atr_range_bars", f"series_id:i segment:i bar_id:i ts:t {OHLC} n_ticks:i")
def b08(spark, sf):
    return EB.range_bars(ticks(spark, sf), "series_id", 60.0, max_gap_us=DAY_US, atr=(14, 1.5, 30.0, 120.0))


@query("b09_box_columns", "series_id:i ts:t box_id:i column_id:i direction:i level:f")
def b09(spark, sf):
    return EB.box_columns(ticks(spark, sf), "series_id", 10.0, 3)


@query("b09_box_table_function", "series_id:i ts:t box_id:i column_id:i direction:i level:f")
def b09t(spark, sf):
    table_functions.register(spark)
    ticks(spark, sf).select("series_id", "ts", "tie", "price").createOrReplaceTempView("box_ticks")
    return spark.sql("SELECT * FROM price_boxes(TABLE(box_ticks) PARTITION BY series_id ORDER BY (ts, tie), 10.0D, 3)")


@query("b10_heiken_ashi", "series_id:s ts:t ha_open:f ha_high:f ha_low:f ha_close:f",
       with_sql(HOURLY_SQL, """
       x AS (SELECT *, (open + high + low + close) / 4 AS hc FROM bars),
       ho AS (SELECT t.series_id, t.rn, sum(CASE WHEN i.rn = 1 THEN pow(0.5, t.rn - 1) * (i.open + i.close) / 2 ELSE 0 END
              + CASE WHEN i.rn < t.rn THEN pow(0.5, t.rn - i.rn) * i.hc ELSE 0 END) AS ha_open
              FROM x t JOIN x i ON t.series_id = i.series_id AND i.rn <= t.rn GROUP BY 1, 2)""",
       body="""SELECT x.series_id, x.ts, ha_open, greatest(high, ha_open, hc) AS ha_high, least(low, ha_open, hc) AS ha_low, hc AS ha_close
       FROM x JOIN ho USING (series_id, rn)"""))
def b10(spark, sf):
    return EB.heiken_ashi(hourly(spark, sf), "series_id", bounded_rows=200_000)


@query("b11_common_grid", "series_id:s ts:t close:f",
       with_sql(HOURLY_SQL, body="""SELECT series_id, ts, close FROM bars WHERE ts IN
         (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM bars))"""))
def b11(spark, sf):
    return B.common_grid(hourly(spark, sf), "series_id")


@query("b12_coverage", "series_id:s n_slots:i expected:i share:f flagged:b",
       with_sql(HOURLY_SQL, body="""SELECT series_id, count(*) AS n_slots, e AS expected, count(*) / e AS share, count(*) / e < 0.95 AS flagged FROM
         (SELECT series_id, date_diff('hour', min(ts) OVER (PARTITION BY series_id), max(ts) OVER (PARTITION BY series_id)) + 1 AS e FROM bars) GROUP BY 1, 3"""))
def b12(spark, sf):
    return B.coverage(hourly(spark, sf), "series_id", HOUR_US)


@query("b12_missing_slots", "series_id:s slot:t",
       with_sql(HOURLY_SQL, body="""SELECT series_id, slot FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS slot FROM bars GROUP BY 1)
         WHERE (series_id, slot) NOT IN (SELECT (series_id, ts) FROM bars)"""))
def b12m(spark, sf):
    return B.missing_slots(hourly(spark, sf), "series_id", HOUR_US)


@query("b13_project_completed", "series_id:s ts:t close:f d_close:f d_high:f",
       with_sql(HOURLY_SQL, """d AS (SELECT series_id, date_trunc('day', ts) + INTERVAL 1 DAY AS available_at, last(close ORDER BY ts) AS d_close, max(high) AS d_high FROM bars GROUP BY 1, 2)""",
       body="""SELECT b.series_id, b.ts, close, d_close, d_high FROM bars b ASOF LEFT JOIN d ON b.series_id = d.series_id AND b.ts >= d.available_at"""))
def b13(spark, sf):
    h = hourly(spark, sf)
    return B.project_completed(h, B.rebar(h, "series_id", DAY_US), "series_id", ["close", "high"], "d_")


@query("b14_prev_period_levels", "series_id:s ts:t prev_high:f prev_low:f prev_close:f",
       with_sql(HOURLY_SQL, """d AS (SELECT series_id, date_trunc('day', ts) AS day, max(high) AS h, min(low) AS l, last(close ORDER BY ts) AS c FROM bars GROUP BY 1, 2),
       p AS (SELECT series_id, day, lag(h) OVER w AS prev_high, lag(l) OVER w AS prev_low, lag(c) OVER w AS prev_close FROM d WINDOW w AS (PARTITION BY series_id ORDER BY day))""",
       body="SELECT b.series_id, b.ts, prev_high, prev_low, prev_close FROM bars b JOIN p ON b.series_id = p.series_id AND date_trunc('day', b.ts) = p.day"))
def b14(spark, sf):
    return B.prev_period_levels(hourly(spark, sf), "series_id")


@query("b15_session_range", "series_id:s ts:t session_high:f session_low:f session_mid:f",
       with_sql(HOURLY_SQL, """s AS (SELECT series_id, date_trunc('day', ts) + INTERVAL 7 HOUR AS available_at, max(high) AS session_high, min(low) AS session_low,
         (max(high) + min(low)) / 2 AS session_mid FROM bars WHERE hour(ts) < 7 GROUP BY 1, 2)""",
       body="SELECT b.series_id, b.ts, session_high, session_low, session_mid FROM bars b ASOF LEFT JOIN s ON b.series_id = s.series_id AND b.ts >= s.available_at"))
def b15(spark, sf):
    h = hourly(spark, sf)
    s = B.session_range(h, "series_id").drop("day")
    return asof(h.select("series_id", "ts"), s, "series_id", left_order=["ts"])


@query("b16_calendar_gaps", "series_id:s week:t prev_close:f week_open:f gap:f",
       with_sql(HOURLY_SQL, """w AS (SELECT series_id, CASE WHEN isodow(ts) = 7 THEN date_trunc('week', ts) + INTERVAL 7 DAY ELSE date_trunc('week', ts) END AS week,
          first(open ORDER BY ts) AS week_open, last(close ORDER BY ts) FILTER (WHERE isodow(ts) < 6) AS week_close
          FROM bars WHERE isodow(ts) <> 6 GROUP BY 1, 2), g AS (SELECT *, lag(week_close) OVER (PARTITION BY series_id ORDER BY week) AS prev_close FROM w)""",
       body="SELECT series_id, week, prev_close, week_open, week_open - prev_close AS gap FROM g WHERE prev_close IS NOT NULL"))
def b16(spark, sf):
    return B.calendar_gaps(hourly(spark, sf), "series_id")


@query("b17_local_events", "day:t instant:t is_month_end:b",
       """SELECT day, ((day + INTERVAL 16 HOUR) AT TIME ZONE 'Europe/London') AT TIME ZONE 'UTC' AS instant,
          day = CAST(CASE isodow(last_day(day)) WHEN 6 THEN last_day(day) - 1 WHEN 7 THEN last_day(day) - 2 ELSE last_day(day) END AS TIMESTAMP) AS is_month_end
          FROM (SELECT DISTINCT date_trunc('day', o_orderdate) AS day FROM orders)""")
def b17(spark, sf):
    days = read_table(spark, sf, "orders").select(F.date_trunc("day", "o_orderdate").alias("day")).distinct()
    return B.local_time_events(days, "Europe/London", 16, "day")


@query("b18_rebalance_dates", "period:t decide_at:t execute_at:t",
       """SELECT date_trunc('month', d) AS period, max(d) AS decide_at, arg_max(n, d) AS execute_at FROM
          (SELECT d, lead(d) OVER (ORDER BY d) AS n FROM (SELECT DISTINCT o_orderdate AS d FROM orders))
          GROUP BY 1 HAVING arg_max(n, d) IS NOT NULL""")
def b18(spark, sf):
    return B.rebalance_dates(read_table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts")))


@query("b19_clock_offset", "shift:i corr:f n:i",
       with_sql(HOURLY_SQL, """
       a AS (SELECT epoch(ts) // 3600 AS s, close - lag(close) OVER (ORDER BY ts) AS r FROM bars WHERE series_id = 'view'),
       b AS (SELECT epoch(ts) // 3600 AS s, close - lag(close) OVER (ORDER BY ts) AS r FROM bars WHERE series_id = 'click')""",
       body="""SELECT k AS shift, corr(a.r, b.r) AS corr, count(*) AS n FROM b CROSS JOIN range(-12, 13) t(k) JOIN a ON a.s = b.s + k
         WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1"""))
def b19(spark, sf):
    h = hourly(spark, sf)
    return B.best_offset(h.filter("series_id = 'view'"), h.filter("series_id = 'click'"), HOUR_US, range(-12, 13)).withColumnRenamed("offset", "shift")
