"""Scalar and shape functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.inputs import HOURLY_SQL, TICKS_SQL, hourly, hourly_series, ticks, with_sql
from barline.catalog.registry import query
from barline.functions import scalar as S
from barline.functions import shape as SH
from barline.functions.clock import floor_ts, hour_of_week, to_local
from barline.functions.clock import HOUR_US
from barline.operators import windows as W
from barline.operators.asof import asof
from barline.plans.series import Series
from barline.sources.readers import read_table

KEY = "series_id:s ts:t "
LAGS = """
pv AS (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(open) OVER w AS po FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""


@query("f01_squash", "event_id:i th:f at:f lp:f sg:f sq:f cl:f",
       "SELECT event_id, tanh(x) AS th, atan(x) * 2 / pi() AS at, sign(x) * ln(1 + abs(x)) AS lp, sign(x) AS sg, sign(x) * sqrt(abs(x)) AS sq, greatest(-1, least(1, x)) AS cl FROM (SELECT event_id, (value - 50) / 25 AS x FROM events)")
def f01(spark, sf):
    x = (F.col("value") - 50) / 25
    return read_table(spark, sf, "events").select("event_id", S.squash(x, "tanh").alias("th"), S.squash(x, "atan").alias("at"), S.squash(x, "log1p").alias("lp"),
                                                  S.squash(x, "sign").alias("sg"), S.squash(x, "sqrt").alias("sq"), S.clip(x, -1.0, 1.0).alias("cl"))


@query("f02_normal_cdf", "event_id:i enc:f")
def f02(spark, sf):
    return read_table(spark, sf, "events").select("event_id", S.cdf_signed((F.col("value") - 50) / 50).alias("enc"))


@query("f03_safe_logs", KEY + "lg:f ld:f",
       with_sql(HOURLY_SQL, body="SELECT series_id, ts, CASE WHEN close - open > 0 THEN ln(close - open) END AS lg, CASE WHEN close > 0 AND open > 0 THEN ln(close / open) END AS ld FROM bars"))
def f03(spark, sf):
    return hourly(spark, sf).select("series_id", "ts", S.safe_log(F.col("close") - F.col("open")).alias("lg"), S.log_delta("close", "open").alias("ld"))


@query("f04_date_time", "o_orderkey:i week:t how:i iso_week:i month_end:t ny:t half_day:t",
       """SELECT o_orderkey, date_trunc('week', t) AS week, (isodow(t) - 1) * 24 + hour(t) AS how, weekofyear(t) AS iso_week, last_day(t)::TIMESTAMP AS month_end,
          (t AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny, time_bucket(INTERVAL 12 HOUR, t) AS half_day FROM (SELECT o_orderkey, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS t FROM orders)""")
def f04(spark, sf):
    t = F.timestamp_micros(F.unix_micros("o_orderdate") + F.pmod("o_orderkey", F.lit(24)) * HOUR_US)
    d = read_table(spark, sf, "orders").select("o_orderkey", t.alias("t"))
    return d.select("o_orderkey", F.date_trunc("week", "t").alias("week"), hour_of_week("t").alias("how"), F.weekofyear("t").alias("iso_week"),
                    F.last_day("t").alias("month_end"), to_local("t", "America/New_York").alias("ny"), floor_ts("t", 12 * HOUR_US).alias("half_day"))


@query("f05_strings", "p_partkey:i base:s quote:s stripped:s is_red:b",
       "SELECT p_partkey, split_part(p_name, ' ', 1) AS base, split_part(p_name, ' ', -1) AS quote, CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS stripped, p_name LIKE 'red%' AS is_red FROM part")
def f05(spark, sf):
    pair = S.split_pair("p_name", " ")
    return read_table(spark, sf, "part").select("p_partkey", pair["base"].alias("base"), pair["quote"].alias("quote"), S.strip_prefix("p_brand", "Brand#").alias("stripped"), F.col("p_name").like("red%").alias("is_red"))


@query("f06_json", "event_id:i k:i", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f06(spark, sf):
    return read_table(spark, sf, "events").select("event_id", S.parse_state("props", "k long").alias("s")).select("event_id", "s.k")


@query("f07_arrays", KEY + "pos:i value:f",
       with_sql(HOURLY_SQL, body="SELECT series_id, ts, pos, a[pos + 1] AS value FROM (SELECT series_id, ts, unnest(range(4)) AS pos, [open * 2, high * 2, low * 2, close * 2] AS a FROM bars)"))
def f07(spark, sf):
    arr = F.transform(F.array("open", "high", "low", "close"), lambda x: x * 2)
    return hourly(spark, sf).select("series_id", "ts", F.posexplode(arr).alias("pos", "value"))


@query("f08_weight_map", "event_id:i w:f", "SELECT event_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 WHEN 'purchase' THEN 2.0 END AS w FROM events")
def f08(spark, sf):
    return read_table(spark, sf, "events").select("event_id", S.weight_map({"click": 1.0, "view": 0.5, "purchase": 2.0})[F.col("event_type")].alias("w"))


@query("f09_bar_shape", KEY + "body:f abs_body:f upper_wick:f lower_wick:f bar_range:f body_share:f close_pos:f direction:f",
       with_sql(HOURLY_SQL, body="""SELECT series_id, ts, close - open AS body, abs(close - open) AS abs_body, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, high - low AS bar_range,
         CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END AS body_share, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS close_pos, sign(close - open) AS direction FROM bars"""))
def f09(spark, sf):
    return hourly(spark, sf).select("series_id", "ts", *[c.alias(n) for n, c in SH.bar_shape().items()])


@query("f10_two_bar_shape", KEY + "gap:f overlap_share:f is_engulfing:i is_inside:i two_bar_move:f range_growth:f reversal:f",
       with_sql(HOURLY_SQL, LAGS, body="""SELECT series_id, ts, open - pc AS gap, CASE WHEN pc IS NOT NULL AND greatest(high, ph) > least(low, pl) THEN greatest(least(high, ph) - greatest(low, pl), 0) / (greatest(high, ph) - least(low, pl)) END AS overlap_share,
         CASE WHEN pc IS NOT NULL THEN (greatest(open, close) >= greatest(po, pc) AND least(open, close) <= least(po, pc) AND sign(close - open) * sign(pc - po) < 0)::INT END AS is_engulfing,
         CASE WHEN pc IS NOT NULL THEN (high <= ph AND low >= pl)::INT END AS is_inside, close - po AS two_bar_move, CASE WHEN ph > pl THEN (high - low) / (ph - pl) END AS range_growth,
         CASE WHEN pc IS NOT NULL THEN CASE WHEN sign(close - open) * sign(pc - po) < 0 THEN abs(close - open) ELSE 0 END END AS reversal FROM pv"""))
def f10(spark, sf):
    d = hourly_series(spark, sf).columns(SH.two_bar_shape, back_rows=1)
    first = F.col("gap").isNull()
    return d.withColumn("is_engulfing", F.when(~first, F.col("is_engulfing"))).withColumn("is_inside", F.when(~first, F.col("is_inside")))


@query("f11_log_delta_shape", KEY + "dlog_close:f dlog_range:f dlog_high:f dlog_low:f",
       with_sql(HOURLY_SQL, LAGS, body="""SELECT series_id, ts, CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END AS dlog_close, CASE WHEN high > low AND ph > pl THEN ln(high - low) - ln(ph - pl) END AS dlog_range,
         CASE WHEN high > 0 AND ph > 0 THEN ln(high / ph) END AS dlog_high, CASE WHEN low > 0 AND pl > 0 THEN ln(low / pl) END AS dlog_low FROM pv"""))
def f11(spark, sf):
    return hourly_series(spark, sf).columns(SH.log_delta_shape, back_rows=1)


@query("f12_true_range", KEY + "tr:f body_ratio:f",
       with_sql(HOURLY_SQL, LAGS, body="SELECT series_id, ts, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN high > low THEN (close - open) / (high - low) ELSE 0 END AS body_ratio FROM pv"))
def f12(spark, sf):
    return hourly_series(spark, sf).columns(lambda fr: {"tr": SH.true_range(fr), "body_ratio": SH.body_ratio()}, back_rows=1)


@query("f13_range_metrics", KEY + "pm:f eff:f loc:f",
       with_sql(HOURLY_SQL, """w6 AS (SELECT series_id, ts, close, first(open) OVER w AS o, max(high) OVER w AS h, min(low) OVER w AS l FROM bars
         WINDOW w AS (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 359 MINUTE PRECEDING AND CURRENT ROW))""",
       body="""SELECT a.series_id, a.ts, (a.close - a.o) / 6 AS pm, CASE WHEN a.h > a.l THEN abs(a.close - a.o) / (a.h - a.l) ELSE 0 END AS eff,
         CASE WHEN b.h > b.l THEN (a.close - b.l) / (b.h - b.l) WHEN b.h IS NOT NULL THEN 0.5 END AS loc FROM w6 a ASOF LEFT JOIN w6 b ON a.series_id = b.series_id AND a.ts >= b.ts + INTERVAL 6 HOUR"""))
def f13(spark, sf):
    s = hourly_series(spark, sf)
    d = s.columns(lambda fr: W.roll_time(fr, 360), back_us=6 * HOUR_US)
    prior = d.select("series_id", F.timestamp_micros(F.unix_micros("ts") + 6 * HOUR_US).alias("available_at"), F.col("h_360").alias("bh"), F.col("l_360").alias("bl"))
    j = asof(d.select("series_id", "ts", "close", "o_360", "h_360", "l_360"), prior, "series_id")
    c, o, h, l = F.col("close"), F.col("o_360"), F.col("h_360"), F.col("l_360")
    return j.select("series_id", "ts", ((c - o) / 6).alias("pm"), F.when(h > l, F.abs(c - o) / (h - l)).otherwise(0.0).alias("eff"), S.position_in_range(c, F.col("bl"), F.col("bh")).alias("loc"))


@query("f14_pip_rates", "series_id:i tie:i pips_per_hour:f pips_per_tick:f z:f",
       with_sql(TICKS_SQL, """a AS (SELECT *, abs(price - lag(price) OVER w) AS step, epoch_us(ts) AS us FROM ticks WINDOW w AS (PARTITION BY series_id ORDER BY ts, tie)),
         b AS (SELECT series_id, ts, tie, count(step) OVER w AS n, sum(step) OVER w AS path, (us - first(us) OVER (PARTITION BY series_id ORDER BY ts, tie ROWS 10 PRECEDING)) / 3600000000.0 AS hours FROM a WINDOW w AS (PARTITION BY series_id ORDER BY ts, tie ROWS 9 PRECEDING)),
         c AS (SELECT *, CASE WHEN n = 10 AND hours > 0 THEN path / hours END AS r, CASE WHEN n = 10 THEN path / 10 END AS p FROM b)""",
       body="SELECT series_id, tie, r AS pips_per_hour, p AS pips_per_tick, CASE WHEN count(r) OVER w = 10 AND stddev_pop(r) OVER w > 0 THEN (r - avg(r) OVER w) / stddev_pop(r) OVER w END AS z FROM c WINDOW w AS (PARTITION BY series_id ORDER BY ts, tie ROWS 9 PRECEDING)"))
def f14(spark, sf):
    s = Series(ticks(spark, sf), "series_id", ["ts", "tie"])

    def stage(d, fr):
        d = d.withColumn("__st", F.abs(W.diff(fr, F.col("price")))).withColumn("__us", F.unix_micros("ts"))
        d = d.withColumn("__h", (F.col("__us") - F.first("__us").over(fr.rows(-10, 0))) / 3.6e9)
        path = W.roll(fr, F.col("__st"), 10, "sum")
        d = d.withColumn("pips_per_tick", path / 10).withColumn("pips_per_hour", F.when(F.col("__h") > 0, path / F.col("__h")))
        return d.withColumn("z", W.zscore(fr, F.col("pips_per_hour"), 10, 0))

    return s.map(stage, back_rows=22)
