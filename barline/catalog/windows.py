"""Window and recurrence kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.inputs import HOURLY_SQL, TICKS_SQL, hourly, hourly_series, ticks, with_sql
from barline.catalog.registry import query
from barline.functions.clock import HOUR_US, MINUTE_US
from barline.operators import kernel_ops as KO
from barline.operators import windows as W
from barline.operators.events import swing_table
from barline.operators.joins import panel
from barline.plans import orderstats as O
from barline.plans import scan as S
from barline.plans.series import Series


def C():
    return F.col("close")



def tick_series(spark, sf):
    return Series(ticks(spark, sf), "series_id", ["ts", "tie"])


def sqlw(body: str, n: int, extra: str = "") -> str:
    return with_sql(HOURLY_SQL, *([extra] if extra else []), body=body.replace("$W", f"(PARTITION BY series_id ORDER BY ts ROWS {n - 1} PRECEDING)"))


@query("w01_rolling", "series_id:i tie:i mean:f hi:f lo:f sd:f total:f",
       with_sql(TICKS_SQL, body="""SELECT series_id, tie, CASE WHEN n = 10 THEN mean END AS mean, CASE WHEN n = 10 THEN hi END AS hi, CASE WHEN n = 10 THEN lo END AS lo,
         CASE WHEN n = 10 THEN sd END AS sd, CASE WHEN n = 10 THEN total END AS total FROM (SELECT series_id, tie, count(*) OVER w AS n, avg(price) OVER w AS mean,
         max(price) OVER w AS hi, min(price) OVER w AS lo, stddev_samp(price) OVER w AS sd, sum(price) OVER w AS total
         FROM ticks WINDOW w AS (PARTITION BY series_id ORDER BY ts, tie ROWS 9 PRECEDING))"""))
def w01(spark, sf):
    x = F.col("price")
    return tick_series(spark, sf).columns(lambda fr: {
        "mean": W.roll(fr, x, 10, "mean"), "hi": W.roll(fr, x, 10, "max"), "lo": W.roll(fr, x, 10, "min"),
        "sd": W.roll(fr, x, 10, "std"), "total": W.roll(fr, x, 10, "sum")}, back_rows=10)


@query("w02_time_frame_ohlc", "series_id:s ts:t o_360:f h_360:f l_360:f c_360:f",
       with_sql(HOURLY_SQL, body="""SELECT series_id, ts, first(open) OVER w AS o_360, max(high) OVER w AS h_360, min(low) OVER w AS l_360, last(close) OVER w AS c_360 FROM bars
         WINDOW w AS (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 359 MINUTE PRECEDING AND CURRENT ROW)"""))
def w02(spark, sf):
    return hourly_series(spark, sf).columns(lambda fr: W.roll_time(fr, 360), back_us=360 * MINUTE_US)


@query("w03_lag_lead", "series_id:i tie:i prev:f nxt:f diff:f pct:f",
       with_sql(TICKS_SQL, body="""SELECT series_id, tie, lag(price, 2) OVER w AS prev, lead(price) OVER w AS nxt, price - lag(price) OVER w AS diff,
         CASE WHEN lag(price, 3) OVER w <> 0 THEN (price - lag(price, 3) OVER w) / lag(price, 3) OVER w END AS pct FROM ticks WINDOW w AS (PARTITION BY series_id ORDER BY ts, tie)"""))
def w03(spark, sf):
    x = F.col("price")
    return tick_series(spark, sf).columns(lambda fr: {
        "prev": W.lag(fr, x, 2), "nxt": W.lead(fr, x), "diff": W.diff(fr, x), "pct": W.pct_change(fr, x, 3)}, back_rows=3, fwd_rows=1)


@query("w04_cumulative", "series_id:i tie:i total:f peak:f trough:f n:i",
       with_sql(TICKS_SQL, body="""SELECT series_id, tie, sum(price) OVER w AS total, max(price) OVER w AS peak, min(price) OVER w AS trough, count(*) OVER w AS n
         FROM ticks WINDOW w AS (PARTITION BY series_id ORDER BY ts, tie ROWS UNBOUNDED PRECEDING)"""))
def w04(spark, sf):
    x = F.col("price")
    return tick_series(spark, sf).running({"total": ("sum", x), "peak": ("max", x), "trough": ("min", x), "n": ("count", F.lit(1))})


@query("w05_affine_scan", "series_id:i tie:i y:f",
       with_sql(TICKS_SQL, "x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, tie) AS rn FROM ticks)", """
       a AS (SELECT *, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 WHEN 'error' THEN 0.0 ELSE 0.9 END AS a FROM x)""",
       """r AS (SELECT series_id, rn, a * 1.5 + price AS y FROM a WHERE rn = 1 UNION ALL
         SELECT a.series_id, a.rn, a.a * r.y + a.price FROM r JOIN a ON a.series_id = r.series_id AND a.rn = r.rn + 1)""",
       body="SELECT r.series_id, x.tie, y FROM r JOIN x ON r.series_id = x.series_id AND r.rn = x.rn", recursive=True))
def w05(spark, sf):
    a = F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "view", 0.5).when(F.col("event_type") == "error", 0.0).otherwise(0.9)
    return S.affine_scan(tick_series(spark, sf), "y", a, F.col("price"), init=1.5)


@query("w05_ema_wilder_first", "series_id:s ts:t ema:f wild:f first:f",
       with_sql(HOURLY_SQL, """
       c AS (SELECT t.series_id, t.rn, t.ts,
         sum(CASE WHEN i.rn <= 10 THEN pow(9/11.0, t.rn - 10) * i.close / 10 ELSE pow(9/11.0, t.rn - i.rn) * 2 / 11.0 * i.close END) AS ema,
         sum(CASE WHEN i.rn <= 14 THEN pow(13/14.0, t.rn - 14) * i.close / 14 ELSE pow(13/14.0, t.rn - i.rn) / 14.0 * i.close END) AS wild,
         sum(CASE WHEN i.rn = 1 THEN pow(0.8, t.rn - 1) * i.close ELSE pow(0.8, t.rn - i.rn) * 0.2 * i.close END) AS first
         FROM bars t JOIN bars i ON t.series_id = i.series_id AND i.rn <= t.rn GROUP BY 1, 2, 3)""",
       body="SELECT series_id, ts, CASE WHEN rn >= 10 THEN ema END AS ema, CASE WHEN rn >= 14 THEN wild END AS wild, first FROM c"))
def w05e(spark, sf):
    def stage(d, fr):
        d = S.ema_seeded(d, fr, "ema", C(), 10)
        d = S.wilder(d, fr, "wild", C(), 14)
        return S.ema_first(d, fr, "first", C(), 0.2)
    return hourly_series(spark, sf).map(stage, back_rows=S.ema_rows(14, 1 / 14))


@query("w06_truncated_ema", "series_id:s ts:t y:f",
       with_sql(HOURLY_SQL, body="""SELECT t.series_id, t.ts, CASE WHEN t.rn >= 20 THEN sum(CASE WHEN i.rn = t.rn - 19 THEN pow(0.7, 19) * 0.3 * i.close ELSE pow(0.7, t.rn - i.rn) * 0.3 * i.close END) END AS y
         FROM bars t JOIN bars i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 19 AND t.rn GROUP BY 1, 2, t.rn"""))
def w06(spark, sf):
    return hourly_series(spark, sf).columns(lambda fr: {"y": W.ewm_fir(fr, C(), 0.3, 20)}, back_rows=20)


@query("w07_array_frames", "series_id:s ts:t wma:f mad:f since_hi:i",
       with_sql(HOURLY_SQL, body="""SELECT t.series_id, t.ts, CASE WHEN t.rn >= 10 THEN sum((i.rn - t.rn + 10) * i.close) / 55 END AS wma,
         CASE WHEN t.rn >= 10 THEN avg(abs(i.close - m)) END AS mad, CASE WHEN t.rn >= 10 THEN t.rn - arg_max(i.rn, (i.high, i.rn)) END AS since_hi
         FROM (SELECT *, avg(close) OVER (PARTITION BY series_id ORDER BY ts ROWS 9 PRECEDING) AS m FROM bars) t JOIN bars i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 9 AND t.rn GROUP BY 1, 2, t.rn"""))
def w07(spark, sf):
    def stage(d, fr):
        d = d.withColumn("pos", F.row_number().over(fr.w()))
        return d.withColumn("wma", W.wma(fr, C(), 10)).withColumn("mad", W.mean_abs_dev(fr, C(), 10)).withColumn("since_hi", W.bars_since(fr, "high", 10, "pos"))
    return hourly_series(spark, sf).map(stage, back_rows=12)


@query("w08_rolling_quantile", "series_id:s ts:t med:f p90:f",
       sqlw("SELECT series_id, ts, CASE WHEN count(*) OVER w = 15 THEN quantile_cont(close, 0.5) OVER w END AS med, CASE WHEN count(*) OVER w = 15 THEN quantile_cont(close, 0.9) OVER w END AS p90 FROM bars WINDOW w AS $W", 15))
def w08(spark, sf):
    stats = {"med": O.OrderStat("quantile", "close", 15), "p90": O.OrderStat("quantile", "close", 15, 0.9)}
    return hourly_series(spark, sf).map(lambda d, fr: O.order_statistics(d, fr, stats), back_rows=15)


@query("w08_tick_order_statistics", "series_id:s tie:i med:f p90:f pr:f z:f",
       with_sql(TICKS_SQL, """r AS (SELECT event_type AS series_id, tie, ts, price, row_number() OVER w AS rn, quantile_cont(price, 0.5) OVER w60 AS med, quantile_cont(price, 0.9) OVER w60 AS p90
         FROM ticks WINDOW w AS (PARTITION BY event_type ORDER BY ts, tie), w60 AS (PARTITION BY event_type ORDER BY ts, tie ROWS 59 PRECEDING))""",
         """f AS (SELECT t.series_id, t.tie, any_value(t.med) AS med, any_value(t.p90) AS p90, any_value(t.price) AS price, any_value(t.rn) AS rn,
         count(*) FILTER (WHERE i.price < t.price) AS below, count(*) FILTER (WHERE i.price = t.price) AS same, quantile_cont(abs(i.price - t.med), 0.5) AS mad
         FROM r t JOIN r i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 59 AND t.rn GROUP BY 1, 2)""",
         body="""SELECT series_id, tie, CASE WHEN rn >= 60 THEN med END AS med, CASE WHEN rn >= 60 THEN p90 END AS p90, CASE WHEN rn >= 60 THEN (below + (same + 1) / 2.0) / 60 END AS pr,
         CASE WHEN rn >= 60 AND mad > 0 THEN (price - med) / (1.4826 * mad) END AS z FROM f"""))
def w08t(spark, sf):
    stats = {"med": O.OrderStat("quantile", "price", 60), "p90": O.OrderStat("quantile", "price", 60, 0.9), "pr": O.OrderStat("rank", "price", 60)}
    s = Series(ticks(spark, sf, "event_type"), "series_id", ["ts", "tie"])
    return s.map(lambda d, fr: O.robust_zscores(O.order_statistics(d, fr, stats), fr, {"z": "price"}, 60), back_rows=60)


@query("w09_percent_rank", "series_id:s ts:t pr:f",
       with_sql(HOURLY_SQL, body="""SELECT t.series_id, t.ts, CASE WHEN t.rn >= 20 THEN (count(*) FILTER (WHERE i.close < t.close) + (count(*) FILTER (WHERE i.close = t.close) + 1) / 2.0) / 20 END AS pr
         FROM bars t JOIN bars i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 19 AND t.rn GROUP BY 1, 2, t.rn"""))
def w09(spark, sf):
    return hourly_series(spark, sf).map(lambda d, fr: O.order_statistics(d, fr, {"pr": O.OrderStat("rank", "close", 20)}), back_rows=20)


@query("w10_zscore", "series_id:s ts:t z0:f z1:f",
       sqlw("SELECT series_id, ts, CASE WHEN count(*) OVER w = 20 THEN (close - avg(close) OVER w) / stddev_pop(close) OVER w END AS z0, CASE WHEN count(*) OVER w = 20 THEN (close - avg(close) OVER w) / stddev_samp(close) OVER w END AS z1 FROM bars WINDOW w AS $W", 20))
def w10(spark, sf):
    return hourly_series(spark, sf).columns(lambda fr: {"z0": W.zscore(fr, C(), 20, 0), "z1": W.zscore(fr, C(), 20, 1)}, back_rows=20)


@query("w11_mad_zscore", "series_id:s ts:t z:f",
       with_sql(HOURLY_SQL, """m AS (SELECT series_id, ts, rn, close, quantile_cont(close, 0.5) OVER (PARTITION BY series_id ORDER BY ts ROWS 24 PRECEDING) AS med FROM bars)""",
       body="""SELECT t.series_id, t.ts, CASE WHEN t.rn >= 25 AND quantile_cont(abs(i.close - t.med), 0.5) > 0 THEN (t.close - t.med) / (1.4826 * quantile_cont(abs(i.close - t.med), 0.5)) END AS z
         FROM m t JOIN bars i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 24 AND t.rn GROUP BY 1, 2, t.rn, t.close, t.med"""))
def w11(spark, sf):
    return hourly_series(spark, sf).map(lambda d, fr: O.robust_zscores(d, fr, {"z": "close"}, 25), back_rows=25)


@query("w12_regression", "series_id:s ts:t slope:f forecast:f",
       sqlw("SELECT series_id, ts, CASE WHEN count(*) OVER w = 14 THEN regr_slope(close, rn) OVER w END AS slope, CASE WHEN count(*) OVER w = 14 THEN regr_intercept(close, rn) OVER w + regr_slope(close, rn) OVER w * rn END AS forecast FROM bars WINDOW w AS $W", 14))
def w12(spark, sf):
    def stage(d, fr):
        d = d.withColumn("pos", F.row_number().over(fr.w()))
        return d.withColumn("slope", W.slope(fr, C(), F.col("pos"), 14)).withColumn("forecast", W.forecast(fr, C(), F.col("pos"), 14))
    return hourly_series(spark, sf).map(stage, back_rows=14)


@query("w13_autocorrelation", "series_id:s ts:t ac:f",
       sqlw("SELECT series_id, ts, CASE WHEN count(p) OVER w = 30 THEN corr(r, p) OVER w END AS ac FROM r WINDOW w AS $W", 30,
            "r0 AS (SELECT series_id, ts, close - lag(close) OVER (PARTITION BY series_id ORDER BY ts) AS r FROM bars), r AS (SELECT *, lag(r) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM r0)"))
def w13(spark, sf):
    def stage(d, fr):
        d = d.withColumn("r", W.diff(fr, C()))
        d = d.withColumn("p", F.lag("r").over(fr.w()))
        return d.withColumn("ac", W.corr(fr, F.col("r"), F.col("p"), 30))
    return hourly_series(spark, sf).map(stage, back_rows=33)


@query("w14_cross_section_ranks", "series_id:s ts:t rk:i dense:i pct:f tile:i",
       with_sql(HOURLY_SQL, body="""SELECT series_id, ts, rank() OVER w AS rk, dense_rank() OVER w AS dense, percent_rank() OVER w AS pct, ntile(3) OVER v AS tile FROM bars
         WINDOW w AS (PARTITION BY ts ORDER BY close DESC), v AS (PARTITION BY ts ORDER BY close DESC, series_id)"""))
def w14(spark, sf):
    from barline.operators.xsection import xs_rank
    return xs_rank(hourly(spark, sf), "ts", "close", "series_id", tiles=3)


@query("w15_channel", "series_id:s ts:t chan_high:f chan_low:f",
       with_sql(HOURLY_SQL, body="""SELECT series_id, ts, CASE WHEN rn > 20 THEN max(high) OVER w END AS chan_high, CASE WHEN rn > 20 THEN min(low) OVER w END AS chan_low FROM bars
         WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""))
def w15(spark, sf):
    return hourly_series(spark, sf).columns(lambda fr: W.channel(fr, 20), back_rows=20)


@query("w16_forward_extremes", "series_id:s ts:t fwd_high:f fwd_low:f fwd_rows:i",
       with_sql(HOURLY_SQL, body="""SELECT t.series_id, t.ts, max(i.high) AS fwd_high, min(i.low) AS fwd_low, count(i.high) AS fwd_rows FROM bars t LEFT JOIN bars i
         ON t.series_id = i.series_id AND i.ts > t.ts AND i.ts <= t.ts + INTERVAL 6 HOUR GROUP BY 1, 2"""))
def w16(spark, sf):
    return hourly_series(spark, sf).columns(lambda fr: W.forward_extremes(fr, 6 * HOUR_US), fwd_us=6 * HOUR_US)


@query("w17_streak", "series_id:s ts:t run:i len:i",
       with_sql(HOURLY_SQL, """f AS (SELECT series_id, ts, rn, sign(close - open) AS s FROM bars), g AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY series_id ORDER BY ts) THEN 1 ELSE 0 END AS brk FROM f),
         h AS (SELECT *, sum(brk) OVER (PARTITION BY series_id ORDER BY ts) AS run FROM g)""",
       body="SELECT series_id, ts, run, row_number() OVER (PARTITION BY series_id, run ORDER BY ts) AS len FROM h"))
def w17(spark, sf):
    from barline.operators.events import streaks
    s = hourly_series(spark, sf)
    return streaks(s.with_df(s.df.withColumn("s", F.signum(F.col("close") - F.col("open")))), "s")


@query("w18_time_since_visit", "series_id:s ts:t bars_since_visit:i",
       with_sql(HOURLY_SQL, body="""SELECT t.series_id, t.ts, t.rn - max(i.rn) AS bars_since_visit FROM bars t LEFT JOIN bars i ON t.series_id = i.series_id AND i.rn < t.rn
         AND floor(i.low / 5) <= floor(t.close / 5) AND floor(i.high / 5) >= floor(t.close / 5) GROUP BY 1, 2, t.rn"""))
def w18(spark, sf):
    return KO.time_since_visit(hourly_series(spark, sf), 5.0)


SWING12_SQL = """
ex AS (SELECT * FROM (SELECT series_id, ts, rn, 1 AS is_high, high AS value, high > lag(high) OVER w AND high > lead(high) OVER w AS ok FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts)
   UNION ALL SELECT series_id, ts, rn, 0, low, low < lag(low) OVER w AND low < lead(low) OVER w FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE ok)"""


@query("w19_level_density", "series_id:s bin:i n:i weight:f inverse_age:f z:f",
       with_sql(HOURLY_SQL, SWING12_SQL, """now AS (SELECT series_id, max(ts) AS t FROM ex GROUP BY 1),
         b AS (SELECT ex.series_id, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n, sum(exp(-ln(2) * greatest(epoch(t) - epoch(ts), 60) / 86400 / 7)) AS weight,
           sum(86400 / greatest(epoch(t) - epoch(ts), 60)) AS inverse_age FROM ex JOIN now USING (series_id) GROUP BY 1, 2)""",
       body="SELECT *, CASE WHEN stddev_pop(weight) OVER w > 0 THEN (weight - avg(weight) OVER w) / stddev_pop(weight) OVER w END AS z FROM b WINDOW w AS (PARTITION BY series_id)"))
def w19(spark, sf):
    from barline.operators.indicators.special import local_extremes
    return KO.level_density(local_extremes(hourly_series(spark, sf)), "series_id", 10.0, 7.0)


@query("w19_density_at_price", "series_id:s ts:t density:f",
       with_sql(HOURLY_SQL, SWING12_SQL, "nx AS (SELECT series_id, ts, lead(ts) OVER (PARTITION BY series_id ORDER BY ts) AS known FROM bars), ev AS (SELECT ex.*, known FROM ex JOIN nx USING (series_id, ts))",
       body="""SELECT b.series_id, b.ts, coalesce(sum(exp(-ln(2) * (epoch(b.ts) - epoch(known)) / 86400 / 7)), 0) AS density FROM bars b LEFT JOIN ev
         ON b.series_id = ev.series_id AND floor(ev.value / 10) = floor(b.close / 10) AND known <= b.ts GROUP BY 1, 2"""))
def w19d(spark, sf):
    from barline.operators.indicators.special import local_extremes
    s = hourly_series(spark, sf)
    return KO.density_at(s.df.select("series_id", "ts", "close"), local_extremes(s), "series_id", 10.0, 7.0, "confirmed_at")


@query("w20_swing_candidates", "series_id:s ts:t is_high:i value:f",
       with_sql(HOURLY_SQL, SWING12_SQL, """g AS (SELECT *, CASE WHEN is_high IS DISTINCT FROM lag(is_high) OVER (PARTITION BY series_id ORDER BY ts, 1 - is_high) THEN 1 ELSE 0 END AS brk FROM ex),
         r AS (SELECT *, sum(brk) OVER (PARTITION BY series_id ORDER BY ts, 1 - is_high) AS run FROM g)""",
       body="""SELECT series_id, ts, is_high, value FROM r QUALIFY row_number() OVER (PARTITION BY series_id, run ORDER BY CASE WHEN is_high = 1 THEN -value ELSE value END, ts) = 1"""))
def w20(spark, sf):
    from barline.operators.indicators.special import alternating, local_extremes
    return alternating(local_extremes(hourly_series(spark, sf)), ["series_id"], ["ts"])


@query("w20_swings", "series_id:s ts:t is_high:i value:f confirmed_at:t settled_at:t")
def w20s(spark, sf):
    return swing_table(hourly_series(spark, sf))


@query("w21_swing_features", "series_id:s ts:t swing_high:f swing_low:f swing_state:i swing_pos:f hh:i hl:i")
def w21(spark, sf):
    from barline.operators.indicators.special import swing_features
    return swing_features(hourly_series(spark, sf))


@query("w22_zigzag", "series_id:s ts:t support:f resistance:f zz_dir:i")
def w22(spark, sf):
    from barline.operators.eventbars import zigzag_levels
    return zigzag_levels(hourly(spark, sf), "series_id", 80.0)


@query("w23_haar_bands", "series_id:s ts:t d1:f d2:f d3:f",
       with_sql(HOURLY_SQL, body="""SELECT series_id, ts, CASE WHEN rn >= 2 THEN (close - lag(close) OVER w) / sqrt(2) END AS d1,
         CASE WHEN rn >= 4 THEN (avg(close) OVER (w ROWS 1 PRECEDING) - avg(close) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING)) / sqrt(2) * sqrt(2) END AS d2,
         CASE WHEN rn >= 8 THEN (avg(close) OVER (w ROWS 3 PRECEDING) - avg(close) OVER (w ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING)) / sqrt(2) * 2 END AS d3
         FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts)"""))
def w23(spark, sf):
    return hourly_series(spark, sf).columns(lambda fr: {f"d{i}": W.haar(fr, C(), i) for i in (1, 2, 3)}, back_rows=8)


@query("w24_complexity", "series_id:s ts:t perm_entropy:f higuchi:f rescaled:f")
def w24(spark, sf):
    return KO.complexity(hourly_series(spark, sf), "close", 64, 16)


@query("w25_variance_ratio", "series_id:s ts:t vr:f",
       with_sql(HOURLY_SQL, "d AS (SELECT series_id, ts, close - lag(close) OVER w AS d1, close - lag(close, 4) OVER w AS d4 FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts))",
       body="SELECT series_id, ts, CASE WHEN count(d4) OVER w = 40 AND var_pop(d1) OVER w > 0 THEN var_pop(d4) OVER w / (4 * var_pop(d1) OVER w) END AS vr FROM d WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS 39 PRECEDING)"))
def w25(spark, sf):
    def stage(d, fr):
        d = d.withColumn("__close_d1", W.diff(fr, C())).withColumn("__close_d4", W.diff(fr, C(), 4))
        return d.withColumn("vr", W.variance_ratio(fr, "close", 4, 40)).drop("__close_d1", "__close_d4")
    return hourly_series(spark, sf).map(stage, back_rows=45)


# the filter with one ratio taken in at a time, which equals taking all of an instant together
@query("w26_kalman_strength", "ts:t click:f view:f error:f signup:f",
       with_sql(HOURLY_SQL, """
       wide AS (SELECT ts, max(close) FILTER (series_id = 'click') AS c, max(close) FILTER (series_id = 'view') AS v,
         max(close) FILTER (series_id = 'error') AS e, max(close) FILTER (series_id = 'signup') AS s FROM bars GROUP BY ts),
       g AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t, ln(c / v / lag(c / v) OVER o) AS cv, ln(e / s / lag(e / s) OVER o) AS es,
         ln(c / e / lag(c / e) OVER o) AS ce, ln(v / s / lag(v / s) OVER o) AS vs
         FROM wide WHERE c / v > 0 AND e / s > 0 AND c / e > 0 AND v / s > 0 WINDOW o AS (ORDER BY ts)),
       u AS (SELECT (t - 1) * 4 + m AS k, m, ts, [cv, es, ce, vs][m + 1] AS y, [1, 2, 1, 4][m + 1] AS i, [4, 3, 2, 3][m + 1] AS j
         FROM g, unnest([0, 1, 2, 3]) AS l(m) WHERE t >= 1)""", """
       r AS (SELECT -1::BIGINT AS k, [CASE WHEN n % 5 = 0 THEN 0.01 ELSE 0 END::DOUBLE FOR n IN range(16)] AS p, [0, 0, 0, 0]::DOUBLE[] AS x
         UNION ALL SELECT k, [p[n + 1] - d[n // 4 + 1] * d[n % 4 + 1] / z FOR n IN range(16)] AS p,
           [x[n] + d[n] / z * (y - x[i] + x[j]) - CASE WHEN m = 3 THEN (list_sum(x) + list_sum(d) / z * (y - x[i] + x[j])) / 4 ELSE 0 END FOR n IN range(1, 5)] AS x
         FROM (SELECT *, d[i] - d[j] + 1e-3 AS z FROM (SELECT *, [p[4 * n + i] - p[4 * n + j] FOR n IN range(4)] AS d
           FROM (SELECT u.*, x, CASE WHEN m = 0 THEN [p[n + 1] + CASE WHEN n % 5 = 0 THEN 1e-5 ELSE 0 END FOR n IN range(16)] ELSE p END AS p
             FROM r JOIN u ON u.k = r.k + 1) a) b) c)""",
       body="SELECT u.ts, x[1] AS click, x[2] AS error, x[3] AS signup, x[4] AS view FROM r JOIN u ON u.k = r.k WHERE m = 3", recursive=True))
def w26(spark, sf):
    wide = panel(hourly(spark, sf), "series_id", "ts", "close", ["click", "view", "error", "signup"], "p_")
    ratios = wide.select("ts", *[(F.col(f"p_{a}") / F.col(f"p_{b}")).alias(f"{a}_{b}") for a, b in PAIRS])
    return KO.kalman_strength(ratios.filter(" AND ".join(f"{a}_{b} > 0" for a, b in PAIRS)), "ts", {f"{a}_{b}": (a, b) for a, b in PAIRS})


PAIRS = [("click", "view"), ("error", "signup"), ("click", "error"), ("view", "signup")]
