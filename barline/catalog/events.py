"""Events and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.inputs import HOURLY_SQL, TICKS_SQL, hourly, hourly_series, ticks, with_sql
from barline.catalog.registry import query
from barline.functions.clock import HOUR_US
from barline.operators import events as E
from barline.operators import outcomes as O
from barline.operators import windows as W
from barline.operators.aggregates import quantile_bucket
from barline.operators.indicators import with_indicators
from barline.operators.indicators.frames import divergence_of
from barline.operators.indicators.special import local_extremes
from barline.plans.quantiles import group_quantiles
from barline.plans.series import Series

KEY = "series_id:s ts:t "

def C():
    return F.col("close")

WW = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"
PREV = """
pv AS (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
tr AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM pv)"""

# events used by the outcome queries: wide bars, traded in the bar's own direction
EV_SQL = """
ev AS (SELECT series_id, ts, available_at AS event_ts, close AS entry, CASE WHEN close >= open THEN 1 ELSE -1 END AS side FROM bars WHERE high - low > 150)"""


def wide_events(spark, sf):
    h = hourly(spark, sf)
    ev = h.filter(F.col("high") - F.col("low") > 150).select(
        "series_id", F.col("ts").alias("event_bar"), F.col("available_at").alias("event_ts"), C().alias("entry"),
        F.when(C() >= F.col("open"), 1).otherwise(-1).alias("side"))
    return ev, h


# a path row for SQL: bars strictly after the event stamp and within h hours
def path_sql(h: int) -> str:
    return f"p AS (SELECT e.*, b.ts AS bts, b.high, b.low, b.close, b.open FROM ev e JOIN bars b ON e.series_id = b.series_id AND b.ts > e.event_ts AND b.ts <= e.event_ts + INTERVAL {h} HOUR)"


@query("e01_big_bars", KEY + "tr:f is_big:i",
       with_sql(HOURLY_SQL, PREV, body="SELECT series_id, ts, tr, (tr >= avg(tr) OVER k + 1.5 * stddev_pop(tr) OVER k)::INT AS is_big FROM tr WINDOW k AS (PARTITION BY series_id)"))
def e01(spark, sf):
    return E.big_bars(hourly_series(spark, sf), 1.5)


@query("e01_big_bars_trailing", KEY + "is_big:i",
       with_sql(HOURLY_SQL, PREV, body="SELECT series_id, ts, CASE WHEN count(*) OVER w = 50 THEN (tr >= avg(tr) OVER w + 2 * stddev_pop(tr) OVER w)::INT ELSE 0 END AS is_big FROM tr WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"))
def e01t(spark, sf):
    return E.big_bars(hourly_series(spark, sf), 2.0, 50)


@query("e02_momentum_stack", KEY + "mom_3:f mom_6:f norm_3:f norm_6:f acc_3:f",
       with_sql(HOURLY_SQL, f"m AS (SELECT series_id, ts, (close - lag(close, 3) OVER w) / 3 AS m3, (close - lag(close, 6) OVER w) / 6 AS m6 FROM bars {WW})",
                body="""SELECT series_id, ts, m3 AS mom_3, m6 AS mom_6, CASE WHEN count(m3) OVER r = 30 THEN m3 / stddev_samp(m3) OVER r END AS norm_3, CASE WHEN count(m6) OVER r = 30 THEN m6 / stddev_samp(m6) OVER r END AS norm_6,
         m3 - lag(m3) OVER w AS acc_3 FROM m WINDOW w AS (PARTITION BY series_id ORDER BY ts), r AS (PARTITION BY series_id ORDER BY ts ROWS 29 PRECEDING)"""))
def e02(spark, sf):
    return E.momentum_stack(hourly_series(spark, sf), (3, 6), 30)


@query("e03_first_bar_spike", KEY + "spike:b",
       with_sql(HOURLY_SQL, f"f AS (SELECT *, coalesce(abs(close - lag(close) OVER w) > 60, false) AS f FROM bars {WW})", body=f"SELECT series_id, ts, f AND NOT coalesce(lag(f) OVER w, false) AS spike FROM f {WW}"))
def e03(spark, sf):
    def stage(d, fr):
        d = d.withColumn("__m", F.abs(W.diff(fr, C())) > 60)
        return E.edge(fr, F.col("__m"), "spike", d)
    return hourly_series(spark, sf).map(stage, back_rows=2)


@query("e04_min_gap", "series_id:i ts:t tie:i",
       with_sql(TICKS_SQL, "b AS (SELECT series_id, ts, tie, row_number() OVER (PARTITION BY series_id ORDER BY ts, tie) AS rn FROM ticks)",
                "r AS (SELECT series_id, rn, ts, tie, ts AS kept_at, true AS kept FROM b WHERE rn = 1 UNION ALL SELECT b.series_id, b.rn, b.ts, b.tie, "
                "CASE WHEN b.ts - kept_at >= INTERVAL 24 HOUR THEN b.ts ELSE kept_at END, b.ts - kept_at >= INTERVAL 24 HOUR FROM r JOIN b ON b.series_id = r.series_id AND b.rn = r.rn + 1)",
                body="SELECT series_id, ts, tie FROM r WHERE kept", recursive=True))
def e04(spark, sf):
    return E.thin(ticks(spark, sf), "series_id", ["ts", "tie"], 24 * HOUR_US)


@query("e04_simple_gap", "series_id:i ts:t tie:i",
       with_sql(TICKS_SQL, body="SELECT series_id, ts, tie FROM (SELECT *, lag(ts) OVER (PARTITION BY series_id ORDER BY ts, tie) AS p FROM ticks) WHERE p IS NULL OR ts - p >= INTERVAL 24 HOUR"))
def e04s(spark, sf):
    return E.thin_simple(Series(ticks(spark, sf), "series_id", ["ts", "tie"]), 24 * HOUR_US)


@query("e05_cross_reentry_breakout", KEY + "crossed:i reenter:i broke:i",
       with_sql(HOURLY_SQL, """m AS (SELECT *, CASE WHEN rn >= 5 THEN avg(close) OVER (w ROWS 4 PRECEDING) END AS f, CASE WHEN rn >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS s,
         CASE WHEN rn >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) + stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS up, CASE WHEN rn >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) - stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS dn,
         CASE WHEN rn > 10 THEN max(high) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS hh, CASE WHEN rn > 10 THEN min(low) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS ll FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts))""",
       body=f"""SELECT series_id, ts, CASE WHEN lag(f) OVER w <= lag(s) OVER w AND f > s THEN 1 WHEN lag(f) OVER w >= lag(s) OVER w AND f < s THEN -1 ELSE 0 END AS crossed,
         CASE WHEN lag(low) OVER w > lag(up) OVER w AND low <= up THEN -1 WHEN lag(high) OVER w < lag(dn) OVER w AND high >= dn THEN 1 ELSE 0 END AS reenter,
         CASE WHEN close > hh THEN 1 WHEN close < ll THEN -1 ELSE 0 END AS broke FROM m {WW}"""))
def e05(spark, sf):
    def stage(d, fr):
        sd = W.roll(fr, C(), 20, "std_pop")
        d = d.select("*", W.roll(fr, C(), 5, "mean").alias("f"), W.roll(fr, C(), 20, "mean").alias("s"))
        d = d.withColumn("up", F.col("s") + sd).withColumn("dn", F.col("s") - sd)
        return d.select("*", E.cross(fr, F.col("f"), F.col("s")).alias("crossed"), E.reentry(fr, "up", "dn").alias("reenter"), E.breakout(fr, 10).alias("broke"))
    return hourly_series(spark, sf).map(stage, back_rows=22)


@query("e06_lag_pattern", KEY + "armed:i",
       with_sql(HOURLY_SQL, f"d AS (SELECT series_id, ts, close - open AS x FROM bars)", body=f"SELECT series_id, ts, CASE WHEN x > 20 AND lag(x, 1) OVER w < 0 AND lag(x, 3) OVER w < 0 THEN 1 WHEN x < -20 AND lag(x, 1) OVER w > 0 AND lag(x, 3) OVER w > 0 THEN -1 ELSE 0 END AS armed FROM d {WW}"))
def e06(spark, sf):
    s = hourly_series(spark, sf)
    s = s.with_df(s.df.withColumn("x", C() - F.col("open")))
    return s.columns(lambda fr: {"armed": E.lag_pattern(fr, "x", (1, 3), 20.0)}, back_rows=3)


@query("e07_level_touches", KEY + "n_touch:i",
       with_sql(HOURLY_SQL, body="SELECT t.series_id, t.ts, count(i.rn) FILTER (WHERE abs(i.high - t.high) <= 5) AS n_touch FROM bars t LEFT JOIN bars i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 20 AND t.rn - 1 GROUP BY 1, 2"))
def e07(spark, sf):
    return hourly_series(spark, sf).columns(lambda fr: {"n_touch": E.touches(fr, F.col("high"), 20, 5.0)}, back_rows=20)


@query("e08_divergence", KEY + "div:i",
       with_sql(HOURLY_SQL, f"m AS (SELECT *, close - lag(close, 5) OVER w AS x FROM bars {WW})",
                body="""SELECT series_id, ts, CASE WHEN count(x) OVER a = 20 THEN CASE WHEN max(close) OVER l > max(close) OVER e AND max(x) OVER l < max(x) OVER e THEN -1 WHEN min(close) OVER l < min(close) OVER e AND min(x) OVER l > min(x) OVER e THEN 1 ELSE 0 END END AS div
         FROM m WINDOW a AS (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING), l AS (PARTITION BY series_id ORDER BY ts ROWS 9 PRECEDING), e AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING)"""))
def e08(spark, sf):
    def stage(d, fr):
        d = d.withColumn("x", W.diff(fr, C(), 5))
        return d.withColumn("div", divergence_of(fr, C(), "x", 20))
    return hourly_series(spark, sf).map(stage, back_rows=26)


@query("e09_forward_return", KEY + "fwd_5:f", with_sql(HOURLY_SQL, body=f"SELECT series_id, ts, lead(close, 5) OVER w - close - 0.5 AS fwd_5 FROM bars {WW}"))
def e09(spark, sf):
    return O.forward_return(hourly_series(spark, sf), 5, 0.5)


@query("e10_first_passage", "series_id:s event_bar:t label:i exit_pnl:f exit_ts:t mfe:f mae:f bars_held:i",
       with_sql(HOURLY_SQL, EV_SQL, path_sql(24), """
       c AS (SELECT *, CASE WHEN side > 0 THEN high - entry ELSE entry - low END AS best, CASE WHEN side > 0 THEN low - entry ELSE entry - high END AS worst FROM p),
       h AS (SELECT series_id, ts, arg_min(CASE WHEN worst <= -40 THEN -1 ELSE 1 END, bts) FILTER (WHERE worst <= -40 OR best >= 60) AS label, min(bts) FILTER (WHERE worst <= -40 OR best >= 60) AS hts,
         max(bts) AS lts, arg_max((close - entry) * side, bts) AS last FROM c GROUP BY 1, 2)""",
       body="""SELECT h.series_id, h.ts AS event_bar, coalesce(h.label, 0) AS label, CASE label WHEN 1 THEN 60 WHEN -1 THEN -40 ELSE last END AS exit_pnl, coalesce(hts, lts) AS exit_ts, max(best) AS mfe, min(worst) AS mae, count(*) AS bars_held
         FROM h JOIN c ON h.series_id = c.series_id AND h.ts = c.ts AND c.bts <= coalesce(hts, lts) GROUP BY ALL"""))
def e10(spark, sf):
    ev, h = wide_events(spark, sf)
    return O.first_passage(ev, h, "series_id", 60.0, 40.0, 24 * HOUR_US, ["event_bar"])


@query("e11_excursions", "series_id:s event_bar:t mfe_h6:f mae_h6:f mfe_h24:f mae_h24:f",
       with_sql(HOURLY_SQL, EV_SQL, path_sql(24), "c AS (SELECT *, CASE WHEN side > 0 THEN high - entry ELSE entry - low END AS best, CASE WHEN side > 0 THEN low - entry ELSE entry - high END AS worst FROM p)",
                body="""SELECT series_id, ts AS event_bar, max(best) FILTER (WHERE bts <= event_ts + INTERVAL 6 HOUR) AS mfe_h6, min(worst) FILTER (WHERE bts <= event_ts + INTERVAL 6 HOUR) AS mae_h6, max(best) AS mfe_h24, min(worst) AS mae_h24 FROM c GROUP BY 1, 2"""))
def e11(spark, sf):
    ev, h = wide_events(spark, sf)
    return O.excursions(ev, h, "series_id", {"h6": 6 * HOUR_US, "h24": 24 * HOUR_US}, ["event_bar"])


@query("e12_underwater", "series_id:s event_bar:t pnl:f area:f score:f",
       with_sql(HOURLY_SQL, EV_SQL, path_sql(12), body="""SELECT series_id, ts AS event_bar, arg_max((close - entry) * side, bts) AS pnl, sum(greatest(-(close - entry) * side, 0)) * 60 AS area,
         arg_max((close - entry) * side, bts) - 0.01 * sum(greatest(-(close - entry) * side, 0)) * 60 AS score FROM p GROUP BY 1, 2"""))
def e12(spark, sf):
    ev, h = wide_events(spark, sf)
    return O.underwater(ev, h, "series_id", 12 * HOUR_US, 0.01, 60.0, ["event_bar"])


@query("e13_next_window_targets", KEY + "up_units:f down_units:f",
       with_sql(HOURLY_SQL, "s AS (SELECT *, CASE WHEN rn >= 14 THEN avg(high - low) OVER (PARTITION BY series_id ORDER BY ts ROWS 13 PRECEDING) END AS sc FROM bars)",
                body="""SELECT t.series_id, t.ts, CASE WHEN count(i.ts) > 0 AND t.sc > 0 THEN (max(i.high) - t.close) / t.sc END AS up_units, CASE WHEN count(i.ts) > 0 AND t.sc > 0 THEN (t.close - min(i.low)) / t.sc END AS down_units
         FROM s t LEFT JOIN s i ON t.series_id = i.series_id AND i.ts > t.ts AND i.ts <= t.ts + INTERVAL 3 HOUR GROUP BY 1, 2, t.close, t.sc"""))
def e13(spark, sf):
    s = hourly_series(spark, sf)
    d = s.columns(lambda fr: {"sc": W.roll(fr, F.col("high") - F.col("low"), 14, "mean")}, back_rows=14)
    return O.next_window_targets(s.with_df(d), 3 * HOUR_US, "sc")


@query("e14_event_profile", "offset:i mean:f n:i",
       with_sql(HOURLY_SQL, EV_SQL, body="""SELECT date_diff('hour', e.ts, b.ts) AS "offset", avg(b.volume) AS mean, count(*) AS n FROM ev e JOIN bars b ON e.series_id = b.series_id AND b.ts BETWEEN e.ts - INTERVAL 5 HOUR AND e.ts + INTERVAL 5 HOUR GROUP BY 1"""))
def e14(spark, sf):
    ev, h = wide_events(spark, sf)
    return O.event_profile(ev.select("series_id", F.col("event_bar").alias("event_ts")), h, "series_id", "volume", 5, HOUR_US)


@query("e15_lift", "lag:i rate:f base_rate:f lift:f",
       with_sql(HOURLY_SQL, "f AS (SELECT series_id, ts, (high - low > 150)::INT AS s, (volume > 250)::INT AS t FROM bars)",
                body="""SELECT k AS lag, avg(tk) FILTER (WHERE s = 1) AS rate, avg(t) AS base_rate, avg(tk) FILTER (WHERE s = 1) / avg(t) AS lift FROM (SELECT *, unnest([1, 2, 3]) AS k, unnest([lead(t, 1) OVER w, lead(t, 2) OVER w, lead(t, 3) OVER w]) AS tk FROM f WINDOW w AS (PARTITION BY series_id ORDER BY ts)) GROUP BY 1"""))
def e15(spark, sf):
    return O.lift(hourly_series(spark, sf), F.col("high") - F.col("low") > 150, F.col("volume") > 250, (1, 2, 3))


@query("e16_propagation", "lag:i rate_with:f rate_without:f",
       with_sql(TICKS_SQL, HOURLY_SQL, """fi AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, bool_or(price > 180)::INT AS a FROM ticks GROUP BY 1, 2),
         j AS (SELECT b.series_id, b.ts, coalesce(a, 0) AS a, (volume > 250)::INT AS c FROM bars b LEFT JOIN fi USING (series_id, ts)),
         x AS (SELECT a, unnest([-1, 0, 1, 2]) AS lag, unnest([lag(c) OVER w, c, lead(c) OVER w, lead(c, 2) OVER w]) AS v FROM j WINDOW w AS (PARTITION BY series_id ORDER BY ts))""",
       body="SELECT lag, avg(v) FILTER (WHERE a = 1) AS rate_with, avg(v) FILTER (WHERE a = 0) AS rate_without FROM x GROUP BY 1"))
def e16(spark, sf):
    fine = ticks(spark, sf, "event_type").withColumn("shock", F.col("price") > 180)
    s = hourly_series(spark, sf)
    return O.propagation(fine, s.with_df(s.df.withColumn("busy", (F.col("volume") > 250).cast("int"))), "shock", "busy", HOUR_US, (-1, 0, 1, 2))


@query("e17_ceiling", "series_id:s ceiling:f",
       with_sql(HOURLY_SQL, f"d AS (SELECT series_id, rn, close - lag(close) OVER w AS d FROM bars {WW})", """
       r AS (SELECT series_id, 1::BIGINT AS rn, 0.0::DOUBLE AS f, -1e18::DOUBLE AS l, -1e18::DOUBLE AS s FROM (SELECT DISTINCT series_id FROM bars) UNION ALL
         SELECT r.series_id, d.rn, greatest(f, l, s), greatest(f - 5, l, s - 5) + d.d, greatest(f - 5, l - 5, s) - d.d FROM r JOIN d ON r.series_id = d.series_id AND d.rn = r.rn + 1)""",
       body="SELECT series_id, arg_max(greatest(f, l, s), rn) AS ceiling FROM r GROUP BY 1", recursive=True))
def e17(spark, sf):
    return O.ceiling(hourly_series(spark, sf), "close", 5.0)


@query("e18_lag_agreement", KEY + "agree:i",
       with_sql(HOURLY_SQL, "m AS (SELECT *, CASE WHEN rn >= 5 THEN avg(close) OVER (PARTITION BY series_id ORDER BY ts ROWS 4 PRECEDING) END AS m FROM bars)",
                body=f"SELECT series_id, ts, CASE sign(m - lag(m, 1) OVER w) + sign(m - lag(m, 2) OVER w) + sign(m - lag(m, 4) OVER w) WHEN 3 THEN 1 WHEN -3 THEN -1 WHEN NULL THEN NULL ELSE CASE WHEN lag(m, 4) OVER w IS NOT NULL THEN 0 END END AS agree FROM m {WW}"))
def e18(spark, sf):
    def stage(d, fr):
        d = d.withColumn("m", F.round(W.roll(fr, C(), 5, "mean"), 12))
        return d.withColumn("agree", E.lag_agreement(fr, "m", (1, 2, 4)))
    return hourly_series(spark, sf).map(stage, back_rows=10)


@query("e19_stack_alignment", KEY + "stack_signal:i",
       with_sql(HOURLY_SQL, """m AS (SELECT *, CASE WHEN rn >= 3 THEN avg(close) OVER (w ROWS 2 PRECEDING) END AS a, CASE WHEN rn >= 5 THEN avg(close) OVER (w ROWS 4 PRECEDING) END AS b, CASE WHEN rn >= 8 THEN avg(close) OVER (w ROWS 7 PRECEDING) END AS c FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
         x AS (SELECT series_id, ts, CASE WHEN close > a AND a > b AND b > c AND a > lag(a) OVER w AND b > lag(b) OVER w AND c > lag(c) OVER w AND close > lag(close) OVER w THEN 1
           WHEN close < a AND a < b AND b < c AND a < lag(a) OVER w AND b < lag(b) OVER w AND c < lag(c) OVER w AND close < lag(close) OVER w THEN -1 ELSE 0 END AS al FROM m WINDOW w AS (PARTITION BY series_id ORDER BY ts))""",
       body=f"SELECT series_id, ts, CASE WHEN al <> coalesce(lag(al) OVER w, 0) THEN al ELSE 0 END AS stack_signal FROM x {WW}"))
def e19(spark, sf):
    return E.stack_alignment(hourly_series(spark, sf), (3, 5, 8), 2)


@query("e20_alignment_score", KEY + "score:i",
       with_sql(HOURLY_SQL, *[f"{n} AS (SELECT series_id, date_trunc('{u}', ts) + INTERVAL 1 {u} AS at, sign(last(close ORDER BY ts) - first(open ORDER BY ts)) AS d FROM bars GROUP BY series_id, date_trunc('{u}', ts))" for n, u in (("wk", "week"), ("dy", "day"), ("hr", "hour"))],
                body="""SELECT b.series_id, b.ts, coalesce(wk.d, 0) + coalesce(dy.d, 0) + coalesce(hr.d, 0) AS score FROM bars b ASOF LEFT JOIN wk ON b.series_id = wk.series_id AND b.ts >= wk.at
         ASOF LEFT JOIN dy ON b.series_id = dy.series_id AND b.ts >= dy.at ASOF LEFT JOIN hr ON b.series_id = hr.series_id AND b.ts >= hr.at"""))
def e20(spark, sf):
    return E.alignment_score(hourly_series(spark, sf), {"wk": "week", "dy": "day", "hr": "hour"})


@query("e21_hysteresis", KEY + "raw_state:i held_state:i")
def e21(spark, sf):
    s = hourly_series(spark, sf)
    d = s.df.withColumn("raw_state", F.signum(C() - F.col("open")).cast("int"))
    return E.hysteresis(s.with_df(d), "raw_state", 2)


@query("e22_extreme_order", "series_id:i bar:t n:i peak_first:i",
       with_sql(TICKS_SQL, body="""SELECT series_id, date_trunc('day', ts) AS bar, count(*) AS n, CASE WHEN arg_max((ts, tie), (price, -epoch_us(ts))) < arg_min((ts, tie), (price, epoch_us(ts))) THEN 1
         WHEN arg_max((ts, tie), (price, -epoch_us(ts))) > arg_min((ts, tie), (price, epoch_us(ts))) THEN -1 ELSE 0 END AS peak_first FROM ticks GROUP BY 1, 2"""))
def e22(spark, sf):
    return E.extreme_order(ticks(spark, sf), "series_id", 24 * HOUR_US, "price", ["ts", "tie"])


@query("e23_velocity_shock", KEY + "velocity:f vz:f shock:i follow_up:f",
       with_sql(HOURLY_SQL, f"v AS (SELECT series_id, ts, rn, close - lag(close, 3) OVER w AS v, lead(close, 4) OVER w - close AS fu FROM bars {WW})",
                "q AS (SELECT *, count(v) OVER z AS n, quantile_cont(v, 0.5) OVER z AS med FROM v WINDOW z AS (PARTITION BY series_id ORDER BY ts ROWS 24 PRECEDING))",
                "y AS (SELECT t.series_id, t.ts, t.v, t.fu, CASE WHEN t.n = 25 AND quantile_cont(abs(i.v - t.med), 0.5) > 0 THEN (t.v - t.med) / (1.4826 * quantile_cont(abs(i.v - t.med), 0.5)) END AS vz FROM q t JOIN q i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 24 AND t.rn GROUP BY 1, 2, 3, 4, t.n, t.med)",
                body="SELECT series_id, ts, v AS velocity, vz, CASE WHEN abs(vz) > 2 THEN sign(vz) WHEN vz IS NOT NULL THEN 0 END AS shock, fu AS follow_up FROM y"))
def e23(spark, sf):
    return E.velocity_shock(hourly_series(spark, sf), 3, 25, 2.0, 4)


@query("e24_first_touch", KEY + "level:f earlier:i rel_volume:f first_touch:i",
       with_sql(HOURLY_SQL, """l AS (SELECT *, CASE WHEN rn > 15 THEN max(high) OVER w END AS level, CASE WHEN avg(volume) OVER w > 0 THEN volume / avg(volume) OVER w END AS rv, lag(high) OVER (PARTITION BY series_id ORDER BY ts) AS ph FROM bars
         WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)),
         e AS (SELECT t.series_id, t.rn, count(i.rn) FILTER (WHERE abs(i.high - t.level) <= 8) AS n FROM l t LEFT JOIN bars i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 15 AND t.rn - 1 GROUP BY 1, 2)""",
       body="SELECT series_id, ts, level, n AS earlier, rv AS rel_volume, coalesce((high >= level - 8 AND ph < level - 8 AND close < level AND n <= 2 AND rv <= 1.5)::INT, 0) AS first_touch FROM l JOIN e USING (series_id, rn)"))
def e24(spark, sf):
    return E.first_touch(hourly_series(spark, sf), 15, 8.0, 2, 1.5)


SWING_SQL = """
ex AS (SELECT * FROM (SELECT series_id, ts, lead(ts) OVER w AS known, high AS value, high > lag(high) OVER w AND high > lead(high) OVER w AS ok FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts)
   UNION ALL SELECT series_id, ts, lead(ts) OVER w, low, low < lag(low) OVER w AND low < lead(low) OVER w FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE ok)"""


@query("e25_level_strength", "series_id:s event_bar:t strength:f n_levels:i",
       with_sql(HOURLY_SQL, EV_SQL, SWING_SQL, body="""SELECT e.series_id, e.ts AS event_bar, coalesce(sum(exp(-(epoch(event_ts) - epoch(known)) / 864000)), 0) AS strength, count(known) AS n_levels
         FROM ev e LEFT JOIN ex ON e.series_id = ex.series_id AND abs(ex.value - e.entry) <= 10 AND known <= event_ts GROUP BY 1, 2"""))
def e25(spark, sf):
    ev, _ = wide_events(spark, sf)
    return O.level_strength(ev, local_extremes(hourly_series(spark, sf)), "series_id", 10.0, 864000e6, "confirmed_at", ["event_bar"])




def masks():
    return {"wide": F.col("high") - F.col("low") > 120, "busy": F.col("volume") > 200, "up": C() > F.col("open")}


MASK_SQL = "mk AS (SELECT series_id, ts, rn, high - low > 120 AS wide, volume > 200 AS busy, close > open AS up FROM bars)"


@query("e26_episodes", "series_id:s mask:s start:t end:t length:i",
       with_sql(HOURLY_SQL, MASK_SQL, "l AS (SELECT series_id, ts, rn, mask, o FROM mk UNPIVOT (o FOR mask IN (wide, busy, up)))",
                body="""SELECT series_id, mask, min(ts) AS start, max(ts) AS "end", count(*) AS length FROM (SELECT *, rn - row_number() OVER (PARTITION BY series_id, mask ORDER BY rn) AS g FROM l WHERE o) GROUP BY series_id, mask, g"""))
def e26(spark, sf):
    return E.episodes(hourly_series(spark, sf), masks())


@query("e26_joint_rarity", "combination:s n:i share:f",
       with_sql(HOURLY_SQL, MASK_SQL, body="SELECT concat_ws('+', CASE WHEN busy THEN 'busy' END, CASE WHEN up THEN 'up' END, CASE WHEN wide THEN 'wide' END) AS combination, count(*) AS n, count(*) / (SELECT count(*) FROM mk) AS share FROM mk GROUP BY 1"))
def e26j(spark, sf):
    return E.joint_rarity(hourly_series(spark, sf), masks())


@query("e27_prior_run", "series_id:s event_bar:t slope:f length:i efficiency:f tercile:i",
       with_sql(HOURLY_SQL, EV_SQL, """p AS (SELECT e.series_id, e.ts, e.event_ts, b.ts AS bts, b.close, abs(b.close - lag(b.close) OVER (PARTITION BY e.series_id, e.ts ORDER BY b.ts)) AS st FROM ev e JOIN bars b ON e.series_id = b.series_id AND b.ts >= e.event_ts - INTERVAL 12 HOUR AND b.ts < e.event_ts),
         r AS (SELECT series_id, ts AS event_bar, CASE WHEN count(*) > 1 THEN regr_slope(close, (epoch(bts) - epoch(event_ts)) / 3600) END AS slope, count(*) AS length, CASE WHEN sum(st) > 0 THEN abs(last(close ORDER BY bts) - first(close ORDER BY bts)) / sum(st) END AS efficiency FROM p GROUP BY 1, 2),
         q AS (SELECT series_id, quantile_cont(efficiency, 1/3.0) AS a, quantile_cont(efficiency, 2/3.0) AS b FROM r GROUP BY 1)""",
       body="SELECT r.*, (efficiency > a)::INT + (efficiency > b)::INT AS tercile FROM r JOIN q USING (series_id)"))
def e27(spark, sf):
    ev, h = wide_events(spark, sf)
    return quantile_bucket(O.prior_run(ev, h, "series_id", 12 * HOUR_US, ["event_bar"]), "series_id", "efficiency", 3, "tercile")


@query("e28_checkpoint_mfe", "series_id:s event_bar:t mfe_2h:f mfe_8h:f mfe_24h:f final:f",
       with_sql(HOURLY_SQL, EV_SQL, path_sql(24), "c AS (SELECT *, CASE WHEN side > 0 THEN high - entry ELSE entry - low END AS best FROM p)",
                body="""SELECT series_id, ts AS event_bar, max(best) FILTER (WHERE bts <= event_ts + INTERVAL 2 HOUR) AS mfe_2h, max(best) FILTER (WHERE bts <= event_ts + INTERVAL 8 HOUR) AS mfe_8h, max(best) AS mfe_24h, arg_max((close - entry) * side, bts) AS final FROM c GROUP BY 1, 2"""))
def e28(spark, sf):
    ev, h = wide_events(spark, sf)
    return O.checkpoint_mfe(ev, h, "series_id", (2, 8, 24), ["event_bar"])


@query("e29_coactivation", KEY + "n_active:i",
       with_sql(HOURLY_SQL, """h AS (SELECT series_id, ts, rn, CASE WHEN rn >= 2 THEN abs(close - lag(close) OVER w) / sqrt(2) END AS h1, CASE WHEN rn >= 4 THEN abs(avg(close) OVER (w ROWS 1 PRECEDING) - avg(close) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING)) END AS h2 FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
         m AS (SELECT *, count(h1) OVER z AS n1, count(h2) OVER z AS n2, quantile_cont(h1, 0.5) OVER z AS m1, quantile_cont(h2, 0.5) OVER z AS m2 FROM h WINDOW z AS (PARTITION BY series_id ORDER BY ts ROWS 29 PRECEDING))""",
       body="""SELECT t.series_id, t.ts, coalesce((t.n1 = 30 AND quantile_cont(abs(i.h1 - t.m1), 0.5) > 0 AND (t.h1 - t.m1) / (1.4826 * quantile_cont(abs(i.h1 - t.m1), 0.5)) > 1.5)::INT, 0)
         + coalesce((t.n2 = 30 AND quantile_cont(abs(i.h2 - t.m2), 0.5) > 0 AND (t.h2 - t.m2) / (1.4826 * quantile_cont(abs(i.h2 - t.m2), 0.5)) > 1.5)::INT, 0) AS n_active
         FROM m t JOIN m i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 29 AND t.rn GROUP BY 1, 2, t.n1, t.n2, t.h1, t.h2, t.m1, t.m2"""))
def e29(spark, sf):
    return O.coactivation(hourly_series(spark, sf), "close", (1, 2), 30, 1.5)


@query("e30_persistence", "series_id:s n:i mean_left:f p25:f p50:f ret_1:f ret_5:f",
       with_sql(HOURLY_SQL, f"""f AS (SELECT *, close > open AS o, lead(close) OVER w - close AS r1, lead(close, 5) OVER w - close AS r5 FROM bars {WW}),
         g AS (SELECT *, rn - row_number() OVER (PARTITION BY series_id ORDER BY rn) AS grp FROM f WHERE o), h AS (SELECT *, max(rn) OVER (PARTITION BY series_id, grp) - rn AS rem FROM g)""",
       body="SELECT series_id, count(*) AS n, avg(rem) AS mean_left, quantile_cont(rem, 0.25) AS p25, quantile_cont(rem, 0.5) AS p50, avg(r1) AS ret_1, avg(r5) AS ret_5 FROM h GROUP BY 1"))
def e30(spark, sf):
    rows = E.persistence_rows(hourly_series(spark, sf), C() > F.col("open"), F.lit(1.0))
    qs = group_quantiles(rows, "series_id", "remaining", {"p25": 0.25, "p50": 0.5}, "n")
    means = rows.groupBy("series_id").agg(F.avg("remaining").alias("mean_left"), F.avg("ret_1").alias("ret_1"), F.avg("ret_5").alias("ret_5"))
    return qs.join(means, "series_id")


@query("e00_spike_after_rsi", KEY + "spike:b")
def e00(spark, sf):
    """First bar on which the relative strength leaves its middle zone."""
    d = with_indicators(hourly_series(spark, sf), ["rsi"])
    s = Series(d, "series_id", ["ts"], 200_000)
    return s.map(lambda x, fr: E.edge(fr, (F.col("rsi") > 60) | (F.col("rsi") < 40), "spike", x), back_rows=1)
