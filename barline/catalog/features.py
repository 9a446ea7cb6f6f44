"""The wide causal feature set, and its frame-based part with SQL."""

from __future__ import annotations

from barline.catalog.inputs import HOURLY_SQL, hourly_series, with_sql
from barline.catalog.registry import query
from barline.operators.features import causal_features

KEY = "series_id:s ts:t "
ALL = """asi:f asi_mc_d:f asi_mc_dd:f body_pips:f body_ratio:f candle_range:f gap_norm:f two_bar_momentum:f dlog_close_pos:f range_expansion:f is_engulfing:i is_inside_bar:i
 er_norm:f roc_10:f range_pos_30:f bb_width:f bb_pos:f aroon_osc:f stoch_k:f stoch_d:f donchian_pos:f williams_r:f cvd_delta:f cvd_cum:f cvd_divergence_30:f vol_ratio_20:f
 vol_capitulation:i dist_to_poc_100:f at_hvn_lvn:i hh_price:i hl_price:i hh_asi:i hl_asi:i squeeze:i tsf_slope:f tec5:f dtec:f ema8_ratio:f ema21_ratio:f rsi_14:f cci:f atr_ratio:f
 macd_hist:f adx:f dmi_diff:f trending:i high_vol:i vol_regime:f h1_slope:f hour_sin:f hour_cos:f dow_sin:f dow_cos:f psar_signal:i supertrend:i"""


@query("feat_causal_set", KEY + ALL)
def feat_all(spark, sf):
    return causal_features(hourly_series(spark, sf), median_rows=168)




@query("feat_causal_frames", KEY + "body_pips:f gap_norm:f two_bar_momentum:f range_expansion:f is_engulfing:i roc_10:f range_pos_30:f bb_width:f bb_pos:f stoch_k:f stoch_d:f williams_r:f cvd_cum:f cvd_divergence_30:f vol_ratio_20:f hh_price:i tec5:f ema8_ratio:f h1_slope:f",
       with_sql(HOURLY_SQL, """
       a AS (SELECT *, lag(close) OVER w AS pc, lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close, 2) OVER w AS p2, lag(close, 5) OVER w AS p5, lag(close, 10) OVER w AS p10,
         lag(close, 36) OVER w AS p36, abs(close - lag(close) OVER w) AS dc, CASE WHEN lag(close) OVER w IS NULL OR close > lag(close) OVER w THEN volume WHEN close < lag(close) OVER w THEN -volume ELSE 0 END AS sv FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
       b AS (SELECT *, sum(sv) OVER w AS cvd, max(high) OVER w14 AS h14, min(low) OVER w14 AS l14, max(high) OVER w30 AS h30, min(low) OVER w30 AS l30 FROM a
         WINDOW w AS (PARTITION BY series_id ORDER BY ts), w14 AS (PARTITION BY series_id ORDER BY ts ROWS 13 PRECEDING), w30 AS (PARTITION BY series_id ORDER BY ts ROWS 29 PRECEDING)),
       k AS (SELECT *, CASE WHEN rn >= 14 THEN CASE WHEN h14 - l14 > 1e-12 THEN (close - l14) / (h14 - l14) ELSE 0.5 END END AS k FROM b),
       e AS (SELECT t.series_id, t.rn, sum(pow(7/9.0, t.rn - i.rn) * CASE WHEN i.rn = 1 THEN 1 ELSE 2/9.0 END * i.close) AS e8 FROM bars t JOIN bars i ON t.series_id = i.series_id AND i.rn <= t.rn GROUP BY 1, 2)""",
       body="""SELECT series_id, ts, (close - open) / close * 1e4 AS body_pips, CASE WHEN pc IS NOT NULL THEN CASE WHEN ph - pl > 1e-12 THEN (open - pc) / (ph - pl) ELSE 0 END END AS gap_norm,
         CASE WHEN p2 IS NOT NULL THEN CASE WHEN ph - pl > 1e-12 THEN (close - p2) / (ph - pl) ELSE 0 END END AS two_bar_momentum, CASE WHEN rn >= 20 THEN CASE WHEN avg(high - low) OVER w20 > 1e-12 THEN (high - low) / avg(high - low) OVER w20 ELSE 1 END END AS range_expansion,
         CASE WHEN pc IS NOT NULL THEN CASE WHEN close > open AND pc < po AND close >= po AND open <= pc THEN 1 WHEN close < open AND pc > po AND close <= po AND open >= pc THEN -1 ELSE 0 END END AS is_engulfing,
         CASE WHEN p10 <> 0 THEN (close - p10) / p10 END AS roc_10, CASE WHEN rn >= 30 THEN CASE WHEN h30 - l30 > 1e-12 THEN (close - l30) / (h30 - l30) ELSE 0.5 END END AS range_pos_30,
         CASE WHEN rn >= 20 THEN 4 * stddev_pop(close) OVER w20 / close END AS bb_width, CASE WHEN rn >= 20 THEN (close - avg(close) OVER w20) / (2 * stddev_pop(close) OVER w20) END AS bb_pos,
         k AS stoch_k, CASE WHEN rn >= 16 THEN avg(k) OVER w3 END AS stoch_d, k - 1 AS williams_r, atan(cvd / 1e6) / (pi() / 2) AS cvd_cum,
         CASE WHEN rn >= 30 THEN (sign(close - first(close) OVER w30) - sign(cvd - first(cvd) OVER w30)) / 2.0 END AS cvd_divergence_30, CASE WHEN rn >= 20 THEN atan(volume / avg(volume) OVER w20 / 2) / (pi() / 2) END AS vol_ratio_20,
         CASE WHEN rn > 200 THEN (close >= max(high) OVER w200)::INT END AS hh_price, CASE WHEN p5 IS NOT NULL THEN (close - p5) / sum(dc) OVER w5 END AS tec5, close / e8 AS ema8_ratio,
         last_value(CASE WHEN rn % 12 = 0 AND rn >= 48 THEN atan((close - p36) / 3 / close * 1e4 / 20) / (pi() / 2) END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS h1_slope
         FROM k JOIN e USING (series_id, rn) WINDOW w20 AS (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING), w3 AS (PARTITION BY series_id ORDER BY ts ROWS 2 PRECEDING), w30 AS (PARTITION BY series_id ORDER BY ts ROWS 29 PRECEDING),
         w200 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY series_id ORDER BY ts ROWS 4 PRECEDING)"""))
def feat_frames(spark, sf):
    return causal_features(hourly_series(spark, sf), median_rows=168)
