"""Indicators of section 2.7 on hourly bars, with SQL twins where a set formula exists.

Recursive means are unrolled in SQL as weighted sums over all earlier bars of
the series, which is exact and only affordable on the small check tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.inputs import HOURLY_SQL, TICKS_SQL, hourly, hourly_series, ticks, with_sql
from barline.catalog.registry import query
from barline.operators import kernel_ops as KO
from barline.operators.indicators import levels as L
from barline.operators.indicators import special as SP
from barline.operators.indicators import with_indicators
from barline.plans.series import Series

KEY = "series_id:s ts:t "
# fixed values: window names used by the SQL below
WINDOWS = """WINDOW w AS (PARTITION BY series_id ORDER BY ts), w10 AS (PARTITION BY series_id ORDER BY ts ROWS 9 PRECEDING),
 w14 AS (PARTITION BY series_id ORDER BY ts ROWS 13 PRECEDING), w20 AS (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING),
 w21 AS (PARTITION BY series_id ORDER BY ts ROWS 20 PRECEDING), w200 AS (PARTITION BY series_id ORDER BY ts ROWS 199 PRECEDING),
 w240 AS (PARTITION BY series_id ORDER BY ts ROWS 239 PRECEDING), w9 AS (PARTITION BY series_id ORDER BY ts ROWS 8 PRECEDING),
 w26 AS (PARTITION BY series_id ORDER BY ts ROWS 25 PRECEDING), w52 AS (PARTITION BY series_id ORDER BY ts ROWS 51 PRECEDING),
 w3 AS (PARTITION BY series_id ORDER BY ts ROWS 2 PRECEDING), w50 AS (PARTITION BY series_id ORDER BY ts ROWS 49 PRECEDING)"""


def ind(name: str, cols: str, sql: str | None, *ctes: str, src: str = "bars", params: dict | None = None, q: str | None = None):
    """Register one indicator; ``sql`` is the select list over ``src`` with the named windows."""
    text = None
    if sql is not None:
        body = f"SELECT series_id, ts, {sql} FROM {src} {WINDOWS}"
        text = with_sql(HOURLY_SQL, *ctes, body=body)

    @query(q or f"ind_{name}", KEY + cols, text)
    def run(spark, sf):
        return with_indicators(hourly_series(spark, sf), [(name, params) if params else name])

    return run


def ema_sql(out: str, src: str, col: str, n: int, alpha: str | None = None) -> str:
    """CTE ``out`` (series_id, rn, v): mean-seeded exponential mean of the non-null values."""
    k = alpha or f"(2.0 / {n + 1})"
    return f"""
{out}_s AS (SELECT series_id, rn, {col} AS x, row_number() OVER (PARTITION BY series_id ORDER BY rn) AS c FROM {src} WHERE {col} IS NOT NULL),
{out} AS (SELECT t.series_id, t.rn, sum(CASE WHEN i.c <= {n} THEN pow(1 - {k}, t.c - {n}) * i.x / {n} ELSE pow(1 - {k}, t.c - i.c) * {k} * i.x END) AS v
  FROM {out}_s t JOIN {out}_s i ON t.series_id = i.series_id AND i.c <= t.c WHERE t.c >= {n} GROUP BY 1, 2)"""


def wilder_sql(out: str, src: str, col: str, n: int) -> str:
    return ema_sql(out, src, col, n, f"(1.0 / {n})")


def first_ema_sql(out: str, src: str, col: str, k: str) -> str:
    return f"""
{out}_s AS (SELECT series_id, rn, {col} AS x, row_number() OVER (PARTITION BY series_id ORDER BY rn) AS c FROM {src} WHERE {col} IS NOT NULL),
{out} AS (SELECT t.series_id, t.rn, sum(pow(1 - {k}, t.c - i.c) * CASE WHEN i.c = 1 THEN 1 ELSE {k} END * i.x) AS v
  FROM {out}_s t JOIN {out}_s i ON t.series_id = i.series_id AND i.c <= t.c GROUP BY 1, 2)"""


def joined(out: str, base: str = "bars", **parts: str) -> str:
    """CTE joining scan results (v) to bars under given names."""
    cols = ", ".join(f"{cte}.v AS {name}" for name, cte in parts.items())
    joins = " ".join(f"LEFT JOIN {cte} ON {cte}.series_id = b.series_id AND {cte}.rn = b.rn" for cte in parts.values())
    return f"\n{out} AS (SELECT b.*, {cols} FROM {base} b {joins})"


PREV = """
pv AS (SELECT *, lag(close) OVER z AS pc, lag(high) OVER z AS ph, lag(low) OVER z AS pl, lag(open) OVER z AS po FROM bars WINDOW z AS (PARTITION BY series_id ORDER BY ts)),
tr AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  (high + low + close) / 3 AS tp, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS g, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS lo FROM pv)"""


def n_ok(w: str, n: int, expr: str) -> str:
    return f"CASE WHEN count(*) OVER {w} = {n} THEN {expr} END"


# ----- frame indicators ------------------------------------------------------------

ind("sma", "sma:f", n_ok("w20", 20, "avg(close) OVER w20") + " AS sma")
ind("std_dev", "std_dev:f", n_ok("w20", 20, "stddev_pop(close) OVER w20") + " AS std_dev")
ind("bollinger", "bb_mid:f bb_upper:f bb_lower:f",
    f"{n_ok('w20', 20, 'avg(close) OVER w20')} AS bb_mid, {n_ok('w20', 20, 'avg(close) OVER w20 + 2 * stddev_pop(close) OVER w20')} AS bb_upper, {n_ok('w20', 20, 'avg(close) OVER w20 - 2 * stddev_pop(close) OVER w20')} AS bb_lower")
ind("zscore", "zscore:f", n_ok("w20", 20, "CASE WHEN stddev_pop(close) OVER w20 > 0 THEN (close - avg(close) OVER w20) / stddev_pop(close) OVER w20 ELSE 0 END") + " AS zscore")
ind("kaufman_er", "kaufman_er:f", "CASE WHEN lag(close, 20) OVER w IS NOT NULL THEN abs(close - lag(close, 20) OVER w) / sum(dc) OVER w20 END AS kaufman_er",
    "d AS (SELECT *, abs(close - lag(close) OVER (PARTITION BY series_id ORDER BY ts)) AS dc FROM bars)", src="d")
ind("linreg_slope", "linreg_slope:f linreg_regime:i", f"{n_ok('w20', 20, 'regr_slope(close, rn) OVER w20')} AS linreg_slope, {n_ok('w20', 20, 'sign(regr_slope(close, rn) OVER w20)')} AS linreg_regime")
ind("stochastic", "stoch_k:f stoch_d:f", "k AS stoch_k, CASE WHEN count(k) OVER w3 = 3 THEN avg(k) OVER w3 END AS stoch_d",
    "k AS (SELECT *, CASE WHEN count(*) OVER z = 14 THEN CASE WHEN max(high) OVER z > min(low) OVER z THEN 100 * (close - min(low) OVER z) / (max(high) OVER z - min(low) OVER z) ELSE 50 END END AS k FROM bars WINDOW z AS (PARTITION BY series_id ORDER BY ts ROWS 13 PRECEDING))", src="k")
CCI_SQL = """
m AS (SELECT *, (high + low + close) / 3 AS tp, avg((high + low + close) / 3) OVER (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING) AS mtp FROM bars),
c0 AS (SELECT t.series_id, t.rn, avg(abs(i.tp - t.mtp)) AS md FROM m t JOIN m i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 19 AND t.rn GROUP BY 1, 2),
cci AS (SELECT m.*, CASE WHEN m.rn >= 20 THEN CASE WHEN md > 0 THEN (tp - mtp) / (0.015 * md) ELSE 0 END END AS cci FROM m JOIN c0 USING (series_id, rn))"""
ind("cci", "cci:f", "cci", CCI_SQL, src="cci")
ind("aroon", "aroon_up:f aroon_down:f aroon_osc:f", "u AS aroon_up, d AS aroon_down, u - d AS aroon_osc",
    """ar AS (SELECT t.series_id, t.ts, CASE WHEN t.rn > 25 THEN 100.0 * (25 - (t.rn - arg_max(i.rn, (i.high, i.rn)))) / 25 END AS u,
       CASE WHEN t.rn > 25 THEN 100.0 * (25 - (t.rn - arg_min(i.rn, (i.low, -i.rn)))) / 25 END AS d FROM bars t JOIN bars i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 25 AND t.rn GROUP BY 1, 2, t.rn)""", src="ar")
ind("donchian", "dc_high:f dc_low:f dc_mid:f", f"{n_ok('w20', 20, 'max(high) OVER w20')} AS dc_high, {n_ok('w20', 20, 'min(low) OVER w20')} AS dc_low, {n_ok('w20', 20, '(max(high) OVER w20 + min(low) OVER w20) / 2')} AS dc_mid")
MID = "(max(high) OVER {0} + min(low) OVER {0}) / 2"
ind("ichimoku", "tenkan:f kijun:f senkou_a:f senkou_b:f",
    f"{n_ok('w9', 9, MID.format('w9'))} AS tenkan, {n_ok('w26', 26, MID.format('w26'))} AS kijun, {n_ok('w26', 26, '(' + MID.format('w9') + ' + ' + MID.format('w26') + ') / 2')} AS senkou_a, {n_ok('w52', 52, MID.format('w52'))} AS senkou_b")
ind("williams_r", "williams_r:f", n_ok("w14", 14, "CASE WHEN max(high) OVER w14 > min(low) OVER w14 THEN -100 * (max(high) OVER w14 - close) / (max(high) OVER w14 - min(low) OVER w14) ELSE 0 END") + " AS williams_r")
ind("mfi", "mfi:f", "CASE WHEN count(ptp) OVER w14 = 14 THEN CASE WHEN sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) OVER w14 = 0 THEN 100 ELSE 100 - 100 / (1 + sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) OVER w14 / sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) OVER w14) END END AS mfi",
    PREV, "f AS (SELECT *, lag(tp) OVER (PARTITION BY series_id ORDER BY ts) AS ptp FROM tr)", src="f")
ind("roc", "roc:f", "CASE WHEN lag(close, 10) OVER w <> 0 THEN 100 * (close - lag(close, 10) OVER w) / lag(close, 10) OVER w END AS roc")
ind("momentum", "momentum:f", "close - lag(close, 10) OVER w AS momentum")
ind("dto", "dto:f", n_ok("w20", 20, "(close - avg(close) OVER w20) / avg(close) OVER w20 * 100") + " AS dto")
ind("vortex", "vi_plus:f vi_minus:f", "CASE WHEN count(pc) OVER w14 = 14 THEN sum(abs(high - pl)) OVER w14 / sum(CASE WHEN pc IS NOT NULL THEN tr END) OVER w14 END AS vi_plus, CASE WHEN count(pc) OVER w14 = 14 THEN sum(abs(low - ph)) OVER w14 / sum(CASE WHEN pc IS NOT NULL THEN tr END) OVER w14 END AS vi_minus", PREV, src="tr")
ind("bb_width", "bb_width:f", n_ok("w20", 20, "4 * stddev_pop(close) OVER w20 / avg(close) OVER w20") + " AS bb_width")
ind("retracement", "retracement:f", "r AS retracement",
    """e AS (SELECT t.series_id, t.ts, t.rn, t.close, max(i.high) AS hh, min(i.low) AS ll, arg_max(i.rn, (i.high, i.rn)) AS p, arg_min(i.rn, (i.low, -i.rn)) AS q
       FROM bars t JOIN bars i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 9 AND t.rn GROUP BY 1, 2, 3, 4),
       rr AS (SELECT series_id, ts, CASE WHEN rn >= 10 THEN CASE WHEN hh > ll THEN greatest(0, least(1, CASE WHEN p >= q THEN (hh - close) / (hh - ll) ELSE (close - ll) / (hh - ll) END)) ELSE 0 END END AS r FROM e)""", src="rr")
CHAN = """
ch AS (SELECT *, CASE WHEN rn > 20 THEN max(high) OVER z END AS hh, CASE WHEN rn > 20 THEN min(low) OVER z END AS ll FROM bars WINDOW z AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
ind("breakout_channel", "breakout_channel:f", "CASE WHEN hh IS NULL THEN NULL WHEN close > hh THEN 1 WHEN close < ll THEN -1 WHEN hh = ll THEN 0 ELSE (close - ll) / (hh - ll) * 2 - 1 END AS breakout_channel", CHAN, src="ch")
ind("range_position", "range_position:f", n_ok("w240", 240, "tanh((close - min(low) OVER w240) / (max(high) OVER w240 - min(low) OVER w240) * 20 - 10)") + " AS range_position")
ind("bb_position", "bb_position:f", n_ok("w20", 20, "greatest(-1, least(1, (close - avg(close) OVER w20) / (4 * stddev_pop(close) OVER w20)))") + " AS bb_position")
ind("mom_strength", "mom_strength:f", "CASE WHEN count(up) OVER w10 = 10 THEN (sum(up) OVER w10 / 10.0 - 0.5) * 2 * abs(close - lag(close, 10) OVER w) END AS mom_strength",
    "u AS (SELECT *, CASE WHEN close - lag(close, 5) OVER z > 0 THEN 1 WHEN lag(close, 5) OVER z IS NOT NULL THEN 0 END AS up FROM bars WINDOW z AS (PARTITION BY series_id ORDER BY ts))", src="u")
SI_SQL = PREV + """,
si0 AS (SELECT *, greatest(abs(high - pc) - 0.5 * abs(low - pc) + 0.25 * abs(pc - po), abs(low - pc) - 0.5 * abs(high - pc) + 0.25 * abs(pc - po), high - low + 0.25 * abs(pc - po)) AS r FROM tr),
si AS (SELECT *, CASE WHEN pc IS NOT NULL THEN CASE WHEN tr = 0 OR r = 0 THEN 0 ELSE 50 * ((close - pc) + 0.5 * (close - open) + 0.25 * (pc - po)) / r * greatest(abs(high - pc), abs(low - pc)) / tr END END AS si FROM si0)"""
ind("asi_velocity", "asi_velocity:f", "si AS asi_velocity", SI_SQL, src="si")
ind("asi_acceleration", "asi_acceleration:f", "si - lag(si) OVER w AS asi_acceleration", SI_SQL, src="si")
MF = "CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume"
ind("chaikin_money_flow", "cmf:f", n_ok("w21", 21, f"sum({MF}) OVER w21 / sum(volume) OVER w21") + " AS cmf")
ind("coppock", "coppock:f", "cop AS coppock",
    """r AS (SELECT *, 100 * ((close - lag(close, 14) OVER z) / lag(close, 14) OVER z + (close - lag(close, 11) OVER z) / lag(close, 11) OVER z) AS r FROM bars WINDOW z AS (PARTITION BY series_id ORDER BY ts)),
       cp AS (SELECT t.series_id, t.ts, CASE WHEN count(i.r) = 10 THEN sum((i.rn - t.rn + 10) * i.r) / 55 END AS cop FROM r t JOIN r i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 9 AND t.rn GROUP BY 1, 2)""", src="cp")
ind("dpo", "dpo:f", "CASE WHEN rn >= 31 THEN lag(close, 11) OVER w - avg(close) OVER w20 END AS dpo")
ind("dynamic_zone_stochastic", "dz_stoch:f dz_stoch_upper:f dz_stoch_lower:f",
    "k AS dz_stoch, CASE WHEN count(k) OVER w20 = 20 THEN avg(k) OVER w20 + 0.8 * stddev_pop(k) OVER w20 END AS dz_stoch_upper, CASE WHEN count(k) OVER w20 = 20 THEN avg(k) OVER w20 - 0.8 * stddev_pop(k) OVER w20 END AS dz_stoch_lower",
    """k0 AS (SELECT *, CASE WHEN count(*) OVER z = 14 THEN CASE WHEN max(high) OVER z > min(low) OVER z THEN 100 * (close - min(low) OVER z) / (max(high) OVER z - min(low) OVER z) ELSE 50 END END AS raw FROM bars WINDOW z AS (PARTITION BY series_id ORDER BY ts ROWS 13 PRECEDING)),
       k1 AS (SELECT *, CASE WHEN raw IS NOT NULL THEN avg(raw) OVER (PARTITION BY series_id ORDER BY ts ROWS 2 PRECEDING) END AS k FROM k0)""", src="k1")
ind("envelopes", "env_mid:f env_upper:f env_lower:f", f"{n_ok('w20', 20, 'avg(close) OVER w20')} AS env_mid, {n_ok('w20', 20, 'avg(close) OVER w20 * 1.025')} AS env_upper, {n_ok('w20', 20, 'avg(close) OVER w20 * 0.975')} AS env_lower")
ind("vroc", "vroc:f", "CASE WHEN lag(volume, 14) OVER w <> 0 THEN 100 * (volume - lag(volume, 14) OVER w) / lag(volume, 14) OVER w END AS vroc")
ind("vwma", "vwma:f", n_ok("w20", 20, "sum(close * volume) OVER w20 / sum(volume) OVER w20") + " AS vwma")
ind("highs_and_lows", "highest:f lowest:f hl_range:f", f"{n_ok('w20', 20, 'max(high) OVER w20')} AS highest, {n_ok('w20', 20, 'min(low) OVER w20')} AS lowest, {n_ok('w20', 20, 'max(high) OVER w20 - min(low) OVER w20')} AS hl_range")
ind("wma", "wma:f", "m AS wma", "wm AS (SELECT t.series_id, t.ts, CASE WHEN count(*) = 20 THEN sum((i.rn - t.rn + 20) * i.close) / 210 END AS m FROM bars t JOIN bars i ON t.series_id = i.series_id AND i.rn BETWEEN t.rn - 19 AND t.rn GROUP BY 1, 2)", src="wm")
EARLY, LATE = "(w ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING)", "(w ROWS 9 PRECEDING)"


def div_sql(x: str, out: str) -> str:
    return f"""CASE WHEN count({x}) OVER w20 = 20 THEN CASE WHEN max(close) OVER {LATE} > max(close) OVER {EARLY} AND max({x}) OVER {LATE} < max({x}) OVER {EARLY} THEN -1
      WHEN min(close) OVER {LATE} < min(close) OVER {EARLY} AND min({x}) OVER {LATE} > min({x}) OVER {EARLY} THEN 1 ELSE 0 END END AS {out}"""


ind("cci_divergence", "cci_divergence:i", div_sql("cci", "cci_divergence"), CCI_SQL, src="cci")
ind("hour_of_day", "hod_sin:f hod_cos:f hod_session:i", "sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24) AS hod_sin, cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24) AS hod_cos, CASE WHEN hour(ts) < 8 THEN 0 WHEN hour(ts) < 16 THEN 1 ELSE 2 END AS hod_session")
ind("day_of_week", "dw_sin:f dw_cos:f", "sin(2 * pi() * (isodow(ts) - 1) / 5) AS dw_sin, cos(2 * pi() * (isodow(ts) - 1) / 5) AS dw_cos")

# ----- scan indicators ----------------------------------------------------------------

ATR = [PREV, wilder_sql("atr", "tr", "tr", 14)]
ind("atr", "atr:f", "atr", *ATR, joined("j", atr="atr"), src="j")
ind("ema", "ema:f", "ema", ema_sql("e", "bars", "close", 20), joined("j", ema="e"), src="j")
ADX = [PREV, """dm AS (SELECT *, CASE WHEN pc IS NOT NULL THEN tr END AS t, CASE WHEN ph IS NOT NULL THEN CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END END AS p,
  CASE WHEN ph IS NOT NULL THEN CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END END AS m FROM tr)""",
  wilder_sql("ts_", "dm", "t", 14), wilder_sql("ps_", "dm", "p", 14), wilder_sql("ms_", "dm", "m", 14), joined("di0", t="ts_", p="ps_", m="ms_"),
  """di AS (SELECT *, 100 * p / t AS pdi, 100 * m / t AS mdi, 100 * abs(100 * p / t - 100 * m / t) / (100 * p / t + 100 * m / t) AS dx FROM di0)""",
  wilder_sql("adx_", "di", "dx", 14), joined("ad", "di", adx="adx_")]
ind("adx", "adx:f plus_di:f minus_di:f adx_regime:i", "adx, pdi AS plus_di, mdi AS minus_di, CASE WHEN adx < 20 THEN -1 WHEN adx > 40 THEN 1 WHEN adx IS NOT NULL THEN 0 END AS adx_regime", *ADX, src="ad")
ind("dmi_signal", "dmi_signal:f", "CASE WHEN pdi > mdi THEN 1 ELSE -1 END * adx / 100 AS dmi_signal", *ADX, src="ad")
ind("trend_quality", "trend_quality:f", """CASE WHEN count(*) OVER w200 = 200 THEN CASE WHEN (close > avg(close) OVER w50 AND avg(close) OVER w50 > avg(close) OVER w200) OR (close < avg(close) OVER w50 AND avg(close) OVER w50 < avg(close) OVER w200) THEN 1 ELSE 0 END * least(adx / 50, 1) END AS trend_quality""", *ADX, src="ad")
ind("vol_regime", "vol_regime:i", "CASE WHEN pct IS NOT NULL AND count(pct) OVER w200 >= 20 THEN CASE WHEN pct < quantile_cont(pct, 0.33) OVER w200 THEN -1 WHEN pct > quantile_cont(pct, 0.67) OVER w200 THEN 1 ELSE 0 END END AS vol_regime",
    *ATR, joined("j", atr="atr"), "p AS (SELECT *, atr / close * 100 AS pct FROM j)", src="p")
ind("chandelier", "chandelier_long:f chandelier_short:f", "max(high) OVER w14 - 3 * atr AS chandelier_long, min(low) OVER w14 + 3 * atr AS chandelier_short", *ATR, joined("j", atr="atr"), src="j")
MACD = [ema_sql("f_", "bars", "close", 12), ema_sql("s_", "bars", "close", 26), joined("fs", f="f_", s="s_"), "md AS (SELECT *, f - s AS macd FROM fs)"]
ind("macd", "macd:f macd_signal:f macd_hist:f", "macd, sg AS macd_signal, macd - sg AS macd_hist", *MACD, ema_sql("g_", "md", "macd", 9), joined("mj", "md", sg="g_"), src="mj")
ind("macd_divergence", "macd_divergence:i", div_sql("macd", "macd_divergence"), *MACD, src="md")
ind("keltner", "kc_mid:f kc_upper:f kc_lower:f", "e AS kc_mid, e + 1.5 * a AS kc_upper, e - 1.5 * a AS kc_lower", PREV, wilder_sql("a_", "tr", "tr", 20), ema_sql("e_", "bars", "close", 20), joined("j", a="a_", e="e_"), src="j")
ind("squeeze", "squeeze_on:i squeeze_momentum:f", f"{n_ok('w20', 20, '(2 * stddev_pop(close) OVER w20 < 1.5 * a)::INT')} AS squeeze_on, {n_ok('w20', 20, 'close - avg(close) OVER w20')} AS squeeze_momentum", PREV, wilder_sql("a_", "tr", "tr", 20), joined("j", a="a_"), src="j")
ind("atr_ratio", "atr_ratio:f", "tanh((a / b - 1) * 5) AS atr_ratio", PREV, wilder_sql("a_", "tr", "tr", 5), wilder_sql("b_", "tr", "tr", 200), joined("j", a="a_", b="b_"), src="j")
ind("vol_expansion", "vol_expansion:f", "CASE WHEN count(atr) OVER w20 = 20 THEN atan((atr / avg(atr) OVER w20 - 1) * 10) * 2 / pi() END AS vol_expansion", *ATR, joined("j", atr="atr"), src="j")
RSI = [PREV, wilder_sql("g_", "tr", "g", 14), wilder_sql("l_", "tr", "lo", 14), joined("r0", ag="g_", al="l_"), "r AS (SELECT *, CASE WHEN al IS NOT NULL THEN CASE WHEN al <= 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END END AS rsi FROM r0)"]
ind("rsi", "rsi:f", "rsi", *RSI, src="r")
ind("rsi_extreme", "rsi_extreme:f", "CASE WHEN rsi IS NOT NULL THEN greatest(-1, least(1, (rsi - 50) / 50)) END AS rsi_extreme", *RSI, src="r")
ind("rsi_divergence", "rsi_divergence:i", div_sql("rsi", "rsi_divergence"), *RSI, src="r")
ind("dynamic_zone_rsi", "dz_rsi:f dz_rsi_upper:f dz_rsi_lower:f", "rsi AS dz_rsi, CASE WHEN count(rsi) OVER w20 = 20 THEN avg(rsi) OVER w20 + 1.3185 * stddev_pop(rsi) OVER w20 END AS dz_rsi_upper, CASE WHEN count(rsi) OVER w20 = 20 THEN avg(rsi) OVER w20 - 1.3185 * stddev_pop(rsi) OVER w20 END AS dz_rsi_lower", *RSI, src="r")
ind("stoch_rsi", "stoch_rsi:f", "CASE WHEN q IS NOT NULL THEN avg(q) OVER w3 END AS stoch_rsi", *RSI,
    "q AS (SELECT *, CASE WHEN count(rsi) OVER z = 14 THEN CASE WHEN max(rsi) OVER z > min(rsi) OVER z THEN (rsi - min(rsi) OVER z) / (max(rsi) OVER z - min(rsi) OVER z) * 100 ELSE 50 END END AS q FROM r WINDOW z AS (PARTITION BY series_id ORDER BY ts ROWS 13 PRECEDING))", src="q")
ind("delta_price", "delta_price:f", "tanh((close - lag(close) OVER w) / atr) AS delta_price", *ATR, joined("j", atr="atr"), src="j")
ind("repulse", "repulse:f", "a - b AS repulse",
    "rp AS (SELECT *, CASE WHEN rn >= 5 THEN 100 * (3 * close - 2 * min(low) OVER z - lag(open, 4) OVER y) / close END AS bu, CASE WHEN rn >= 5 THEN 100 * (lag(open, 4) OVER y + 2 * max(high) OVER z - 3 * close) / close END AS be FROM bars WINDOW z AS (PARTITION BY series_id ORDER BY ts ROWS 4 PRECEDING), y AS (PARTITION BY series_id ORDER BY ts))",
    ema_sql("a_", "rp", "bu", 25), ema_sql("b_", "rp", "be", 25), joined("j", a="a_", b="b_"), src="j")
ind("smi", "smi:f smi_signal:f", "smi, g AS smi_signal",
    "r0 AS (SELECT *, CASE WHEN rn >= 10 THEN close - (max(high) OVER z + min(low) OVER z) / 2 END AS rel, CASE WHEN rn >= 10 THEN max(high) OVER z - min(low) OVER z END AS rng FROM bars WINDOW z AS (PARTITION BY series_id ORDER BY ts ROWS 9 PRECEDING))",
    first_ema_sql("a1", "r0", "rel", "0.5"), first_ema_sql("a2", "a1", "v", "0.5"), first_ema_sql("b1", "r0", "rng", "0.5"), first_ema_sql("b2", "b1", "v", "0.5"),
    joined("s0", a="a2", b="b2"), "s1 AS (SELECT *, CASE WHEN b <> 0 THEN CASE WHEN a IS NOT NULL THEN greatest(-100, least(100, 100 * a / (b / 2))) END WHEN b = 0 THEN 0 END AS smi FROM s0)",
    first_ema_sql("g_", "s1", "smi", "(2.0 / 11)"), joined("s2", "s1", g="g_"), src="s2")
ind("chaikin_volatility", "chaikin_volatility:f", "CASE WHEN lag(e, 10) OVER w <> 0 THEN 100 * (e - lag(e, 10) OVER w) / lag(e, 10) OVER w END AS chaikin_volatility", "hl AS (SELECT *, high - low AS x FROM bars)", ema_sql("e_", "hl", "x", 10), joined("j", e="e_"), src="j")


def chain_sql(p: str, n: int, depth: int, src: str = "bars", col: str = "close") -> list[str]:
    out = []
    for i in range(1, depth + 1):
        out.append(ema_sql(f"{p}{i}", src, col, n))
        src, col = f"{p}{i}", "v"
    return out


ind("dema", "dema:f", "2 * a - b AS dema", *chain_sql("e", 20, 2), joined("j", a="e1", b="e2"), src="j")
ind("tema", "tema:f", "3 * a - 3 * b + c AS tema", *chain_sql("e", 20, 3), joined("j", a="e1", b="e2", c="e3"), src="j")
ind("trix", "trix:f", "CASE WHEN lag(c) OVER w <> 0 THEN 100 * (c - lag(c) OVER w) / lag(c) OVER w END AS trix", *chain_sql("e", 15, 3), joined("j", c="e3"), src="j")
ind("macd_zero_lag", "zl_macd:f zl_signal:f", "zl AS zl_macd, 2 * a - b AS zl_signal", *chain_sql("f", 12, 2), *chain_sql("s", 26, 2), joined("j", fa="f1", fb="f2", sa="s1", sb="s2"),
    "z AS (SELECT *, (2 * fa - fb) - (2 * sa - sb) AS zl FROM j)", *chain_sql("g", 9, 2, "z", "zl"), joined("k", "z", a="g1", b="g2"), src="k")
ind("price_oscillator", "price_oscillator:f", "100 * (f - s) / s AS price_oscillator", *MACD, src="md")
ind("volume_oscillator", "volume_oscillator:f", "100 * (f - s) / s AS volume_oscillator", ema_sql("f_", "bars", "volume", 12), ema_sql("s_", "bars", "volume", 26), joined("j", f="f_", s="s_"), src="j")
ind("bull_bear_power", "bull_power:f bear_power:f", "high - e AS bull_power, low - e AS bear_power", ema_sql("e_", "bars", "close", 13), joined("j", e="e_"), src="j")
ind("fisher", "fisher:f", None)
ind("schaff", "schaff:f", None)


@query("ind_adaptive_ma", KEY + "adaptive_ma:f", with_sql(HOURLY_SQL, """
    d AS (SELECT *, abs(close - lag(close) OVER (PARTITION BY series_id ORDER BY ts)) AS dc, lag(close, 10) OVER (PARTITION BY series_id ORDER BY ts) AS old FROM bars)""", """
    e AS (SELECT *, CASE WHEN old IS NOT NULL THEN pow(CASE WHEN sum(dc) OVER z > 0 THEN abs(close - old) / sum(dc) OVER z ELSE 0 END * (2.0/3 - 2.0/31) + 2.0/31, 2) END AS sc FROM d WINDOW z AS (PARTITION BY series_id ORDER BY ts ROWS 9 PRECEDING))""",
    """r AS (SELECT series_id, rn, close AS y FROM e WHERE rn = 11 UNION ALL SELECT e.series_id, e.rn, r.y + e.sc * (e.close - r.y) FROM r JOIN e ON e.series_id = r.series_id AND e.rn = r.rn + 1)""",
    body="SELECT bars.series_id, bars.ts, y AS adaptive_ma FROM bars LEFT JOIN r USING (series_id, rn)", recursive=True))
def ind_adaptive_ma(spark, sf):
    return with_indicators(hourly_series(spark, sf), ["adaptive_ma"])


# ----- cumulative, session and level indicators ---------------------------------------

CUM = "(PARTITION BY series_id ORDER BY ts)"


@query("ind_obv", KEY + "obv:f", with_sql(HOURLY_SQL, PREV, body=f"SELECT series_id, ts, sum(coalesce(sign(close - pc) * volume, 0)) OVER {CUM} AS obv FROM tr"))
def ind_obv(spark, sf):
    return L.obv(hourly_series(spark, sf))


@query("ind_accumulation_distribution", KEY + "ad_line:f", with_sql(HOURLY_SQL, body=f"SELECT series_id, ts, sum({MF}) OVER {CUM} AS ad_line FROM bars"))
def ind_ad(spark, sf):
    return L.accumulation_distribution(hourly_series(spark, sf))


@query("ind_asi", KEY + "asi:f", with_sql(HOURLY_SQL, SI_SQL, body=f"SELECT series_id, ts, sum(coalesce(si, 0)) OVER {CUM} AS asi FROM si"))
def ind_asi(spark, sf):
    return L.asi(hourly_series(spark, sf))


@query("ind_chaikin_oscillator", KEY + "chaikin_oscillator:f", with_sql(
    HOURLY_SQL, f"ad AS (SELECT *, sum({MF}) OVER {CUM} AS x FROM bars)", ema_sql("f_", "ad", "x", 3), ema_sql("s_", "ad", "x", 10), joined("j", f="f_", s="s_"),
    body="SELECT series_id, ts, f - s AS chaikin_oscillator FROM j"))
def ind_cho(spark, sf):
    return L.chaikin_oscillator(hourly_series(spark, sf))


@query("ind_vwap", KEY + "vwap:f", with_sql(HOURLY_SQL, body="SELECT series_id, ts, CASE WHEN sum(volume) OVER z > 0 THEN sum((high + low + close) / 3 * volume) OVER z / sum(volume) OVER z END AS vwap FROM bars WINDOW z AS (PARTITION BY series_id, date_trunc('day', ts) ORDER BY ts)"))
def ind_vwap(spark, sf):
    return L.vwap(hourly_series(spark, sf))


PREVDAY = """
dd AS (SELECT series_id, date_trunc('day', ts) AS day, max(high) AS h, min(low) AS l, last(close ORDER BY ts) AS c FROM bars GROUP BY 1, 2),
pd AS (SELECT series_id, day, lag(h) OVER z AS ph, lag(l) OVER z AS pl, lag(c) OVER z AS pc FROM dd WINDOW z AS (PARTITION BY series_id ORDER BY day)),
pb AS (SELECT b.series_id, b.ts, ph, pl, pc, {} AS p FROM bars b JOIN pd ON b.series_id = pd.series_id AND date_trunc('day', b.ts) = pd.day)"""


@query("ind_pivot_points", KEY + "pivot:f r1:f s1:f r2:f s2:f r3:f s3:f", with_sql(HOURLY_SQL, PREVDAY.format("(ph + pl + pc) / 3"),
       body="SELECT series_id, ts, p AS \"pivot\", 2 * p - pl AS r1, 2 * p - ph AS s1, p + ph - pl AS r2, p - (ph - pl) AS s2, ph + 2 * (p - pl) AS r3, pl - 2 * (ph - p) AS s3 FROM pb"))
def ind_pivot(spark, sf):
    return L.pivot_points(hourly(spark, sf), "series_id")


@query("ind_woodie_pivots", KEY + "pivot:f r1:f s1:f r2:f s2:f", with_sql(HOURLY_SQL, PREVDAY.format("(ph + pl + 2 * pc) / 4"),
       body="SELECT series_id, ts, p AS \"pivot\", 2 * p - pl AS r1, 2 * p - ph AS s1, p + ph - pl AS r2, p - (ph - pl) AS s2 FROM pb"))
def ind_woodie(spark, sf):
    return L.woodie_pivots(hourly(spark, sf), "series_id")


@query("ind_camarilla_pivots", KEY + "r1:f s1:f r2:f s2:f r3:f s3:f r4:f s4:f", with_sql(HOURLY_SQL, PREVDAY.format("pc"),
       body="SELECT series_id, ts, " + ", ".join(f"pc + (ph - pl) * 1.1 / {d} AS r{i}, pc - (ph - pl) * 1.1 / {d} AS s{i}" for i, d in enumerate((12, 6, 4, 2), 1)) + " FROM pb"))
def ind_camarilla(spark, sf):
    return L.camarilla_pivots(hourly(spark, sf), "series_id")


@query("ind_session_strength", KEY + "session:i session_value:f asian_range:f london_break:f", with_sql(HOURLY_SQL, """
    s AS (SELECT *, date_trunc('day', ts) AS day, CASE WHEN hour(ts) < 8 THEN 0 WHEN hour(ts) < 16 THEN 1 ELSE 2 END AS session FROM bars),
    a AS (SELECT series_id, day, max(high) FILTER (WHERE session = 0) - min(low) FILTER (WHERE session = 0) AS ar, first(close ORDER BY ts) FILTER (WHERE session = 1) AS lo, first(close ORDER BY ts) FILTER (WHERE session = 2) AS ny FROM s GROUP BY 1, 2)""",
    body="""SELECT s.series_id, ts, session, CASE WHEN max(high) OVER z > min(low) OVER z THEN (close - min(low) OVER z) / (max(high) OVER z - min(low) OVER z) * 2 - 1 END AS session_value,
      CASE WHEN session >= 1 THEN ar END AS asian_range, CASE WHEN session = 2 AND ar > 0 THEN (ny - lo) / ar END AS london_break FROM s JOIN a USING (series_id, day) WINDOW z AS (PARTITION BY s.series_id, day, session ORDER BY ts)"""))
def ind_session(spark, sf):
    return L.session_strength(hourly_series(spark, sf))


@query("ind_asian_range", KEY + "session_high:f session_low:f session_mid:f",
       with_sql(HOURLY_SQL, """s AS (SELECT series_id, date_trunc('day', ts) + INTERVAL 7 HOUR AS available_at, max(high) AS session_high, min(low) AS session_low,
         (max(high) + min(low)) / 2 AS session_mid FROM bars WHERE hour(ts) < 7 GROUP BY 1, 2)""",
       body="SELECT b.series_id, b.ts, session_high, session_low, session_mid FROM bars b ASOF LEFT JOIN s ON b.series_id = s.series_id AND b.ts >= s.available_at"))
def ind_asian(spark, sf):
    from barline.operators.asof import asof
    from barline.operators.bars import session_range

    h = hourly(spark, sf)
    return asof(h.select("series_id", "ts"), session_range(h, "series_id").drop("day"), "series_id")


def sar_sql(bars: str, start: float = 0.02, step: float = 0.02, top: float = 0.2) -> str:
    """CTE ``sar`` over a table of (series_id, rn, high, low): one step of the stop per row."""
    return f"""sar AS (
  SELECT series_id, rn, high AS h1, low AS l1, CAST(NULL AS DOUBLE) AS h2, CAST(NULL AS DOUBLE) AS l2, 1 AS side, CAST(low AS DOUBLE) AS stop,
    CAST(high AS DOUBLE) AS ext, CAST({start} AS DOUBLE) AS f FROM {bars} WHERE rn = 1
  UNION ALL SELECT series_id, rn, high, low, h1, l1,
    CASE WHEN h2 IS NULL THEN CASE WHEN high > h1 THEN 1 ELSE -1 END WHEN turned THEN -side ELSE side END,
    CASE WHEN h2 IS NULL THEN CASE WHEN high > h1 THEN l1 ELSE h1 END WHEN turned THEN ext ELSE moved END,
    CASE WHEN h2 IS NULL THEN CASE WHEN high > h1 THEN high ELSE low END WHEN turned THEN CASE WHEN side = 1 THEN low ELSE high END
      WHEN side = 1 THEN greatest(ext, high) ELSE least(ext, low) END,
    CASE WHEN h2 IS NULL OR turned THEN {start} WHEN (side = 1 AND high > ext) OR (side = -1 AND low < ext) THEN least(f + {step}, {top}) ELSE f END
  FROM (SELECT *, CASE WHEN side = 1 THEN low < moved ELSE high > moved END AS turned FROM (
    SELECT b.series_id, b.rn, b.high, b.low, h1, l1, h2, l2, side, ext, f,
      CASE WHEN side = 1 THEN least(stop + f * (ext - stop), l1, l2) ELSE greatest(stop + f * (ext - stop), h1, h2) END AS moved
    FROM sar JOIN {bars} b ON b.series_id = sar.series_id AND b.rn = sar.rn + 1)))"""


TREND_SQL = """tr AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr
  FROM (SELECT *, lag(close) OVER (PARTITION BY series_id ORDER BY ts) AS pc FROM bars)),
ma AS (SELECT series_id, rn, tr AS total, CAST(NULL AS DOUBLE) AS atr FROM tr WHERE rn = 1
  UNION ALL SELECT t.series_id, t.rn, total + t.tr, CASE WHEN t.rn = 10 THEN (total + t.tr) / 10 WHEN t.rn > 10 THEN (atr * 9 + t.tr) / 10 END
  FROM ma JOIN tr t ON t.series_id = ma.series_id AND t.rn = ma.rn + 1),
st AS (SELECT series_id, rn, close AS pc, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS dn, 1 AS side FROM bars WHERE rn = 10
  UNION ALL SELECT series_id, rn, close, up, dn, CASE WHEN side = 1 AND close < dn THEN -1 WHEN side = -1 AND close > up THEN 1 ELSE side END
  FROM (SELECT b.series_id, b.rn, b.close, st.side,
      CASE WHEN up IS NULL OR pc > up THEN (high + low) / 2 + 3 * atr ELSE least(up, (high + low) / 2 + 3 * atr) END AS up,
      CASE WHEN dn IS NULL OR pc < dn THEN (high + low) / 2 - 3 * atr ELSE greatest(dn, (high + low) / 2 - 3 * atr) END AS dn
    FROM st JOIN bars b ON b.series_id = st.series_id AND b.rn = st.rn + 1 JOIN ma ON ma.series_id = b.series_id AND ma.rn = b.rn))"""


@query("ind_parabolic_sar", KEY + "sar:f sar_dir:i psar_delta:f",
       with_sql(HOURLY_SQL, sar_sql("bars"), body="SELECT series_id, ts, stop AS sar, side AS sar_dir, close - stop AS psar_delta FROM bars JOIN sar USING (series_id, rn)", recursive=True))
def ind_psar(spark, sf):
    return SP.parabolic_sar(hourly_series(spark, sf))


@query("ind_super_trend", KEY + "st_level:f st_dir:i",
       with_sql(HOURLY_SQL, TREND_SQL, recursive=True, body="""SELECT series_id, ts, CASE WHEN rn > 10 THEN CASE WHEN side = 1 THEN dn ELSE up END END AS st_level,
         CASE WHEN rn > 10 THEN side END AS st_dir FROM bars LEFT JOIN st USING (series_id, rn)"""))
def ind_st(spark, sf):
    return SP.super_trend(hourly_series(spark, sf))


@query("ind_price_consensus", KEY + "mc_d:f mc_dd:f")
def ind_mc(spark, sf):
    return KO.price_consensus(hourly_series(spark, sf), steps=(1, 2, 6, 12, 24))


@query("ind_asi_consensus", KEY + "asi_smooth:f asi_mc_d:f asi_mc_dd:f")
def ind_asimc(spark, sf):
    return KO.asi_consensus(hourly_series(spark, sf), steps=(1, 2, 6, 12, 24))


@query("ind_box_consistency", "series_id:i ts:t box_id:i level:f consistency:f")
def ind_box(spark, sf):
    from barline.operators.eventbars import box_columns, box_consistency

    return box_consistency(box_columns(ticks(spark, sf), "series_id", 10.0, 3), "series_id")


@query("ind_wide_features", KEY + "sma_20:f ema_8:f ema_21:f rsi:f atr:f macd_hist:f adx:f bb_width:f cci:f stoch_k:f donchian:f")
def ind_wide(spark, sf):
    d = with_indicators(hourly_series(spark, sf), [("sma", {"n": 20}), ("ema", {"n": 8}), ("ema", {"n": 21}), "rsi", "atr", "macd", "adx", "bb_width", "cci", "stochastic", "donchian"])
    return d.withColumn("donchian", F.when(F.col("dc_high") > F.col("dc_low"), (F.col("close") - F.col("dc_low")) / (F.col("dc_high") - F.col("dc_low"))))


@query("ind_tick_bollinger", "series_id:i tie:i bb_mid:f bb_upper:f bb_lower:f", with_sql(TICKS_SQL, body="""
    SELECT series_id, tie, CASE WHEN n = 20 THEN m END AS bb_mid, CASE WHEN n = 20 THEN m + 2 * s END AS bb_upper, CASE WHEN n = 20 THEN m - 2 * s END AS bb_lower
    FROM (SELECT series_id, tie, count(*) OVER w AS n, avg(price) OVER w AS m, stddev_pop(price) OVER w AS s FROM ticks WINDOW w AS (PARTITION BY series_id ORDER BY ts, tie ROWS 19 PRECEDING))"""))
def ind_tick_bb(spark, sf):
    """The same indicator on raw ticks of many keys; hot keys are cut into blocks."""
    t = ticks(spark, sf).withColumn("close", F.col("price"))
    return with_indicators(Series(t, "series_id", ["ts", "tie"]), ["bollinger"])
