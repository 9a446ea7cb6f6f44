"""Cross-section and factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.inputs import HOURLY_SQL, hourly, hourly_series, with_sql
from barline.catalog.joins import BRIDGE_SQL, nation_pairs
from barline.catalog.registry import query
from barline.operators import xsection as X
from barline.operators.indicators import with_indicators
from barline.operators.joins import pair_bridge, panel
from barline.operators.ordering import top_bottom
from barline.plans.series import Series
from barline.sources.readers import read_table
from barline.sources.sinks import materialize

KEYS = ["click", "view", "error", "signup"]
PANEL_SQL = "pn AS (SELECT ts, " + ", ".join(f"max(close) FILTER (WHERE series_id = '{k}') AS p_{k}" for k in KEYS) + f" FROM bars WHERE series_id IN ({', '.join(repr(k) for k in KEYS)}) GROUP BY ts HAVING count(*) = 4)"


def wide(spark, sf):
    return panel(hourly(spark, sf), "series_id", "ts", "close", KEYS, "p_")


@query("x01_strength_spread", "pair:i ts:t spread:f n_legs:i",
       with_sql(BRIDGE_SQL, """d AS (SELECT * FROM daily WHERE c <> s), st AS (SELECT entity, ts, avg(v) AS st FROM (SELECT c AS entity, ts, x AS v FROM d UNION ALL SELECT s, ts, -x FROM d) GROUP BY 1, 2),
         z AS (SELECT entity, ts, CASE WHEN stddev_pop(st) OVER w > 0 THEN (st - avg(st) OVER w) / stddev_pop(st) OVER w END AS z FROM st WINDOW w AS (PARTITION BY ts))""",
       body="SELECT c * 100 + s AS pair, d.ts, a.z - b.z AS spread, (a.z IS NOT NULL)::INT + (b.z IS NOT NULL)::INT AS n_legs FROM d JOIN z a ON a.entity = c AND a.ts = d.ts JOIN z b ON b.entity = s AND b.ts = d.ts"))
def x01(spark, sf):
    p = materialize(nation_pairs(spark, sf).filter("c <> s"), "nation-pairs")
    return X.strength_spread(p, pair_bridge(p.select("pair", "c", "s").distinct(), "pair", "c", "s"), "pair", "ts", "x")


@query("x02_tradeability", "series_id:s ts:t tradeability:f rk:i")
def x02(spark, sf):
    s = hourly_series(spark, sf)
    d = with_indicators(s, ["adx", "atr"])
    d = s.with_df(d).columns(lambda fr: {"adxr": (F.col("adx") + F.lag("adx", 14).over(fr.w())) / 2}, back_rows=14)
    econ = X.economic_factor(F.col("volume"), 0.02 * F.greatest(F.col("close"), F.lit(0.01)), F.col("high") - F.col("low"))
    return X.tradeability(d, econ, F.col("adxr"), F.col("atr"), "ts", "series_id")


@query("x03_triangulate", "ts:t click_view:f error_view:f view_index:f",
       with_sql(HOURLY_SQL, PANEL_SQL, body="""SELECT ts, a AS click_view, 1 / b AS error_view, exp(-(ln(a) + ln(1 / b)) / 3) AS view_index FROM (SELECT ts, p_click / p_view AS a, p_view / p_error AS b FROM pn WHERE p_click > 0 AND p_view > 0 AND p_error > 0)"""))
def x03(spark, sf):
    d = wide(spark, sf).filter("p_click > 0 AND p_view > 0 AND p_error > 0").select("ts", (F.col("p_click") / F.col("p_view")).alias("a"), (F.col("p_view") / F.col("p_error")).alias("b"))
    return X.triangulate(d, "ts", "view", {"a": ("click", "view"), "b": ("view", "error")})


FACTOR_SQL = """
px AS (SELECT c_mktsegment AS entity, date_trunc('month', o_orderdate) AS ts, avg(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
lv AS (SELECT entity, date_trunc('year', ts) + INTERVAL 1 YEAR AS available_at, avg(price) AS level FROM px GROUP BY 1, 2),
rt AS (SELECT c_mktsegment AS entity, date_trunc('month', o_orderdate) AS available_at, avg(l_discount) AS rate FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
g AS (SELECT entity, ts AS date FROM px WHERE month(ts) IN (3, 6, 9, 12)),
a0 AS (SELECT g.*, px.price AS p_now FROM g ASOF LEFT JOIN px ON g.entity = px.entity AND g.date >= px.ts),
a1 AS (SELECT a0.*, px.price AS p_skip FROM a0 ASOF LEFT JOIN px ON a0.entity = px.entity AND (a0.date - INTERVAL 1 MONTH) >= px.ts),
a2 AS (SELECT a1.*, px.price AS p_look FROM a1 ASOF LEFT JOIN px ON a1.entity = px.entity AND (a1.date - INTERVAL 12 MONTH) >= px.ts),
a3 AS (SELECT a2.*, lv.level FROM a2 ASOF LEFT JOIN lv ON a2.entity = lv.entity AND a2.date >= lv.available_at),
a4 AS (SELECT a3.*, rt.rate AS carry FROM a3 ASOF LEFT JOIN rt ON a3.entity = rt.entity AND a3.date >= rt.available_at),
fs AS (SELECT entity, date, carry, ln(p_skip) - ln(p_look) AS momentum, ln(p_now) - ln(level) AS "value" FROM a4),
rk AS (SELECT *, CASE WHEN carry IS NOT NULL THEN rank() OVER (PARTITION BY date, carry IS NULL ORDER BY carry) END AS rc, CASE WHEN momentum IS NOT NULL THEN rank() OVER (PARTITION BY date, momentum IS NULL ORDER BY momentum) END AS rm,
  CASE WHEN "value" IS NOT NULL THEN rank() OVER (PARTITION BY date, "value" IS NULL ORDER BY "value") END AS rv FROM fs),
comp AS (SELECT entity, date, carry, momentum, "value", (coalesce(rc, 0) + coalesce(rm, 0) + coalesce(rv, 0)) * 1.0 / nullif((rc IS NOT NULL)::INT + (rm IS NOT NULL)::INT + (rv IS NOT NULL)::INT, 0) AS composite FROM rk)"""


def factor_table(spark, sf):
    o, c, li = (read_table(spark, sf, x) for x in ("orders", "customer", "lineitem"))
    sold = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("entity"), F.date_trunc("month", "o_orderdate").alias("ts"), "o_orderkey", "o_totalprice")
    px = materialize(sold.groupBy("entity", "ts").agg(F.avg("o_totalprice").alias("price")), "monthly-price")
    year_end = F.date_trunc("year", "ts") + F.expr("INTERVAL 1 YEAR")
    levels = px.groupBy("entity", year_end.alias("available_at")).agg(F.avg("price").alias("level"))
    rates = sold.join(li, sold.o_orderkey == li.l_orderkey).groupBy("entity", F.col("ts").alias("available_at")).agg(F.avg("l_discount").alias("rate"))
    # quarter-end months in which the entity has a price
    dates = px.filter(F.month("ts").isin(3, 6, 9, 12)).select("entity", F.col("ts").alias("date"))
    scores = materialize(X.factor_scores(px, levels, rates, dates, "entity"), "factor-scores")
    return X.rank_composite(scores, "date", ["carry", "momentum", "value"], "entity")


@query("x04_factor_scores", "entity:s date:t carry:f momentum:f value:f composite:f", with_sql(FACTOR_SQL, body="SELECT * FROM comp"))
def x04(spark, sf):
    return factor_table(spark, sf)


@query("x05_select_legs", "entity:s date:t leg:i",
       with_sql(FACTOR_SQL, "r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY momentum DESC, entity) AS up, row_number() OVER (PARTITION BY date ORDER BY momentum, entity) AS dn, least(2, count(*) OVER (PARTITION BY date) // 2) AS k FROM comp WHERE momentum IS NOT NULL)",
                body="SELECT entity, date, CASE WHEN up <= k THEN 1 ELSE -1 END AS leg FROM r WHERE up <= k OR dn <= k"))
def x05(spark, sf):
    return top_bottom(factor_table(spark, sf), "date", "momentum", 2, "entity")


@query("x06_inverse_vol", "series_id:s date:t vol:f weight:f",
       with_sql(HOURLY_SQL, "r AS (SELECT series_id, ts, rn, close - lag(close) OVER (PARTITION BY series_id ORDER BY ts) AS r FROM bars)",
                "v AS (SELECT series_id, ts, CASE WHEN count(r) OVER w = 24 THEN stddev_samp(r) OVER w END AS vol FROM r WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS 23 PRECEDING))",
                "g AS (SELECT DISTINCT series_id, date_trunc('day', ts) AS date FROM bars)",
                "j AS (SELECT g.series_id, date, vol FROM g ASOF LEFT JOIN (SELECT * FROM v WHERE vol > 0) v ON g.series_id = v.series_id AND g.date >= v.ts)",
                body="SELECT series_id, date, vol, (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) AS weight FROM j"))
def x06(spark, sf):
    s = hourly_series(spark, sf)
    d = s.columns(lambda fr: {"r": F.col("close") - F.lag("close").over(fr.w())}, back_rows=1)
    dates = s.df.select("series_id", F.date_trunc("day", "ts").alias("date")).distinct()
    return X.inverse_vol(s.with_df(d), 24, "r", dates, "series_id")


@query("x07_transition_signal", "series_id:s ts:t state:i signal:f",
       with_sql(HOURLY_SQL, "r AS (SELECT series_id, ts, rn, close / lag(close, 4) OVER (PARTITION BY series_id ORDER BY ts) - 1 AS r FROM bars WHERE true)",
                "s AS (SELECT *, CASE WHEN r > 0.2 THEN 1 WHEN r < -0.2 THEN -1 WHEN r IS NOT NULL THEN 0 END AS state FROM r)", "t AS (SELECT *, lag(state) OVER (PARTITION BY series_id ORDER BY ts) AS fr FROM s)",
                body="""SELECT a.series_id, a.ts, a.state, (count(*) FILTER (WHERE b.state = 1) - count(*) FILTER (WHERE b.state = -1)) * 1.0 / nullif(count(b.state), 0) AS signal
         FROM t a LEFT JOIN t b ON a.series_id = b.series_id AND b.rn <= a.rn AND b.fr = a.state AND b.state IS NOT NULL GROUP BY 1, 2, 3"""))
def x07(spark, sf):
    return X.transition_signal(hourly_series(spark, sf), 4, 0.2)


@query("x08_eigen_residual", "ts:t s_r_click:f s_r_view:f s_r_error:f s_r_signup:f k_r_click:f k_r_view:f k_r_error:f k_r_signup:f")
def x08(spark, sf):
    w = Series(wide(spark, sf), None, ["ts"]).columns(lambda fr: {f"r_{k}": F.col(f"p_{k}") - F.lag(f"p_{k}").over(fr.w()) for k in KEYS}, back_rows=1)
    return X.eigen_residual(w.filter("r_click IS NOT NULL"), "ts", [f"r_{k}" for k in KEYS], 60, 1)


@query("x09_coint_residual", "ts:t p_click:f p_view:f alpha:f beta:f resid:f",
       with_sql(HOURLY_SQL, PANEL_SQL, "f AS (SELECT regr_slope(p_click, p_view) AS beta, regr_intercept(p_click, p_view) AS alpha FROM pn WHERE ts < TIMESTAMP '2024-01-20')", body="SELECT ts, p_click, p_view, alpha, beta, p_click - alpha - beta * p_view AS resid FROM pn, f"))
def x09(spark, sf):
    return X.coint_residual(wide(spark, sf), "ts", "p_click", "p_view", F.col("ts") < "2024-01-20")


@query("x09_adf_t", "series_id:s n:i slope:f t_stat:f",
       with_sql(HOURLY_SQL, "d AS (SELECT series_id, close - lag(close) OVER w AS y, lag(close) OVER w AS x FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts))",
                body="SELECT series_id, count(*) AS n, regr_slope(y, x) AS slope, regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS t_stat FROM d WHERE x IS NOT NULL GROUP BY 1"))
def x09t(spark, sf):
    return X.adf_t(hourly_series(spark, sf), "close")


@query("x10_lead_lag", "lead_p_view:f lead_p_error:f back_p_view:f back_p_error:f n:i",
       with_sql(HOURLY_SQL, PANEL_SQL, "d AS (SELECT ts, p_click - lag(p_click) OVER w AS dt, p_view - lag(p_view) OVER w AS da, p_error - lag(p_error) OVER w AS db FROM pn WINDOW w AS (ORDER BY ts))",
                "r AS (SELECT *, dt - da - db AS res FROM d)", "l AS (SELECT *, lag(da) OVER w AS la, lag(db) OVER w AS lb, lag(res) OVER w AS lr FROM r WINDOW w AS (ORDER BY ts))",
                body="SELECT corr(la, res) AS lead_p_view, corr(lb, res) AS lead_p_error, corr(lr, da) AS back_p_view, corr(lr, db) AS back_p_error, count(lr) AS n FROM l"))
def x10(spark, sf):
    return X.lead_lag(wide(spark, sf), "ts", "p_click", ("p_view", "p_error"))


@query("x11_cross_correlation", "lag:i corr:f",
       with_sql(HOURLY_SQL, PANEL_SQL, body="\nUNION ALL ".join(f"SELECT {k} AS lag, corr(x, p_view) AS corr FROM (SELECT lag(p_click, {k}) OVER (ORDER BY ts) AS x, p_view FROM pn)" for k in range(6))))
def x11(spark, sf):
    return X.xcorr(wide(spark, sf), None, ["ts"], "p_click", "p_view", 5)


@query("x12_granger", "cause:s effect:s n:i f_stat:f ssr_restricted:f ssr_full:f")
def x12(spark, sf):
    return X.granger(wide(spark, sf), None, ["ts"], "p_click", "p_view", 3)


def te_h(cols: str) -> str:
    return f"(SELECT series_id, sum(-n / t * log2(n / t)) AS h FROM (SELECT series_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY series_id) AS t FROM u GROUP BY series_id, {cols}) GROUP BY 1)"


@query("x13_transfer_entropy", "series_id:s te:f",
       with_sql(HOURLY_SQL, "f AS (SELECT series_id, ts, (volume > 150)::INT AS s, (high - low > 100)::INT AS d FROM bars)", "u0 AS (SELECT series_id, d AS nx, lag(d) OVER w AS d, lag(s) OVER w AS s FROM f WINDOW w AS (PARTITION BY series_id ORDER BY ts))", "u AS (SELECT * FROM u0 WHERE d IS NOT NULL)",
                body=f"SELECT a.series_id, a.h + b.h - c.h - e.h AS te FROM {te_h('nx, d')} a JOIN {te_h('d, s')} b USING (series_id) JOIN {te_h('d')} c USING (series_id) JOIN {te_h('nx, d, s')} e USING (series_id)"))
def x13(spark, sf):
    s = hourly_series(spark, sf)
    d = s.df.withColumn("src", (F.col("volume") > 150).cast("int")).withColumn("dst", (F.col("high") - F.col("low") > 100).cast("int"))
    return X.transfer_entropy(s.with_df(d), "src", "dst")


@query("x14_regime_vector", "series_id:s ts:t drift:f er:f rv:f peak_slope:f trough_slope:f leg_expansion:f n_legs:i vr2:f vr4:f vr8:f")
def x14(spark, sf):
    from barline.operators.regime import regime_vector

    return regime_vector(hourly_series(spark, sf), "close", 60)


FEATS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query("x15_feature_importance", "feature:s importance:f")
def x15(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumn("y", F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")))
    return X.feature_importance(li, FEATS, "y", trees=5, depth=3)


@query("x16_select_features", "feature:s corr_y:f kept:i",
       with_sql("li AS (SELECT *, l_extendedprice * (l_discount - l_tax) AS y, l_quantity * 2 + l_tax AS q2 FROM lineitem)", """
       c AS (SELECT 'l_quantity' AS feature, corr(l_quantity, y) AS r FROM li UNION ALL SELECT 'l_discount', corr(l_discount, y) FROM li UNION ALL SELECT 'l_tax', corr(l_tax, y) FROM li UNION ALL SELECT 'q2', corr(q2, y) FROM li)""",
       body="""SELECT feature, r AS corr_y, CASE WHEN abs(r) < 0.02 THEN 0 WHEN feature IN ('l_quantity', 'q2') THEN (abs(r) = (SELECT max(abs(r)) FROM c WHERE feature IN ('l_quantity', 'q2')))::INT ELSE 1 END AS kept FROM c"""))
def x16(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumn("y", F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).withColumn("q2", F.col("l_quantity") * 2 + F.col("l_tax"))
    return X.select_features(li, ["l_quantity", "l_discount", "l_tax", "q2"], "y", 0.02, 0.9)
