"""Cost and ledger analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.inputs import HOURLY_SQL, LEDGER_SQL, TICKS_SQL, hourly, ledger, ticks, with_sql
from barline.catalog.registry import query
from barline.functions.clock import DAY_US, HOUR_US
from barline.operators import ledger as L
from barline.operators.joins import pair_bridge
from barline.sources.readers import read_table
from barline.sources.sinks import materialize

# line numbers repeat inside an order, so the result itself is the last tie-breaker
ORDER = ["exit_time", "l_orderkey", "l_linenumber", "pnl"]
STRATS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
W = "(PARTITION BY strategy ORDER BY exit_time, l_orderkey, l_linenumber, pnl ROWS UNBOUNDED PRECEDING)"
DAILY_SQL = """
dy AS (SELECT strategy, date_trunc('day', exit_time) AS day, sum(pnl) AS pnl, count(*) AS n FROM ledger GROUP BY 1, 2),
dc AS (SELECT *, sum(pnl) OVER (PARTITION BY strategy ORDER BY day) AS equity FROM dy)"""
PROFILE_SQL = """
pr AS (SELECT event_type AS series_id, (isodow(ts) - 1) * 24 + hour(ts) AS how, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.75) AS p75, count(*) AS n FROM ticks GROUP BY 1, 2)"""


def daily(spark, sf):
    return L.daily_curve(ledger(spark, sf), "strategy")


@query("l01_cost_profile", "series_id:s how:i p25:f p50:f p75:f n:i liquid:b",
       with_sql(TICKS_SQL, PROFILE_SQL, body="SELECT *, n >= 0.5 * max(n) OVER (PARTITION BY series_id) AS liquid FROM pr"))
def l01(spark, sf):
    return L.cost_profile(ticks(spark, sf, "event_type"), "series_id", "price")


@query("l02_cheapest_window", "series_id:s cheap_slot:i cheap:f dear_slot:i dear:f saving:f",
       with_sql(TICKS_SQL, PROFILE_SQL, "h AS (SELECT series_id, how % 24 AS slot, avg(p50) AS v FROM pr GROUP BY 1, 2)",
                "w AS (SELECT a.series_id, a.slot, avg(b.v) AS m FROM h a JOIN h b ON a.series_id = b.series_id AND (b.slot - a.slot + 24) % 24 < 8 GROUP BY 1, 2)",
                body="SELECT series_id, arg_min(slot, m) AS cheap_slot, min(m) AS cheap, arg_max(slot, m) AS dear_slot, max(m) AS dear, max(m) - min(m) AS saving FROM w GROUP BY 1"))
def l02(spark, sf):
    return L.cheapest_window(L.cost_profile(ticks(spark, sf, "event_type"), "series_id", "price"), "series_id")


@query("l03_equity_curve", "l_orderkey:i l_linenumber:i strategy:s equity:f trade_no:i",
       with_sql(LEDGER_SQL, body=f"SELECT l_orderkey, l_linenumber, strategy, sum(pnl) OVER {W} AS equity, count(*) OVER {W} AS trade_no FROM ledger"))
def l03(spark, sf):
    return L.equity_curve(ledger(spark, sf).select("strategy", *ORDER), "strategy", ORDER)


@query("l04_max_drawdown", "strategy:s max_drawdown:f final:f",
       with_sql(LEDGER_SQL, f"e AS (SELECT strategy, exit_time, l_orderkey, l_linenumber, pnl, sum(pnl) OVER {W} AS q FROM ledger)", f"p AS (SELECT *, max(q) OVER {W} AS pk FROM e)",
                body="SELECT strategy, min(q - greatest(pk, 0)) AS max_drawdown, last(q ORDER BY exit_time, l_orderkey, l_linenumber, pnl) AS final FROM p GROUP BY 1"))
def l04(spark, sf):
    return L.max_drawdown(L.equity_curve(ledger(spark, sf).select("strategy", *ORDER), "strategy", ORDER), "strategy", ORDER)


LAST_SQL = "lt AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY pair ORDER BY exit_time DESC, l_orderkey DESC, l_linenumber DESC, pnl DESC) <= 50)"
PERF_SQL = "pf AS (SELECT pair, count(*) AS n, avg(pnl) AS mean, avg(pnl) / stddev_samp(pnl) AS sharpe, avg(pnl) / avg(-pnl) FILTER (WHERE pnl < 0) AS expectancy_r FROM lt GROUP BY 1)"


@query("l05_rolling_perf", "pair:i n:i mean:f sharpe:f expectancy_r:f gate:f", with_sql(LEDGER_SQL, LAST_SQL, PERF_SQL, body="SELECT *, greatest(0, least(1, expectancy_r / 0.5)) AS gate FROM pf"))
def l05(spark, sf):
    return L.rolling_perf(ledger(spark, sf), "pair", ORDER, 50)


@query("l06_blend", "pair:i blended:f",
       with_sql(LEDGER_SQL, LAST_SQL, PERF_SQL, "lf AS (SELECT pair, avg(pnl) AS prior FROM ledger GROUP BY 1)", body="SELECT pair, pow(0.5, n / 30.0) * prior + (1 - pow(0.5, n / 30.0)) * mean AS blended FROM lf JOIN pf USING (pair)"))
def l06(spark, sf):
    led = materialize(ledger(spark, sf).select("pair", *ORDER), "trades")
    prior = led.groupBy("pair").agg(F.avg("pnl").alias("prior"))
    return prior.join(L.rolling_perf(led, "pair", ORDER, 50), "pair", "left").select(
        "pair", L.blend(F.col("prior"), F.col("mean"), F.col("n"), 30.0).alias("blended"))


@query("l07_drawdown_taper", "strategy:s day:t high_water:f drawdown:f scale:f",
       with_sql(LEDGER_SQL, DAILY_SQL, "h AS (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY day) AS hw FROM dc)", "f AS (SELECT *, CASE WHEN hw > 0 THEN (hw - equity) / hw ELSE 0 END AS dd FROM h)",
                body="SELECT strategy, day, hw AS high_water, dd AS drawdown, greatest(0, least(1, (0.2 - dd) / 0.15)) AS scale FROM f"))
def l07(spark, sf):
    return L.drawdown_taper(daily(spark, sf), "strategy", "equity", 0.05, 0.2)


@query("l08_exposure", "entity:i net:f n:i share:f blocked:b",
       with_sql("pos AS (SELECT c_nationkey AS b, s_nationkey AS q, sum(l_extendedprice) AS v, c_nationkey * 100 + s_nationkey AS pair FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)",
                body="SELECT entity, sum(v) AS net, count(*) AS n, sum(v) / 1e9 AS share, abs(sum(v) / 1e9) > 0.02 AS blocked FROM (SELECT b AS entity, v FROM pos WHERE b <> q UNION ALL SELECT q, -v FROM pos WHERE b <> q) GROUP BY 1"))
def l08(spark, sf):
    t = {n: read_table(spark, sf, n) for n in ("lineitem", "orders", "customer", "supplier")}
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    pos = j.filter("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.sum("l_extendedprice").alias("v")).withColumn("pair", F.col("c_nationkey") * 100 + F.col("s_nationkey"))
    return L.exposure(pos.select("pair", "v"), pair_bridge(pos.select("pair", "c_nationkey", "s_nationkey").distinct(), "pair", "c_nationkey", "s_nationkey"), "pair", "v", 1e9, 0.02)


@query("l09_tripwire", "pair:i strategy:s n:i total:f",
       with_sql(LEDGER_SQL, body="SELECT pair, strategy, count(*) AS n, sum(pnl) AS total FROM ledger WHERE exit_time >= TIMESTAMP '2000-01-01' GROUP BY 1, 2 HAVING count(*) >= 10 AND sum(pnl) < 0"))
def l09(spark, sf):
    return L.tripwire(ledger(spark, sf), ["pair", "strategy"], 10, "2000-01-01")


@query("l10_equity_switch", "strategy:s day:t equity:f is_on:i switched_equity:f",
       with_sql(LEDGER_SQL, DAILY_SQL, "m AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN (equity > avg(equity) OVER w)::INT ELSE 1 END AS o FROM dc WINDOW w AS (PARTITION BY strategy ORDER BY day ROWS 19 PRECEDING))",
                "s AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY strategy ORDER BY day), 1) AS is_on FROM m)", body="SELECT strategy, day, equity, is_on, sum(is_on * pnl) OVER (PARTITION BY strategy ORDER BY day) AS switched_equity FROM s"))
def l10(spark, sf):
    return L.equity_switch(daily(spark, sf), "strategy", 20)


@query("l11_monthly_allocation", "month:t n_eligible:i equal_pnl:f selected_pnl:f",
       with_sql(LEDGER_SQL, DAILY_SQL, "sc AS (SELECT strategy, day AS available_at, sum(pnl) OVER w AS score FROM dc WINDOW w AS (PARTITION BY strategy ORDER BY day ROWS 59 PRECEDING) QUALIFY count(*) OVER w = 60)",
                "mo AS (SELECT strategy, date_trunc('month', day) AS month, sum(pnl) AS month_pnl FROM dc GROUP BY 1, 2)", "el AS (SELECT mo.*, score FROM mo ASOF JOIN sc ON mo.strategy = sc.strategy AND mo.month > sc.available_at)",
                "rk AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, strategy) AS rk FROM el)", body="SELECT month, count(*) AS n_eligible, avg(month_pnl) AS equal_pnl, avg(month_pnl) FILTER (WHERE rk <= 2) AS selected_pnl FROM rk GROUP BY 1"))
def l11(spark, sf):
    return L.monthly_allocation(daily(spark, sf), "strategy", 60, 2)


@query("l11_random_allocation", "month:t random_pnl:f")
def l11r(spark, sf):
    return L.monthly_allocation(daily(spark, sf), "strategy", 60, 2)


@query("l12_peak_concurrency", "pair:i peak:i",
       with_sql(LEDGER_SQL, "e AS (SELECT pair, entry_time AS t, 0 AS o, 1 AS d FROM ledger UNION ALL SELECT pair, exit_time, 1, -1 FROM ledger)", "n AS (SELECT pair, t, o, sum(d) AS d FROM e GROUP BY 1, 2, 3)",
                body="SELECT pair, max(c) AS peak FROM (SELECT pair, sum(d) OVER (PARTITION BY pair ORDER BY t, o) AS c FROM n) GROUP BY 1"))
def l12(spark, sf):
    return L.peak_concurrency(ledger(spark, sf), "pair", "entry_time", "exit_time")


@query("l13_occupancy", "pair:i slots_used:i mean_stack:f max_stack:i novel_share:f",
       with_sql(LEDGER_SQL, "x AS (SELECT pair, unnest(generate_series(entry_time, exit_time, INTERVAL 1 DAY)) AS d FROM ledger)", "p AS (SELECT pair, d, count(*) AS n FROM x GROUP BY 1, 2)",
                "g AS (SELECT pair, entry_time AS t, max(exit_time) AS e, count(*) AS n FROM ledger GROUP BY 1, 2)", "o AS (SELECT *, max(e) OVER (PARTITION BY pair ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM g)",
                body="SELECT a.*, novel_share FROM (SELECT pair, count(*) AS slots_used, avg(n) AS mean_stack, max(n) AS max_stack FROM p GROUP BY 1) a JOIN (SELECT pair, sum((u IS NULL OR u < t)::INT) / sum(n) AS novel_share FROM o GROUP BY 1) b USING (pair)"))
def l13(spark, sf):
    return L.occupancy(ledger(spark, sf), "pair", "entry_time", "exit_time")


@query("l14_book_correlation", "a:s b:s corr:f",
       with_sql(LEDGER_SQL, DAILY_SQL, "w AS (SELECT day, " + ", ".join(f"coalesce(sum(pnl) FILTER (WHERE strategy = '{s}'), 0) AS b{i}" for i, s in enumerate(STRATS)) + " FROM dc GROUP BY 1)",
                body=" UNION ALL ".join(f"SELECT '{STRATS[i]}' AS a, '{STRATS[j]}' AS b, corr(b{i}, b{j}) AS corr FROM w" for i in range(5) for j in range(i + 1, 5))))
def l14(spark, sf):
    return L.book_correlation(daily(spark, sf), "strategy", STRATS)




@query("l15_excursion_ratios", "l_orderkey:i l_linenumber:i capture_ratio:f pnl_over_mae:f",
       with_sql("ex AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (l_discount - l_tax) AS pnl, l_extendedprice * (l_discount + 0.02) AS mfe, -l_extendedprice * (l_tax + 0.01) AS mae FROM lineitem)",
                body="SELECT l_orderkey, l_linenumber, pnl / mfe AS capture_ratio, pnl / -mae AS pnl_over_mae FROM ex"))
def l15(spark, sf):
    p = F.col("l_extendedprice")
    d = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (p * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"), (p * (F.col("l_discount") + 0.02)).alias("mfe"), (-p * (F.col("l_tax") + 0.01)).alias("mae"))
    return L.excursion_ratios(d, "pnl", "mfe", "mae")


MARK_SQL = """
tr AS (SELECT user_id AS k, event_type AS series_id, ts AS entry_at, ts + INTERVAL 20 HOUR AS exit_at, value AS entry_price, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, value * 0.1 - 2 AS pnl FROM events),
qb AS (SELECT series_id, ts, close - 0.1 AS bid_c, close + 0.1 AS ask_c FROM bars)"""


@query("l16_floating_equity", "ts:t floating:f realised:f n_open:i equity:f",
       with_sql(HOURLY_SQL, MARK_SQL, "m AS (SELECT q.ts, sum(CASE WHEN side > 0 THEN bid_c - entry_price ELSE entry_price - ask_c END) AS fl, count(*) AS n FROM tr JOIN qb q ON tr.series_id = q.series_id AND q.ts >= entry_at AND q.ts < exit_at GROUP BY 1)",
                "r AS (SELECT exit_at, sum(p) OVER (ORDER BY exit_at) AS re FROM (SELECT exit_at, sum(pnl) AS p FROM tr GROUP BY 1))", "t AS (SELECT DISTINCT ts FROM qb)",
                body="SELECT t.ts, coalesce(fl, 0) AS floating, coalesce(re, 0) AS realised, coalesce(n, 0) AS n_open, coalesce(fl, 0) + coalesce(re, 0) AS equity FROM t ASOF LEFT JOIN r ON t.ts >= r.exit_at LEFT JOIN m ON m.ts = t.ts"))
def l16(spark, sf):
    e = read_table(spark, sf, "events")
    tr = e.select(F.col("event_type").alias("series_id"), F.col("ts").alias("entry_at"), F.timestamp_micros(F.unix_micros("ts") + 20 * HOUR_US).alias("exit_at"),
                  F.col("value").alias("entry_price"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("side"), (F.col("value") * 0.1 - 2).alias("pnl"))
    bars = hourly(spark, sf).select("series_id", "ts", (F.col("close") - 0.1).alias("bid_c"), (F.col("close") + 0.1).alias("ask_c"))
    return L.floating_equity(tr, bars, "series_id", "entry_at", "exit_at", 20 * HOUR_US)


@query("l17_financing", "l_orderkey:i l_linenumber:i pair:i exit_time:t financing:f n_rollovers:i",
       with_sql(LEDGER_SQL, "rates AS (SELECT date_trunc('year', o_orderdate) AS available_at, round(avg(o_totalprice) / 1e7, 8) AS rate FROM orders GROUP BY 1)",
                "led AS (SELECT * FROM ledger)",
                "x AS (SELECT l_orderkey, l_linenumber, pair, units, entry_time, exit_time, unnest(generate_series(date_trunc('day', entry_time) - INTERVAL 1 DAY, exit_time, INTERVAL 1 DAY)) AS d FROM led)",
                "r AS (SELECT *, ((d + INTERVAL 17 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS roll FROM x)", "y AS (SELECT * FROM r WHERE roll > entry_time AND roll <= exit_time)",
                "z AS (SELECT y.*, rate / 365.0 * CASE isodow(d) WHEN 3 THEN 3 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 1 END AS c FROM y ASOF LEFT JOIN rates ON y.roll >= available_at)",
                body="SELECT led.l_orderkey, led.l_linenumber, led.pair, led.exit_time, coalesce(sum(z.units * c), 0) AS financing, count(z.roll) AS n_rollovers FROM led LEFT JOIN z USING (l_orderkey, l_linenumber, pair, exit_time) GROUP BY 1, 2, 3, 4"))
def l17(spark, sf):
    rates = read_table(spark, sf, "orders").groupBy(F.date_trunc("year", "o_orderdate").alias("available_at")).agg(F.round(F.avg("o_totalprice") / 1e7, 8).alias("rate"))
    return L.financing(ledger(spark, sf), rates, ["l_orderkey", "l_linenumber", "pair", "exit_time"], "entry_time", "exit_time", "units")


@query("l18_reprice", "strategy:s scenario:s n:i net:f",
       with_sql(LEDGER_SQL, body="SELECT strategy, scenario, count(*) AS n, sum(pnl) - cost * sum(units) AS net FROM ledger CROSS JOIN (VALUES ('low', 1.0), ('mid', 2.5), ('high', 6.0)) s(scenario, cost) GROUP BY strategy, scenario, cost"))
def l18(spark, sf):
    return L.reprice(ledger(spark, sf), [{"name": "low", "cost": 1.0}, {"name": "mid", "cost": 2.5}, {"name": "high", "cost": 6.0}], F.col("units"), "strategy")


@query("l19_reconcile", "l_orderkey:i l_linenumber:i status:s value:f",
       """WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem WHERE l_linenumber <> 7), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_extendedprice + 1 ELSE l_extendedprice END AS v FROM lineitem WHERE l_linenumber <> 6)
       SELECT l_orderkey, l_linenumber, CASE WHEN b.v IS NULL THEN 'only_a' WHEN a.v IS NULL THEN 'only_b' WHEN abs(a.v - b.v) > 1e-9 THEN 'changed' ELSE 'same' END AS status, coalesce(a.v, b.v) AS "value" FROM a FULL JOIN b USING (l_orderkey, l_linenumber)""")
def l19(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("v"))
    b = li.filter("l_linenumber <> 6").withColumn("v", F.when(F.col("l_returnflag") == "R", F.col("v") + 1).otherwise(F.col("v")))
    return L.reconcile(li.filter("l_linenumber <> 7"), b, ["l_orderkey", "l_linenumber"], "v")


@query("l20_compare_portfolios", "kind:s rep:i mean:f std:f ratio:f")
def l20(spark, sf):
    return L.compare_portfolios(daily(spark, sf), "strategy", STRATS, 50)


@query("l21_risk_ratios", "strategy:s n:i ann_return:f ann_vol:f sharpe:f sortino:f max_drawdown:f calmar:f win_share:f best:f worst:f",
       with_sql(LEDGER_SQL, DAILY_SQL, "p AS (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY day) AS pk FROM dc)",
                "g AS (SELECT strategy, count(*) AS n, avg(pnl) * 252 AS ann_return, stddev_samp(pnl) * sqrt(252) AS ann_vol, sqrt(avg(pow(least(pnl, 0), 2))) AS dn, min(equity - greatest(pk, 0)) AS max_drawdown, avg((pnl > 0)::INT) AS win_share, max(pnl) AS best, min(pnl) AS worst FROM p GROUP BY 1)",
                body="SELECT *, ann_return / ann_vol AS sharpe, ann_return / (dn * sqrt(252)) AS sortino, ann_return / -max_drawdown AS calmar FROM g"))
def l21(spark, sf):
    return L.risk_ratios(daily(spark, sf), "strategy")


@query("l22_holding_times", "strategy:s bucket:s n:i pct:f",
       with_sql(LEDGER_SQL, "b AS (SELECT strategy, CASE WHEN d <= 30 THEN 'month' WHEN d <= 180 THEN 'half year' WHEN d <= 720 THEN 'two years' ELSE 'longer' END AS bucket FROM (SELECT strategy, date_diff('day', entry_time, exit_time) AS d FROM ledger))",
                body="SELECT strategy, bucket, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY strategy) AS pct FROM b GROUP BY 1, 2"))
def l22(spark, sf):
    days = (F.unix_micros("exit_time") - F.unix_micros("entry_time")) / float(DAY_US)
    return L.holding_times(ledger(spark, sf), "strategy", days, [30.0, 180.0, 720.0], ["month", "half year", "two years", "longer"])
