"""Statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.inputs import HOURLY_SQL, LEDGER_SQL, TICKS_SQL, hourly, hourly_series, ledger, with_sql
from barline.catalog.joins import BRIDGE_SQL, nation_pairs
from barline.catalog.registry import query
from barline.functions.clock import DAY_US, hour_of_week
from barline.operators import stats as T
from barline.operators.indicators import with_indicators
from barline.operators.outcomes import first_passage, forward_return
from barline.plans.bijection import permuted_sql
from barline.plans.quantiles import group_quantiles
from barline.sources.sinks import materialize

SIG_SQL = """
sig AS (SELECT series_id, ts, rn, close - lag(close, 3) OVER w AS s, lead(close, 2) OVER w - close AS y FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
ok AS (SELECT * FROM sig WHERE s IS NOT NULL AND y IS NOT NULL)"""


def signal(spark, sf):
    s = hourly_series(spark, sf)
    return s.columns(lambda fr: {"s": F.col("close") - F.lag("close", 3).over(fr.w()), "y": F.lead("close", 2).over(fr.w()) - F.col("close")}, back_rows=3, fwd_rows=2)


T_SQL = "ic * sqrt((n - 2) / (1 - ic * ic)) AS t_stat"


@query("t01_ic_pearson", "series_id:s ic:f n:i t_stat:f", with_sql(HOURLY_SQL, SIG_SQL, body=f"SELECT *, {T_SQL} FROM (SELECT series_id, corr(s, y) AS ic, count(*) AS n FROM ok GROUP BY 1)"))
def t01(spark, sf):
    return T.ic(signal(spark, sf), "s", "y", "pearson", "series_id")


@query("t01_ic_spearman", "ic:f n:i t_stat:f",
       with_sql(HOURLY_SQL, SIG_SQL, "r AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM ok)",
                body=f"SELECT *, {T_SQL} FROM (SELECT corr(a, b) AS ic, count(*) AS n FROM r)"))
def t01s(spark, sf):
    return T.ic(signal(spark, sf), "s", "y", "spearman")


@query("t02_newey_west", "series_id:s n:i mean:f t_stat:f",
       with_sql(HOURLY_SQL, "x AS (SELECT series_id, rn, close - open AS x, (close - open) - avg(close - open) OVER (PARTITION BY series_id) AS e FROM bars)", "l AS (SELECT series_id, x, e, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM x WINDOW w AS (PARTITION BY series_id ORDER BY rn))",
                body="SELECT series_id, count(*) AS n, avg(x) AS mean, avg(x) / sqrt((sum(e * e) + 2 * (0.75 * sum(e * e1) + 0.5 * sum(e * e2) + 0.25 * sum(e * e3))) / count(*) / count(*)) AS t_stat FROM l GROUP BY 1"))
def t02(spark, sf):
    s = hourly_series(spark, sf)
    return T.newey_west_t(s.with_df(s.df.withColumn("x", F.col("close") - F.col("open"))), "x", 3)


@query("t03_block_ic", "n_blocks:i mean_ic:f t_stat:f",
       with_sql(HOURLY_SQL, SIG_SQL, "b AS (SELECT date_trunc('day', ts) AS d, corr(s, y) AS ic FROM ok GROUP BY 1 HAVING count(*) >= 3)", body="SELECT count(*) AS n_blocks, avg(ic) AS mean_ic, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_stat FROM b"))
def t03(spark, sf):
    d = signal(spark, sf).filter("s IS NOT NULL AND y IS NOT NULL")
    return T.block_ic(d, "s", "y", F.date_trunc("day", "ts"))


@query("t04_sign_flip", "series_id:s mean:f n:i p_value:f")
def t04(spark, sf):
    d = hourly(spark, sf).withColumn("x", F.col("close") - F.col("open"))
    return T.sign_flip_p(d, "x", ["series_id", "ts"], 512, 11, "series_id")


def pairs_panel(spark, sf):
    """Monthly pair panel with next month's change as outcome."""
    from barline.plans.series import Series

    p = materialize(nation_pairs(spark, sf), "nation-pairs")
    return Series(p, "pair", ["ts"]).columns(lambda fr: {"y": F.lead("x").over(fr.w()) - F.col("x")}, fwd_rows=1).filter("y IS NOT NULL")


PERMUTED = "real:f null_mean:f n:i p_value:f"


def permutation_sql(rows: str, group: str, member: str, reps: int, beyond: str) -> str:
    """``rows`` has columns x and y; slots are permuted in each group and replicate."""
    slots = f"(SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {member}) - 1 AS slot, count(*) OVER (PARTITION BY {group}) AS size FROM {rows})"
    drawn = permuted_sql(f"(SELECT *, unnest(range({reps})) AS rep FROM {slots})", "slot", "size", f"('7|' || rep || '|' || {group})", 6)
    return f"""null0 AS (SELECT d.rep, corr(s.x, d.y) AS chance FROM {drawn} d JOIN {slots} s ON d.{group} = s.{group} AND d.partner = s.slot GROUP BY 1),
      real0 AS (SELECT corr(x, y) AS real FROM {rows})
      SELECT any_value(real) AS real, avg(chance) AS null_mean, count(*) AS n, (count(*) FILTER (WHERE {beyond}) + 1) / (count(*) + 1) AS p_value FROM null0, real0"""


PANEL_SQL = """panel AS (SELECT *, CAST(CAST(ts AS TIMESTAMP) AS VARCHAR) AS month, c * 100 + s AS pair, lead(x) OVER (PARTITION BY c, s ORDER BY ts) - x AS y FROM daily),
    rows0 AS (SELECT * FROM panel WHERE y IS NOT NULL)"""


@query("t05_permutation_entities", PERMUTED, with_sql(BRIDGE_SQL, PANEL_SQL, body="," + permutation_sql("rows0", "month", "pair", 20, "chance >= real")))
def t05(spark, sf):
    return T.permutation_p(pairs_panel(spark, sf), "pair", "ts", "x", F.corr("x_perm", "y"), "entities", 20)


@query("t05_permutation_time", PERMUTED, with_sql(HOURLY_SQL, SIG_SQL, "rows0 AS (SELECT series_id, ts, s AS x, y FROM ok)", body="," + permutation_sql("rows0", "series_id", "ts", 40, "abs(chance) >= abs(real)")))
def t05t(spark, sf):
    d = signal(spark, sf).filter("s IS NOT NULL AND y IS NOT NULL")
    return T.permutation_p(d, "series_id", "ts", "s", F.corr("x_perm", "y"), "time", 40, tail="both")


@query("t05_permutation_blocks", "real:f null_mean:f n:i p_value:f")
def t05b(spark, sf):
    d = signal(spark, sf).filter("s IS NOT NULL AND y IS NOT NULL")
    return T.permutation_p(d, "series_id", "ts", "s", F.corr("x_perm", "y"), "blocks", 20, block_us=2 * DAY_US)


@query("t06_block_bootstrap", "lo:f mid:f hi:f n_reps:i real:f")
def t06(spark, sf):
    s = hourly_series(spark, sf)
    d = s.df.groupBy("ts").agg(F.avg(F.col("close") - F.col("open")).alias("x"))
    from barline.plans.series import Series

    return T.block_bootstrap(Series(d, None, ["ts"]), "x", 24, 1000, "sharpe")


@query("t07_group_bootstrap", "lo:f mid:f hi:f n_reps:i")
def t07(spark, sf):
    return T.group_bootstrap(ledger(spark, sf), "pnl", F.date_trunc("week", "exit_time"), 200)


@query("t08_folds", "l_orderkey:i l_linenumber:i fold:i split:s",
       with_sql(LEDGER_SQL, body="SELECT l_orderkey, l_linenumber, ntile(5) OVER w AS fold, CASE WHEN row_number() OVER w <= floor(count(*) OVER () * 0.7) THEN 'IS' ELSE 'OOS' END AS split FROM ledger WINDOW w AS (ORDER BY exit_time, l_orderkey, l_linenumber)"))
def t08(spark, sf):
    led = ledger(spark, sf).select("l_orderkey", "l_linenumber", "exit_time")
    order = ["exit_time", "l_orderkey", "l_linenumber"]
    return T.is_oos(T.folds(led, order, 5), order, 0.7)


@query("t09_purged_folds", "fold:i role:s n:i",
       with_sql(TICKS_SQL, "s AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM ticks)", "f AS (SELECT k, a + (b - a + 1) / 5.0 * k AS lo, (b - a + 1) / 5.0 AS w FROM s, range(1, 5) t(k))",
                body="SELECT k AS fold, CASE WHEN epoch_us(ts) >= lo AND epoch_us(ts) < lo + w THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM ticks, f WHERE (epoch_us(ts) >= lo AND epoch_us(ts) < lo + w) OR epoch_us(ts) < lo - 86400000000 GROUP BY 1, 2"))
def t09(spark, sf):
    from barline.catalog.inputs import ticks

    return T.purged_folds(ticks(spark, sf), "ts", 4, DAY_US).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("t10_drop_one", "dropped:i n:i mean:f std:f",
       with_sql(LEDGER_SQL, "y AS (SELECT DISTINCT year(exit_time) AS dropped FROM ledger)", body="SELECT dropped, count(*) AS n, avg(pnl) AS mean, stddev_samp(pnl) AS std FROM y JOIN ledger ON year(exit_time) <> dropped GROUP BY 1"))
def t10(spark, sf):
    return T.drop_one(ledger(spark, sf), F.year("exit_time"), "pnl")


@query("t11_gate_table", "gate:s value:f passed:b",
       with_sql(LEDGER_SQL, body="""SELECT 'n_trades' AS gate, count(*) AS "value", count(*) >= 1000 AS passed FROM ledger UNION ALL SELECT 'mean', avg(pnl), avg(pnl) > 0 FROM ledger
         UNION ALL SELECT 'win_rate', avg((pnl > 0)::INT), avg((pnl > 0)::INT) > 0.6 FROM ledger UNION ALL SELECT 'worst_year', min(m), min(m) > 0 FROM (SELECT avg(pnl) AS m FROM ledger GROUP BY year(exit_time))"""))
def t11(spark, sf):
    led = ledger(spark, sf)
    one = led.agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("mean"), F.avg((F.col("pnl") > 0).cast("double")).alias("wr"))
    yearly = led.groupBy(F.year("exit_time")).agg(F.avg("pnl").alias("m")).agg(F.min("m").alias("worst"))
    return T.gate_table(spark, {"n_trades": (one, "n", lambda c: c >= 1000), "mean": (one, "mean", lambda c: c > 0), "win_rate": (one, "wr", lambda c: c > 0.6), "worst_year": (yearly, "worst", lambda c: c > 0)})


@query("t12_pinball_climatology", "series_id:s q_loss:f flat_loss:f n:i",
       with_sql(HOURLY_SQL, "x AS (SELECT series_id, ts, hour(ts) AS h, high - low AS y FROM bars)", "c AS (SELECT series_id, h, quantile_cont(y, 0.9) AS q FROM x WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2)", "g AS (SELECT series_id, quantile_cont(y, 0.9) AS q FROM x WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)",
                body="SELECT x.series_id, avg(greatest(0.9 * (y - c.q), -0.1 * (y - c.q))) AS q_loss, avg(greatest(0.9 * (y - g.q), -0.1 * (y - g.q))) AS flat_loss, count(*) AS n FROM x JOIN c USING (series_id, h) JOIN g ON g.series_id = x.series_id WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1"))
def t12(spark, sf):
    x = hourly(spark, sf).select("series_id", "ts", F.hour("ts").alias("h"), (F.col("high") - F.col("low")).alias("y"))
    train, test = x.filter(F.col("ts") < "2024-01-20"), x.filter(F.col("ts") >= "2024-01-20")
    clim = T.climatology(train, ["series_id", "h"], "y", 0.9, "q")
    flat = T.climatology(train, ["series_id"], "y", 0.9, "flat")
    j = test.join(clim, ["series_id", "h"]).join(flat, "series_id")
    return j.groupBy("series_id").agg(F.avg(T.pinball(F.col("y"), F.col("q"), 0.9)).alias("q_loss"), F.avg(T.pinball(F.col("y"), F.col("flat"), 0.9)).alias("flat_loss"), F.count(F.lit(1)).alias("n"))


@query("t13_break_even", "series_id:s n:i hits:i p_star:f p_hat:f z:f p_value:f")
def t13(spark, sf):
    from barline.catalog.events import wide_events
    from barline.functions.clock import HOUR_US

    ev, h = wide_events(spark, sf)
    lab = first_passage(ev, h, "series_id", 60.0, 40.0, 24 * HOUR_US, ["event_bar"])
    return T.break_even(lab, "series_id", 60.0, 40.0, 1.0)


@query("t14_causality_check", "series_id:s ts:t sma:f rsi:f",
       "SELECT NULL AS series_id, NULL AS ts, NULL AS sma, NULL AS rsi WHERE false")
def t14(spark, sf):
    from barline.plans.series import Series

    def op(df):
        return with_indicators(Series(df, "series_id", ["ts"], 200_000), ["sma", "rsi"]).select("series_id", "ts", "sma", F.round("rsi", 9).alias("rsi"))

    return T.check_causal(op, hourly(spark, sf), "ts", F.lit("2024-01-18").cast("timestamp"))


@query("t15_equity_paths", "final_p25:f final_p50:f final_p75:f dd_p25:f dd_p50:f dd_p75:f n_reps:i")
def t15(spark, sf):
    return T.equity_paths(ledger(spark, sf), "pnl", ["exit_time", "l_orderkey", "l_linenumber"], 100, 250)


@query("t16_select_confirm", "pair:i strategy:s is_score:f oos_score:f",
       with_sql(LEDGER_SQL, "r AS (SELECT pair, strategy, CASE WHEN exit_time < TIMESTAMP '2001-01-01' THEN 'IS' ELSE 'OOS' END AS split, avg(pnl) AS m FROM ledger GROUP BY 1, 2, 3)",
                "b AS (SELECT pair, arg_max(strategy, (m, strategy)) AS strategy, max(m) AS is_score FROM r WHERE split = 'IS' GROUP BY 1)", body="SELECT b.pair, b.strategy, is_score, m AS oos_score FROM b LEFT JOIN (SELECT * FROM r WHERE split = 'OOS') o ON o.pair = b.pair AND o.strategy = b.strategy"))
def t16(spark, sf):
    led = ledger(spark, sf).withColumn("split", F.when(F.col("exit_time") < "2001-01-01", "IS").otherwise("OOS"))
    r = led.groupBy("pair", "strategy", "split").agg(F.avg("pnl").alias("m"))
    return T.select_then_confirm(r, ["pair"], ["strategy"], "m")


@query("t17_forward_cost_by_hour", "how:i p50:f n:i",
       with_sql(HOURLY_SQL, "f AS (SELECT (isodow(ts) - 1) * 24 + hour(ts) AS how, lead(close, 3) OVER (PARTITION BY series_id ORDER BY ts) - close - 0.2 AS f FROM bars)", body="SELECT how, quantile_cont(f, 0.5) AS p50, count(*) AS n FROM f WHERE f IS NOT NULL GROUP BY 1"))
def t17(spark, sf):
    d = forward_return(hourly_series(spark, sf), 3, 0.2).withColumn("how", hour_of_week("ts"))
    return group_quantiles(d, "how", "fwd_3", {"p50": 0.5}, "n")
