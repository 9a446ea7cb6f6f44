"""Aggregations (A1-A21) and sorts, limits, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.inputs import HOURLY_SQL, LEDGER_SQL, TICKS_SQL, hourly, hourly_series, ledger, ticks, with_sql
from barline.catalog.registry import query
from barline.functions.clock import hour_of_week
from barline.operators import aggregates as A
from barline.operators import ordering as O
from barline.operators import sketches as S
from barline.sources.readers import read_table
from barline.sources.sinks import materialize

HOW = "(isodow(ts) - 1) * 24 + hour(ts)"


@query("a01_ledger_summary", "label:s strategy:s n:i total:f wins:i win_rate:f",
       with_sql(LEDGER_SQL, body="SELECT label, strategy, count(*) AS n, sum(pnl) AS total, count(*) FILTER (WHERE pnl > 0) AS wins, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM ledger GROUP BY 1, 2"))
def a01(spark, sf):
    return A.ledger_summary(ledger(spark, sf), ["label", "strategy"])


@query("a02_perf_stats", "strategy:s n:i win_rate:f profit_factor:f avg_win:f avg_loss:f per_day:f",
       with_sql(LEDGER_SQL, body="""SELECT strategy, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate,
         sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0) AS profit_factor, avg(pnl) FILTER (WHERE pnl > 0) AS avg_win,
         avg(pnl) FILTER (WHERE pnl < 0) AS avg_loss, count(*) / count(DISTINCT exit_time::DATE) AS per_day FROM ledger GROUP BY 1"""))
def a02(spark, sf):
    return A.perf_stats(ledger(spark, sf), "strategy")


@query("a03_bucket_quantiles", "series_id:s how:i p25:f p50:f p75:f n:i",
       with_sql(TICKS_SQL, body=f"""SELECT event_type AS series_id, {HOW} AS how, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS p50,
         quantile_cont(price, 0.75) AS p75, count(*) AS n FROM ticks GROUP BY 1, 2"""))
def a03(spark, sf):
    t = ticks(spark, sf, "event_type").withColumn("how", hour_of_week("ts"))
    return A.bucket_quantiles(t, ["series_id", "how"], "price", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, "n")


@query("a04_distinct", "event_type:s n_users:i", "SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def a04(spark, sf):
    return read_table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))


@query("a03_sketch_rollup", "series_id:s n:i near25:b near50:b near99:b",
       with_sql(TICKS_SQL, body="SELECT event_type AS series_id, count(*) AS n, true AS near25, true AS near50, true AS near99 FROM ticks GROUP BY 1 UNION ALL SELECT 'all', count(*), true, true, true FROM ticks"))
def a03s(spark, sf):
    """Quantiles of stored day sketches, merged; each has its rank within 3 % of the exact one."""
    t = ticks(spark, sf, "event_type")
    stored = materialize(S.build(t.withColumn("day", F.to_date("ts")), ["series_id", "day"], ["price"]), "day-sketches")
    ps = {"25": 0.25, "50": 0.5, "99": 0.99}
    est = S.read(S.roll_up(stored, "series_id").unionByName(S.roll_up(stored).withColumn("series_id", F.lit("all"))), {f"q{n}": ("price", p) for n, p in ps.items()})
    rows = t.select("series_id", "price").withColumn("series_id", F.explode(F.array("series_id", F.lit("all"))))
    share = lambda n, p: (F.abs(F.avg((F.col("price") <= F.col(f"q{n}")).cast("double")) - p) < 0.03).alias(f"near{n}")
    return rows.join(est, "series_id").groupBy("series_id", "n").agg(*[share(n, p) for n, p in ps.items()])


@query("a04_sketch_distinct", "event_type:s n_users:i near:b",
       "SELECT event_type, count(DISTINCT user_id) AS n_users, true AS near FROM events GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT user_id), true FROM events")
def a04s(spark, sf):
    """Distinct users of stored day sketches, merged; each within 5 % of the exact count."""
    e = read_table(spark, sf, "events")
    stored = materialize(S.build(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], distinct_of=["user_id"]), "day-sketches")
    est = S.read(S.roll_up(stored, "event_type").unionByName(S.roll_up(stored).withColumn("event_type", F.lit("all"))), distinct={"about": "user_id"})
    exact = e.select("user_id", F.explode(F.array("event_type", F.lit("all"))).alias("event_type")).groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))
    return exact.join(est, "event_type").withColumn("near", F.abs(F.col("about") / F.col("n_users") - 1) < 0.05)


@query("a05_last_by", "series_id:i day:t last_price:f",
       with_sql(TICKS_SQL, body="SELECT series_id, date_trunc('day', ts) AS day, last(price ORDER BY ts, tie) AS last_price FROM ticks GROUP BY 1, 2"))
def a05(spark, sf):
    t = ticks(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    return A.last_by(t, ["series_id", "day"], "price", ["ts", "tie"], "last_price")


@query("a06_filtered_avg", "series_id:i avg_click:f avg_rest:f",
       with_sql(TICKS_SQL, body="SELECT series_id, avg(price) FILTER (WHERE event_type = 'click') AS avg_click, avg(price) FILTER (WHERE event_type <> 'click') AS avg_rest FROM ticks GROUP BY 1"))
def a06(spark, sf):
    click = F.col("event_type") == "click"
    return ticks(spark, sf).groupBy("series_id").agg(
        A.avg_if(click, F.col("price")).alias("avg_click"), A.avg_if(~click, F.col("price")).alias("avg_rest"))


@query("a07_histogram", "bin:i n:i lower:f",
       with_sql(TICKS_SQL, body="""SELECT least(CAST(floor(price / c * 20) AS BIGINT), 19) AS bin, count(*) AS n, max(c) / 20 * least(CAST(floor(price / c * 20) AS BIGINT), 19) AS lower
         FROM ticks CROSS JOIN (SELECT quantile_cont(price, 0.99) AS c FROM ticks) GROUP BY 1"""))
def a07(spark, sf):
    return A.histogram(ticks(spark, sf), "price", 20, 0.99)


QUINT_SQL = """
q AS (SELECT series_id, quantile_cont(x, 0.2) AS q1, quantile_cont(x, 0.4) AS q2, quantile_cont(x, 0.6) AS q3, quantile_cont(x, 0.8) AS q4 FROM feat GROUP BY 1),
lab AS (SELECT f.*, (x > q1)::INT + (x > q2)::INT + (x > q3)::INT + (x > q4)::INT AS quint FROM feat f JOIN q USING (series_id))"""
FEAT_SQL = """
feat AS (SELECT series_id, ts, high - low AS x, close - open AS body, volume FROM bars)"""


@query("a08_quantile_bucket", "series_id:s ts:t quint:i",
       with_sql(HOURLY_SQL, FEAT_SQL, QUINT_SQL, body="SELECT series_id, ts, quint FROM lab"))
def a08(spark, sf):
    f = hourly(spark, sf).withColumn("x", F.col("high") - F.col("low"))
    return A.quantile_bucket(f, "series_id", "x", 5, "quint")


@query("a09_labelled_cut", "event_id:i size:s",
       "SELECT event_id, CASE WHEN value <= 10 THEN 'small' WHEN value <= 50 THEN 'medium' WHEN value <= 150 THEN 'large' ELSE 'huge' END AS size FROM events")
def a09(spark, sf):
    return read_table(spark, sf, "events").select("event_id", A.cut(F.col("value"), [10.0, 50.0, 150.0], ["small", "medium", "large", "huge"]).alias("size"))


@query("a10_grid_mean", "quint:i sz:i mean:f n:i n_positive:i",
       with_sql(HOURLY_SQL, FEAT_SQL, QUINT_SQL, body="""SELECT quint, sz, sum(s) / sum(n) AS mean, sum(n) AS n, count(*) FILTER (WHERE s > 0) AS n_positive FROM
         (SELECT quint, CASE WHEN volume > 150 THEN 1 ELSE 0 END AS sz, series_id, sum(body) AS s, count(body) AS n FROM lab GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def a10(spark, sf):
    f = hourly(spark, sf).withColumn("x", F.col("high") - F.col("low")).withColumn("body", F.col("close") - F.col("open"))
    f = A.quantile_bucket(f, "series_id", "x", 5, "quint").withColumn("sz", (F.col("volume") > 150).cast("int"))
    return A.grid_mean(f, "quint", "sz", "body", "series_id")


@query("a11_crosstab_pct", "strategy:s label:s n:i pct:f",
       with_sql(LEDGER_SQL, body="SELECT strategy, label, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY strategy) AS pct FROM ledger GROUP BY 1, 2"))
def a11(spark, sf):
    return A.crosstab_pct(ledger(spark, sf), "strategy", "label")


@query("a12_pivot", "pair:i A:f N:f R:f",
       with_sql(LEDGER_SQL, body="SELECT pair, sum(pnl) FILTER (WHERE label = 'A') AS \"A\", sum(pnl) FILTER (WHERE label = 'N') AS \"N\", sum(pnl) FILTER (WHERE label = 'R') AS \"R\" FROM ledger GROUP BY 1"))
def a12(spark, sf):
    return ledger(spark, sf).groupBy("pair").pivot("label", ["A", "N", "R"]).agg(F.sum("pnl"))


@query("a13_unpivot", "series_id:s ts:t field:s value:f",
       with_sql(HOURLY_SQL, body="SELECT series_id, ts, field, value FROM (SELECT series_id, ts, open, high, low, close FROM bars) UNPIVOT (value FOR field IN (open, high, low, close))"))
def a13(spark, sf):
    return hourly(spark, sf).unpivot(["series_id", "ts"], ["open", "high", "low", "close"], "field", "value")


@query("a14_rollup", "label:s strategy:s level:i n:i total:f",
       with_sql(LEDGER_SQL, body="SELECT label, strategy, grouping(label, strategy) AS level, count(*) AS n, sum(pnl) AS total FROM ledger GROUP BY ROLLUP (label, strategy)"))
def a14(spark, sf):
    return A.rollup_stats(ledger(spark, sf), ["label", "strategy"], [F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total")])


@query("a15_moments", "event_type:s n:i mean:f std_pop:f std:f skew:f lo:f hi:f",
       """SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std_pop, stddev_samp(value) AS std,
          (avg(value^3) - 3 * avg(value) * avg(value^2) + 2 * avg(value)^3) / stddev_pop(value)^3 AS skew, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1""")
def a15(spark, sf):
    return A.describe_by(read_table(spark, sf, "events"), "event_type", "value")


@query("a16_daily_matrix", "strategy:s day:t v:f",
       with_sql(LEDGER_SQL, """d AS (SELECT strategy, exit_time::DATE AS day, sum(pnl) AS v FROM ledger GROUP BY 1, 2),
         c AS (SELECT strategy, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY 1)""",
       body="SELECT c.strategy, c.day, coalesce(v, 0) AS v FROM c LEFT JOIN d USING (strategy, day)"))
def a16(spark, sf):
    return A.daily_matrix(ledger(spark, sf), "strategy", "exit_time", "pnl")


@query("a17_weighted_mean", "user_id:i wmean:f",
       """SELECT user_id, sum(w * value) / sum(w) AS wmean FROM (SELECT user_id, CASE WHEN value > 1 THEN value END AS value,
          CASE WHEN value > 1 THEN CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 WHEN 'purchase' THEN 2.0 END END AS w FROM events) GROUP BY 1""")
def a17(spark, sf):
    e = read_table(spark, sf, "events").withColumn("v", F.when(F.col("value") > 1, F.col("value")))
    return A.weighted_mean(e, "user_id", {"click": 1.0, "view": 0.5, "purchase": 2.0}, "event_type", "v", "wmean")


@query("a18_frame_votes", "series_id:s ts:t sma200:i base_line:i vwma:i hull:i stochastic:i awesome:i momentum:i williams_r:i ultimate:i",
       with_sql(HOURLY_SQL, """k0 AS (SELECT *, lag(close) OVER w AS pc, lag(close, 10) OVER w AS c10, avg(close) OVER w200 AS s200, (max(high) OVER w26 + min(low) OVER w26) / 2 AS base,
         sum(close * volume) OVER w20 / nullif(sum(volume) OVER w20, 0) AS vw, max(high) OVER w14 AS hi14, min(low) OVER w14 AS lo14,
         avg((high + low) / 2) OVER w5 - avg((high + low) / 2) OVER w34 AS ao FROM bars
         WINDOW w AS (PARTITION BY series_id ORDER BY ts), w5 AS (PARTITION BY series_id ORDER BY ts ROWS 4 PRECEDING), w14 AS (PARTITION BY series_id ORDER BY ts ROWS 13 PRECEDING),
         w20 AS (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING), w26 AS (PARTITION BY series_id ORDER BY ts ROWS 25 PRECEDING),
         w34 AS (PARTITION BY series_id ORDER BY ts ROWS 33 PRECEDING), w200 AS (PARTITION BY series_id ORDER BY ts ROWS 199 PRECEDING))""",
         """k1 AS (SELECT *, CASE WHEN rn >= 14 THEN CASE WHEN hi14 > lo14 THEN 100 * (close - lo14) / (hi14 - lo14) ELSE 50 END END AS raw,
         CASE WHEN rn >= 14 THEN CASE WHEN hi14 > lo14 THEN -100 * (hi14 - close) / (hi14 - lo14) ELSE 0 END END AS wr,
         close - c10 AS mom, CASE WHEN rn >= 34 THEN ao END AS aw, CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END AS bp, CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END AS tr,
         CASE WHEN rn >= 9 THEN 2 * (4 * close + 3 * lag(close, 1) OVER w + 2 * lag(close, 2) OVER w + lag(close, 3) OVER w) / 10
           - (9 * close + 8 * lag(close, 1) OVER w + 7 * lag(close, 2) OVER w + 6 * lag(close, 3) OVER w + 5 * lag(close, 4) OVER w + 4 * lag(close, 5) OVER w + 3 * lag(close, 6) OVER w + 2 * lag(close, 7) OVER w + lag(close, 8) OVER w) / 45 END AS hx
         FROM k0 WINDOW w AS (PARTITION BY series_id ORDER BY ts))""",
         """k2 AS (SELECT *, CASE WHEN rn >= 16 THEN avg(raw) OVER w3 END AS sk, CASE WHEN rn >= 11 THEN (3 * hx + 2 * lag(hx) OVER w + lag(hx, 2) OVER w) / 6 END AS hull,
         CASE WHEN rn >= 29 THEN 100 * (4 * sum(bp) OVER w7 / nullif(sum(tr) OVER w7, 0) + 2 * sum(bp) OVER w14 / nullif(sum(tr) OVER w14, 0) + sum(bp) OVER w28 / nullif(sum(tr) OVER w28, 0)) / 7 END AS uo
         FROM k1 WINDOW w AS (PARTITION BY series_id ORDER BY ts), w3 AS (PARTITION BY series_id ORDER BY ts ROWS 2 PRECEDING), w7 AS (PARTITION BY series_id ORDER BY ts ROWS 6 PRECEDING),
         w14 AS (PARTITION BY series_id ORDER BY ts ROWS 13 PRECEDING), w28 AS (PARTITION BY series_id ORDER BY ts ROWS 27 PRECEDING))""",
         "k3 AS (SELECT *, CASE WHEN rn >= 18 THEN avg(sk) OVER (PARTITION BY series_id ORDER BY ts ROWS 2 PRECEDING) END AS sd FROM k2)",
         """k4 AS (SELECT *, lag(sk) OVER w AS sk1, lag(sd) OVER w AS sd1, lag(aw) OVER w AS aw1, lag(mom) OVER w AS mom1, lag(wr) OVER w AS wr1, lag(uo) OVER w AS uo1, lag(hull) OVER w AS hull1 FROM k3 WINDOW w AS (PARTITION BY series_id ORDER BY ts))""",
         body="""SELECT series_id, ts, CASE WHEN rn >= 200 THEN sign(close - s200) END AS sma200, CASE WHEN rn >= 26 THEN sign(close - base) END AS base_line, CASE WHEN rn >= 20 THEN sign(close - vw) END AS vwma,
         sign(hull - hull1) AS hull, CASE WHEN sd1 IS NOT NULL AND sk1 IS NOT NULL AND sd IS NOT NULL THEN CASE WHEN sk < 20 AND sd < 20 AND sk > sd THEN 1 WHEN sk > 80 AND sd > 80 AND sk < sd THEN -1 ELSE 0 END END AS stochastic,
         CASE WHEN aw1 IS NOT NULL THEN CASE WHEN aw > 0 AND aw > aw1 THEN 1 WHEN aw < 0 AND aw < aw1 THEN -1 ELSE 0 END END AS awesome,
         CASE WHEN mom1 IS NOT NULL THEN sign(mom - mom1) END AS momentum, CASE WHEN wr1 IS NOT NULL THEN CASE WHEN wr < -80 AND wr > wr1 THEN 1 WHEN wr > -20 AND wr < wr1 THEN -1 ELSE 0 END END AS williams_r,
         CASE WHEN uo1 IS NOT NULL AND uo IS NOT NULL THEN CASE WHEN uo > 70 THEN 1 WHEN uo < 30 THEN -1 ELSE 0 END END AS ultimate FROM k4"""))
def a18f(spark, sf):
    from barline.operators.indicators import votes

    d = votes(hourly_series(spark, sf))
    names = {"sma_200": "sma200"} | {n: n for n in ("base_line", "vwma", "hull", "stochastic", "awesome", "momentum", "williams_r", "ultimate")}
    return d.select("series_id", "ts", *[F.col(f"vote_{n}").alias(x) for n, x in names.items()])


@query("a18_vote_rating", "series_id:s ts:t ma_rating:f osc_rating:f rating:f n_votes:i",
       None)
def a18(spark, sf):
    from barline.operators.indicators import vote_rating

    return vote_rating(hourly_series(spark, sf))


@query("a19_sign_agreement", "series_id:s agree:f",
       with_sql(HOURLY_SQL, body="SELECT series_id, avg(CASE WHEN sign(close - open) = sign(d) THEN 1.0 ELSE 0 END) FILTER (WHERE d IS NOT NULL) AS agree FROM (SELECT *, close - lag(close) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM bars) GROUP BY 1"))
def a19(spark, sf):
    d = hourly_series(spark, sf).columns(lambda fr: {"d": F.col("close") - F.lag("close").over(fr.w())}, back_rows=1)
    return A.sign_agreement(d.withColumn("body", F.col("close") - F.col("open")), "series_id", "body", "d", "agree")


@query("a20_entropy", "event_type:s h:f",
       """SELECT event_type, sum(-p * log2(p)) AS h FROM (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM
          (SELECT event_type, value > 20 AS a, hour(ts) < 12 AS b, count(*) AS n FROM events GROUP BY 1, 2, 3)) GROUP BY 1""")
def a20(spark, sf):
    e = read_table(spark, sf, "events").withColumn("a", F.col("value") > 20).withColumn("b", F.hour("ts") < 12)
    return A.entropy(e, "event_type", ["a", "b"], "h")


@query("a21_cov_matrix", "a:s b:s cov:f corr:f",
       "\nUNION ALL\n".join(
           f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) AS cov, corr({a}, {b}) AS corr FROM lineitem"
           for i, a in enumerate(["l_quantity", "l_discount", "l_tax"]) for b in ["l_quantity", "l_discount", "l_tax"][i:]))
def a21(spark, sf):
    return A.cov_matrix(read_table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


# ----- sorts, limits, set operations --------------------------------------------


@query("o01_sort", "pos:i series_id:i ts:t tie:i",
       with_sql(TICKS_SQL, body="SELECT row_number() OVER (ORDER BY ts, tie) AS pos, series_id, ts, tie FROM ticks"))
def o01(spark, sf):
    return O.global_position(ticks(spark, sf), ["ts", "tie"], "pos")


@query("o02_latest_n", "l_orderkey:i l_linenumber:i exit_time:t pnl:f",
       with_sql(LEDGER_SQL, body="SELECT l_orderkey, l_linenumber, exit_time, pnl FROM ledger ORDER BY exit_time DESC, l_orderkey, l_linenumber LIMIT 50"))
def o02(spark, sf):
    return O.latest(ledger(spark, sf), [F.desc("exit_time"), F.asc("l_orderkey"), F.asc("l_linenumber")], 50)


@query("o03_top_bottom", "day:t user_id:i total:f leg:i",
       """WITH d AS (SELECT date_trunc('day', ts) AS day, user_id, round(sum(value), 6) AS total FROM events GROUP BY 1, 2),
          r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, user_id) AS up, row_number() OVER (PARTITION BY day ORDER BY total, user_id) AS dn,
          least(3, count(*) OVER (PARTITION BY day) // 2) AS k FROM d)
          SELECT day, user_id, total, CASE WHEN up <= k THEN 1 ELSE -1 END AS leg FROM r WHERE up <= k OR dn <= k""")
def o03(spark, sf):
    d = read_table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "user_id").agg(F.round(F.sum("value"), 6).alias("total"))
    return O.top_bottom(d, "day", "total", 3, "user_id")


@query("o04_best_by", "pair:i l_orderkey:i l_linenumber:i pnl:f",
       with_sql(LEDGER_SQL, body="SELECT pair, l_orderkey, l_linenumber, pnl FROM ledger QUALIFY row_number() OVER (PARTITION BY pair ORDER BY pnl DESC, l_orderkey DESC, l_linenumber DESC) = 1"))
def o04(spark, sf):
    return O.best_by(ledger(spark, sf), "pair", ["pnl", "l_orderkey", "l_linenumber"])


@query("o05_circular_extreme", "series_id:s best_slot:i best_value:f",
       with_sql(TICKS_SQL, """b AS (SELECT event_type AS series_id, hour(ts) AS slot, avg(price) AS v FROM ticks GROUP BY 1, 2),
         w AS (SELECT a.series_id, a.slot, avg(b.v) AS m FROM b a JOIN b ON a.series_id = b.series_id AND (b.slot - a.slot + 24) % 24 < 8 GROUP BY 1, 2 HAVING count(*) = 8)""",
       body="SELECT series_id, arg_min(slot, (m, slot)) AS best_slot, min(m) AS best_value FROM w GROUP BY 1"))
def o05(spark, sf):
    b = ticks(spark, sf, "event_type").groupBy("series_id", F.hour("ts").alias("slot")).agg(F.avg("price").alias("v"))
    return O.circular_extreme(b, "series_id", "slot", "v", 8, 24)


@query("u01_concat", "id:i kind:s v:f extra:f",
       "SELECT event_id AS id, 'event' AS kind, value AS v, NULL AS extra FROM events UNION ALL SELECT o_orderkey, 'order', o_totalprice, o_custkey FROM orders")
def u01(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), F.col("value").alias("v"))
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("v"), F.col("o_custkey").cast("double").alias("extra"))
    return O.concat(e, o)


@query("u02_intersect", "ts:t",
       with_sql(HOURLY_SQL, body="SELECT ts FROM bars WHERE series_id = 'click' INTERSECT SELECT ts FROM bars WHERE series_id = 'error'"))
def u02(spark, sf):
    h = hourly(spark, sf)
    return O.common_rows(h.filter("series_id = 'click'"), h.filter("series_id = 'error'"), ["ts"])


@query("u03_difference", "ts:t",
       with_sql(HOURLY_SQL, body="SELECT ts FROM bars WHERE series_id = 'click' EXCEPT SELECT ts FROM bars WHERE series_id = 'error'"))
def u03(spark, sf):
    h = hourly(spark, sf)
    return O.difference(h.filter("series_id = 'click'"), h.filter("series_id = 'error'"), ["ts"])
