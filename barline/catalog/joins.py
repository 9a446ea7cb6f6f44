"""Joins (J1-J18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.inputs import HOURLY_SQL, LEDGER_SQL, TICKS_SQL, hourly, hourly_series, ledger, ticks, with_sql
from barline.catalog.registry import query
from barline.functions.clock import DAY_US, HOUR_US
from barline.operators import joins as J
from barline.operators.asof import asof, contain, next_after
from barline.operators.bars import rebar
from barline.plans.quantiles import group_quantiles
from barline.sources.readers import read_table

LR_SQL = """
l AS (SELECT series_id, ts, tie, price FROM ticks WHERE event_type = 'click'),
r AS (SELECT series_id, ts AS available_at, max_by(price, tie) AS r_price FROM ticks WHERE event_type = 'view' GROUP BY 1, 2)"""


def two_feeds(spark, sf):
    t = ticks(spark, sf)
    left = t.filter("event_type = 'click'").select("series_id", "ts", "tie", "price")
    right = t.filter("event_type = 'view'").groupBy("series_id", F.col("ts").alias("available_at")).agg(
        F.max_by("price", "tie").alias("r_price"))
    return left, right


@query("j01_asof", "series_id:i tie:i price:f r_price:f r_at:t",
       with_sql(TICKS_SQL, LR_SQL, body="""SELECT l.series_id, tie, price, r_price, available_at AS r_at FROM l
         ASOF LEFT JOIN r ON l.series_id = r.series_id AND l.ts >= r.available_at"""))
def j01(spark, sf):
    left, right = two_feeds(spark, sf)
    return asof(left, right, "series_id", keep_right_ts="r_at")


@query("j01_asof_tolerance", "series_id:i tie:i r_price:f",
       with_sql(TICKS_SQL, LR_SQL, body="""SELECT l.series_id, tie, CASE WHEN l.ts - available_at <= INTERVAL 12 HOUR THEN r_price END AS r_price FROM l
         ASOF LEFT JOIN r ON l.series_id = r.series_id AND l.ts >= r.available_at"""))
def j01t(spark, sf):
    left, right = two_feeds(spark, sf)
    return asof(left, right, "series_id", tolerance_us=12 * HOUR_US)


@query("j02_asof_forward", "series_id:i tie:i r_price:f",
       with_sql(TICKS_SQL, LR_SQL, body="""SELECT l.series_id, tie, r_price FROM l
         ASOF LEFT JOIN r ON l.series_id = r.series_id AND l.ts <= r.available_at"""))
def j02(spark, sf):
    left, right = two_feeds(spark, sf)
    return asof(left, right, "series_id", direction="forward")


@query("j03_next_after", "l_orderkey:i l_linenumber:i next_at:t",
       with_sql(LEDGER_SQL, "cal AS (SELECT DISTINCT o_orderdate AS c FROM orders WHERE isodow(o_orderdate) < 6)",
                body="SELECT l_orderkey, l_linenumber, c AS next_at FROM ledger ASOF LEFT JOIN cal ON exit_time < c"))
def j03(spark, sf):
    cal = read_table(spark, sf, "orders").filter(F.weekday("o_orderdate") < 5).select(F.col("o_orderdate").alias("c"))
    led = ledger(spark, sf).select("l_orderkey", "l_linenumber", "exit_time")
    return next_after(led, cal, "exit_time", "c", "next_at")


@query("j04_tolerance_lookup", "series_id:i tie:i r_price:f",
       with_sql(TICKS_SQL, LR_SQL, body="""SELECT l.series_id, tie, CASE WHEN available_at - l.ts <= INTERVAL 4 DAY THEN r_price END AS r_price FROM l
         ASOF LEFT JOIN r ON l.series_id = r.series_id AND l.ts <= r.available_at"""))
def j04(spark, sf):
    left, right = two_feeds(spark, sf)
    return asof(left, right, "series_id", direction="forward", tolerance_us=4 * DAY_US)


@query("j05_containment", "series_id:s ts:t coarse_id:i",
       with_sql(HOURLY_SQL, "d AS (SELECT series_id, date_trunc('day', ts) AS day, CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 AS id FROM bars WHERE high > 150 GROUP BY 1, 2)",
                body="SELECT b.series_id, b.ts, coalesce(id, -1) AS coarse_id FROM bars b LEFT JOIN d ON b.series_id = d.series_id AND date_trunc('day', b.ts) = day"))
def j05(spark, sf):
    h = hourly(spark, sf)
    d = rebar(h.filter("high > 150"), "series_id", DAY_US).withColumn("id", F.floor(F.unix_micros("ts") / DAY_US))
    return contain(h, d, "series_id", DAY_US, "id")


@query("j06_inner_join", "l_orderkey:i l_linenumber:i o_totalprice:f",
       "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j06(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return li.join(o, "l_orderkey")


@query("j07_left_join", "o_orderkey:i n_r:i",
       "SELECT o_orderkey, n_r FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey")
def j07(spark, sf):
    r = read_table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_r"))
    return read_table(spark, sf, "orders").select("o_orderkey").join(r, "o_orderkey", "left")


@query("j08_pair_join", "ts:t close_a:f close_b:f",
       with_sql(HOURLY_SQL, body="SELECT a.ts, a.close AS close_a, b.close AS close_b FROM bars a JOIN bars b ON a.ts = b.ts WHERE a.series_id = 'click' AND b.series_id = 'view'"))
def j08(spark, sf):
    return J.pair_join(hourly(spark, sf), "click", "view", "series_id", "ts", ["close"])


@query("j09_panel", "ts:t v_click:f v_view:f v_error:f",
       with_sql(HOURLY_SQL, body="""SELECT ts, max(close) FILTER (WHERE series_id = 'click') AS v_click, max(close) FILTER (WHERE series_id = 'view') AS v_view,
         max(close) FILTER (WHERE series_id = 'error') AS v_error FROM bars WHERE series_id IN ('click', 'view', 'error') GROUP BY ts HAVING count(*) = 3"""))
def j09(spark, sf):
    return J.panel(hourly(spark, sf), "series_id", "ts", "close", ["click", "view", "error"])


@query("j10_features_lead", "series_id:s ts:t vol_flag:i next_close:f",
       with_sql(HOURLY_SQL, """f AS (SELECT series_id, ts, CASE WHEN volume > 200 THEN 1 ELSE 0 END AS vol_flag FROM bars),
         n AS (SELECT series_id, ts, lead(close) OVER (PARTITION BY series_id ORDER BY ts) AS next_close FROM bars)""",
       body="SELECT f.series_id, f.ts, vol_flag, next_close FROM f JOIN n USING (series_id, ts)"))
def j10(spark, sf):
    s = hourly_series(spark, sf)
    f = s.df.select("series_id", "ts", (F.col("volume") > 200).cast("int").alias("vol_flag"))
    n = s.columns(lambda fr: {"next_close": F.lead("close").over(fr.w())}, fwd_rows=1).select("series_id", "ts", "next_close")
    return f.join(n, ["series_id", "ts"])


@query("j11_dimension", "l_orderkey:i l_linenumber:i p_brand:s p_size:i",
       "SELECT l_orderkey, l_linenumber, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey")
def j11(spark, sf):
    dim = read_table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return J.with_dim(read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), dim, "l_partkey")


BRIDGE_SQL = """
daily AS (SELECT c_nationkey AS c, s_nationkey AS s, date_trunc('month', l_shipdate) AS ts, avg(l_extendedprice) AS x
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""


def nation_pairs(spark, sf):
    """Customer nation against supplier nation as instrument pairs, monthly mean value."""
    t = {n: read_table(spark, sf, n) for n in ("lineitem", "orders", "customer", "supplier")}
    j = (
        t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return j.groupBy(F.col("c_nationkey").alias("c"), F.col("s_nationkey").alias("s"), F.date_trunc("month", "l_shipdate").alias("ts")).agg(
        F.avg("l_extendedprice").alias("x")
    ).withColumn("pair", F.col("c") * 100 + F.col("s"))


@query("j12_signed_bridge", "entity:i ts:t strength:f n:i",
       with_sql(BRIDGE_SQL, body="""SELECT entity, ts, avg(v) AS strength, count(*) AS n FROM (
         SELECT c AS entity, ts, x AS v FROM daily WHERE c <> s UNION ALL SELECT s, ts, -x FROM daily WHERE c <> s) GROUP BY 1, 2"""))
def j12(spark, sf):
    p = nation_pairs(spark, sf).filter("c <> s")
    dim = p.select("pair", "c", "s").distinct()
    ex = J.signed_explode(p.select("pair", "ts", "x"), J.pair_bridge(dim, "pair", "c", "s"), "pair")
    return ex.groupBy("entity", "ts").agg(F.avg(F.col("sign") * F.col("x")).alias("strength"), F.count(F.lit(1)).alias("n"))


@query("j13_lookup_fallback", "series_id:s tie:i cost:f",
       with_sql(TICKS_SQL, """e AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS h, max(price) - min(price) AS v FROM ticks GROUP BY 1, 2 HAVING count(*) >= 4),
         m AS (SELECT event_type AS series_id, (isodow(ts) - 1) * 24 + hour(ts) AS how, quantile_cont(price, 0.5) AS v FROM ticks WHERE price > 20 GROUP BY 1, 2)""",
       body="""SELECT t.event_type AS series_id, tie, coalesce(e.v, m.v, 1.5) AS cost FROM ticks t
         LEFT JOIN e ON e.series_id = t.event_type AND e.h = date_trunc('hour', t.ts)
         LEFT JOIN m ON m.series_id = t.event_type AND m.how = (isodow(t.ts) - 1) * 24 + hour(t.ts)"""))
def j13(spark, sf):
    from barline.functions.clock import hour_of_week

    t = ticks(spark, sf, "event_type").withColumn("h", F.date_trunc("hour", "ts")).withColumn("how", hour_of_week("ts"))
    exact = t.groupBy("series_id", "h").agg((F.max("price") - F.min("price")).alias("v"), F.count(F.lit(1)).alias("n")).filter("n >= 4")
    coarse = group_quantiles(t.filter("price > 20"), ["series_id", "how"], "price", {"v": 0.5})
    return J.lookup_fallback(t, (exact, ["series_id", "h"], "v"), (coarse, ["series_id", "how"], "v"), F.lit(1.5), "cost")


@query("j14_semi_anti", "o_orderkey:i",
       """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
          AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def j14(spark, sf):
    active = read_table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    risky = read_table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read_table(spark, sf, "orders").join(active, "o_custkey", "left_semi").join(risky, "o_orderkey", "left_anti")


@query("j15_interval_join", "series_id:i event_tie:i n:i total:f",
       with_sql(TICKS_SQL, body="""SELECT e.series_id, e.tie AS event_tie, count(*) AS n, sum(b.price) AS total FROM ticks e JOIN ticks b
         ON e.series_id = b.series_id AND b.ts >= e.ts AND b.ts <= e.ts + INTERVAL 12 HOUR WHERE e.event_type = 'purchase' GROUP BY 1, 2"""))
def j15(spark, sf):
    t = ticks(spark, sf)
    ev = t.filter("event_type = 'purchase'").select("series_id", F.col("ts").alias("event_ts"), F.col("tie").alias("event_tie"))
    p = J.path(ev, t.select("series_id", "ts", "price"), "series_id", 12 * HOUR_US)
    return p.groupBy("series_id", "event_tie").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query("j16_interval_overlap", "pair:i a_key:i a_line:i n:i",
       with_sql(LEDGER_SQL, body="""SELECT a.pair, a.l_orderkey AS a_key, a.l_linenumber AS a_line, count(*) AS n FROM ledger a JOIN ledger b ON a.pair = b.pair
         AND a.entry_time <= b.exit_time AND a.exit_time >= b.entry_time WHERE b.label = 'A' GROUP BY 1, 2, 3"""))
def j16(spark, sf):
    led = ledger(spark, sf)
    a = led.select("pair", F.col("l_orderkey").alias("a_key"), F.col("l_linenumber").alias("a_line"), F.col("entry_time").alias("a0"), F.col("exit_time").alias("a1"))
    b = led.filter("label = 'A'").select("pair", F.col("entry_time").alias("b0"), F.col("exit_time").alias("b1"))
    return J.overlap_counts(a, b, "pair", ("a0", "a1"), ("b0", "b1"), ["a_key", "a_line"]).filter("n > 0")


@query("j17_parameter_grid", "lo:f hi:f series_id:s n:i total:f",
       with_sql(TICKS_SQL, body="""SELECT lo, hi, event_type AS series_id, count(*) AS n, sum(price) AS total FROM ticks
         CROSS JOIN (VALUES (0.0, 20.0), (10.0, 50.0), (40.0, 200.0)) g(lo, hi) WHERE price >= lo AND price < hi GROUP BY 1, 2, 3"""))
def j17(spark, sf):
    g = J.grid(ticks(spark, sf, "event_type"), [{"lo": 0.0, "hi": 20.0}, {"lo": 10.0, "hi": 50.0}, {"lo": 40.0, "hi": 200.0}])
    return g.filter((F.col("price") >= F.col("lo")) & (F.col("price") < F.col("hi"))).groupBy("lo", "hi", "series_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query("j18_listed_pairs", "a:s b:s n:i corr:f",
       with_sql(HOURLY_SQL, body="""SELECT x.series_id AS a, y.series_id AS b, count(*) AS n, corr(x.close, y.close) AS corr FROM bars x JOIN bars y ON x.ts = y.ts
         WHERE (x.series_id, y.series_id) IN (('click', 'view'), ('error', 'signup'), ('purchase', 'view')) GROUP BY 1, 2"""))
def j18(spark, sf):
    h = hourly(spark, sf)
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("click", "view"), ("error", "signup"), ("purchase", "view"))])
    pairs = h.select(F.explode(listed).alias("p")).select("p.a", "p.b").distinct()
    return J.listed_pairs(h, pairs, "series_id", "ts", "close").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("va", "vb").alias("corr"))
