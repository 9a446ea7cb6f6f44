"""Sources and sinks (S1-S13) and projections, filters, cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barline.catalog.inputs import HOURLY_SQL, LEDGER_SQL, TICKS_SQL, hourly, ledger, ticks, with_sql
from barline.catalog.registry import query
from barline.functions.clock import HOUR_US, clock_features, session_label
from barline.functions.scalar import clip_scale, to_base, to_pips
from barline.operators import bars as B
from barline.operators import cleaning as P
from barline.operators.asof import asof_instants
from barline.sources.history import History
from barline.sources import readers as R
from barline.sources import sinks as K
from barline.session import shared_dir


def scratch(spark, name):
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


@query("s01_parquet_scan", "event_id:i ts:t value:f", "SELECT event_id, ts, value FROM events")
def s01(spark, sf):
    return R.read_bars(spark, f"{sf}/events.parquet", ["event_id", "ts", "value"])


@query(
    "s02_parquet_range_scan",
    "event_id:i ts:t value:f",
    "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'",
)
def s02(spark, sf):
    return R.read_bars(spark, f"{sf}/events.parquet", ["event_id", "ts", "value"], "2024-01-08", "2024-01-15")


@query(
    "s03_tail_scan",
    "series_id:i tie:i ts:t price:f",
    with_sql(TICKS_SQL, body="""SELECT series_id, tie, ts, price FROM ticks
      QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, tie DESC) <= 5"""),
)
def s03(spark, sf):
    return R.tail(ticks(spark, sf), "series_id", ["ts", "tie"], 5)


@query(
    "s04_tick_csv",
    "ts:t bid:f ask:f volume:i mid:f",
    with_sql(TICKS_SQL, body="""SELECT date_trunc('millisecond', ts) AS ts, price - 0.05 AS bid, price + 0.05 AS ask,
      CAST(volume AS BIGINT) AS volume, price AS mid FROM ticks"""),
)
def s04(spark, sf):
    path = scratch(spark, "ticks-csv")
    t = ticks(spark, sf)
    t.select(
        F.date_format("ts", R.TICK_CSV_STAMP).alias("stamp"),
        F.round(F.col("price") - 0.05, 6).alias("bid"),
        F.round(F.col("price") + 0.05, 6).alias("ask"),
        F.col("volume").cast("long").alias("volume"),
    ).write.csv(path)
    return R.read_ticks_csv(spark, path)


@query(
    "s05_tick_json",
    "series_id:s ts:t bid:f ask:f mid:f",
    with_sql(TICKS_SQL, body="""SELECT series_id, date_trunc('millisecond', ts) AS ts, price - 0.05 AS bid,
      price + 0.05 AS ask, price AS mid FROM ticks"""),
)
def s05(spark, sf):
    path = scratch(spark, "ticks-json")
    ticks(spark, sf).select(
        F.unix_millis("ts").alias("ms"),
        F.col("series_id").cast("string").alias("p"),
        F.round(F.col("price") - 0.05, 6).alias("b"),
        F.round(F.col("price") + 0.05, 6).alias("a"),
    ).write.json(path)
    return R.read_ticks_json(spark, path)


# fixed values: contract names kept and the entity each one stands for
REPORT_ENTITIES = {"AUTOMOBILE": "AUT", "BUILDING": "BLD", "MACHINERY": "MCH"}


@query(
    "s06_report_csv",
    "entity:s report_date:s net:f",
    """SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AUT' WHEN 'BUILDING' THEN 'BLD' ELSE 'MCH' END AS entity,
      strftime(o_orderdate, '%Y-%m-%d') AS report_date, min(o_totalprice) AS net
      FROM orders JOIN customer ON o_custkey = c_custkey
      WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') GROUP BY 1, 2""",
)
def s06(spark, sf):
    path = scratch(spark, "reports")
    o, c = R.read_table(spark, sf, "orders"), R.read_table(spark, sf, "customer")
    o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("Market Name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("As Of"),
        F.format_string("%015.2f", "o_totalprice").alias("Net"),
    ).write.option("header", True).csv(path)
    return R.read_reports(
        spark, path, {"Market Name": "entity", "As Of": "report_date", "Net": "net"},
        REPORT_ENTITIES, "entity", "report_date",
    )


@query(
    "s07_reference_rates",
    "l_orderkey:i l_linenumber:i entry_time:t rate:f",
    with_sql(LEDGER_SQL, """
     rates AS (SELECT date_trunc('year', o_orderdate) + INTERVAL 1 YEAR AS available_at, round(avg(o_totalprice), 2) AS rate
       FROM orders GROUP BY 1)""", body="""
     SELECT l_orderkey, l_linenumber, entry_time, rate FROM ledger ASOF LEFT JOIN rates ON entry_time >= available_at"""),
)
def s07(spark, sf):
    path = scratch(spark, "rates")
    R.read_table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("rate")
    ).select(F.lit("ALL").alias("entity"), F.concat(F.col("y") + 1, F.lit("-01-01 00:00:00")).alias("date"), "rate"
             ).write.option("header", True).csv(path)
    rates = R.read_rates(spark, path, "entity", "date", "rate").drop("entity")
    return asof_instants(ledger(spark, sf).select("l_orderkey", "l_linenumber", "entry_time"), rates, "entry_time")


@query(
    "s08_ledger_scan",
    "l_orderkey:i l_linenumber:i l_returnflag:s l_quantity:f",
    "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40",
)
def s08(spark, sf):
    return R.read_ledger(spark, f"{sf}/lineitem.parquet", "l_returnflag = 'R' AND l_quantity > 40")


@query(
    "s09_upsert",
    "event_id:i value:f",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN value + 1 ELSE value END AS value FROM events""",
)
def s09(spark, sf):
    path = scratch(spark, "upsert")
    e = R.read_table(spark, sf, "events").select(
        "event_id", "value", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    base = e.select("event_id", "value", "day", F.lit(0).alias("version"))
    fresh = e.filter("event_type = 'click'").select(
        "event_id", (F.col("value") + 1).alias("value"), "day", F.lit(1).alias("version"))
    K.upsert(base, path, ["event_id", "day"], ["version"], "day")
    K.upsert(fresh, path, ["event_id", "day"], ["version"], "day")
    return spark.read.parquet(path)


@query("s10_append", "event_type:s n:i", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def s10(spark, sf):
    path = scratch(spark, "append")
    e = R.read_table(spark, sf, "events").select("event_id", "event_type")
    K.append(e, path)
    K.append(e, path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s11_result_file", "event_type:s n:i total:f",
       "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def s11(spark, sf):
    path = scratch(spark, "result")
    res = R.read_table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    K.write_result(res, path, "csv")
    return spark.read.option("header", True).schema("event_type string, n long, total double").csv(path)


@query("s12_retention", "day:s n:i",
       """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20'
          GROUP BY 1""")
def s12(spark, sf):
    path = scratch(spark, "retention")
    e = R.read_table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    K.append(e.repartition("day"), path, ["day"])
    K.prune_in_place(spark, path, "day", "2024-01-20")
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("s13_append_dedup", "event_id:i event_type:s", "SELECT event_id, event_type FROM events")
def s13(spark, sf):
    path = scratch(spark, "dedup")
    e = R.read_table(spark, sf, "events").select("event_id", "event_type")
    K.append_dedup(e.filter("event_type IN ('click', 'view')"), path, "event_id")
    K.append_dedup(e.unionAll(e), path, "event_id")
    return spark.read.parquet(path)


def by_week(spark, sf):
    """Ticks stored as a history, a batch for each week."""
    h = History(spark, scratch(spark, "history"), "series_id", "ts", ["tie"])
    t = ticks(spark, sf).select("series_id", "tie", "ts", "price").withColumn("week", F.date_trunc("week", "ts"))
    for week in [r[0] for r in t.select("week").distinct().orderBy("week").collect()]:
        h.append_new(t.filter(F.col("week") == F.lit(week)).drop("week"))
    return h, t.drop("week")


@query("s03_tail_by_index", "series_id:i tie:i ts:t price:f",
       with_sql(TICKS_SQL, body="SELECT series_id, tie, ts, price FROM ticks QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, tie DESC) <= 5"))
def s03i(spark, sf):
    return by_week(spark, sf)[0].tail(5)


@query("s13_append_by_index", "series_id:i tie:i ts:t price:f", with_sql(TICKS_SQL, body="SELECT series_id, tie, ts, price FROM ticks"))
def s13i(spark, sf):
    h, t = by_week(spark, sf)
    h.append_new(t.unionAll(t))  # nothing of it is new
    return h.all()


# ----- projections, filters, cleaning -----------------------------------------

QUOTES_SQL = """
quotes AS (SELECT l_orderkey, l_linenumber, p_partkey, l_extendedprice / l_quantity AS mid0,
   l_extendedprice / l_quantity * (1 - l_discount) AS bid, l_extendedprice / l_quantity * (1 + l_tax) AS ask,
   p_size * 1.0 AS tick FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def quotes(spark, sf):
    li = R.read_table(spark, sf, "lineitem")
    mid = F.col("l_extendedprice") / F.col("l_quantity")
    raw = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"),
                    (mid * (1 - F.col("l_discount"))).alias("bid"), (mid * (1 + F.col("l_tax"))).alias("ask"))
    dim = R.read_table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("tick"))
    return P.with_spread(raw, dim, "p_partkey", "tick")


@query("p01_mid_spread", "l_orderkey:i l_linenumber:i p_partkey:i mid:f spread:f",
       with_sql(QUOTES_SQL, body="SELECT l_orderkey, l_linenumber, p_partkey, (bid + ask) / 2 AS mid, (ask - bid) / tick AS spread FROM quotes"))
def p01(spark, sf):
    return quotes(spark, sf)


@query("p02_clean_quotes", "p_partkey:i kept:i dropped:i",
       with_sql(QUOTES_SQL, body="""SELECT p_partkey, count(*) FILTER (WHERE s > 0 AND s < 50) AS kept,
         count(*) FILTER (WHERE NOT (s > 0 AND s < 50)) AS dropped
         FROM (SELECT p_partkey, (ask - bid) / tick AS s FROM quotes) GROUP BY 1"""))
def p02(spark, sf):
    return P.quote_quality(quotes(spark, sf), "p_partkey", 0.0, 50.0)


@query("p03_dedupe", "user_id:i hour:t event_id:i value:f",
       """SELECT user_id, date_trunc('hour', ts) AS hour, min(event_id) AS event_id, first(value ORDER BY event_id) AS value
          FROM events GROUP BY 1, 2""")
def p03(spark, sf):
    e = R.read_table(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour"), "event_id", "value")
    return B.dedupe(e, ["user_id", "hour"], ["event_id"])


@query("p04_unit_conversion", "l_orderkey:i l_linenumber:i pips:f base_value:f",
       """SELECT l_orderkey, l_linenumber, l_extendedprice / p_size AS pips,
          CASE WHEN s_nationkey % 2 = 0 THEN l_extendedprice / (1 + s_nationkey) ELSE l_extendedprice * (1 + s_nationkey) END AS base_value
          FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")
def p04(spark, sf):
    li = R.read_table(spark, sf, "lineitem")
    pt = R.read_table(spark, sf, "part")
    sp = R.read_table(spark, sf, "supplier")
    j = li.join(pt, li.l_partkey == pt.p_partkey).join(sp, li.l_suppkey == sp.s_suppkey)
    return j.select("l_orderkey", "l_linenumber", to_pips("l_extendedprice", "p_size").alias("pips"),
                    to_base("l_extendedprice", 1.0 + F.col("s_nationkey"), F.col("s_nationkey") % 2 == 0).alias("base_value"))


@query("p05_session_label", "event_id:i session:s",
       """SELECT event_id, CASE WHEN hour(ts) < 7 THEN 'asian' WHEN hour(ts) < 13 THEN 'london' WHEN hour(ts) < 16 THEN 'overlap'
          WHEN hour(ts) < 21 THEN 'new_york' ELSE 'off' END AS session FROM events""")
def p05(spark, sf):
    return R.read_table(spark, sf, "events").select("event_id", session_label("ts").alias("session"))


@query("p06_clock_features", "event_id:i how:i hour_sin:f hour_cos:f dow_sin:f dow_cos:f",
       """SELECT event_id, (isodow(ts) - 1) * 24 + hour(ts) AS how,
          sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24) AS hour_sin, cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24) AS hour_cos,
          sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos FROM events""")
def p06(spark, sf):
    cols = clock_features("ts")
    return R.read_table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in cols.items()])


@query("p07_segments", "series_id:i tie:i segment:i",
       with_sql(TICKS_SQL, body="""SELECT series_id, tie, sum(brk) OVER (PARTITION BY series_id ORDER BY ts, tie) AS segment FROM (
         SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts, tie) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS brk FROM ticks)"""))
def p07(spark, sf):
    return B.segments(ticks(spark, sf), "series_id", ["ts", "tie"], 12 * HOUR_US)


@query("p08_clip_scale", "event_id:i x:f",
       """SELECT event_id, coalesce(greatest(least((value - 50) / 20, 3), -3), 0) / 3 AS x FROM
          (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)""")
def p08(spark, sf):
    v = F.when(F.col("event_type") != "error", (F.col("value") - 50) / 20)
    return R.read_table(spark, sf, "events").select("event_id", clip_scale(v, 3.0).alias("x"))


@query("p09_forward_fill", "series_id:i tie:i filled:f",
       with_sql(TICKS_SQL, body="""SELECT series_id, tie, last_value(CASE WHEN event_type = 'purchase' THEN price END IGNORE NULLS)
         OVER (PARTITION BY series_id ORDER BY ts, tie ROWS UNBOUNDED PRECEDING) AS filled FROM ticks"""))
def p09(spark, sf):
    t = ticks(spark, sf).withColumn("x", F.when(F.col("event_type") == "purchase", F.col("price")))
    return P.ffill(t, "series_id", ["ts", "tie"], {"filled": "x"})


@query("p10_seeded_coin", "event_id:i coin:i picked:i")
def p10(spark, sf):
    return P.coin(R.read_table(spark, sf, "events"), ["event_id"], seed=7).select(
        "event_id", "coin", P.sampled("event_id", 7, 0.25).cast("int").alias("picked"))


@query("p11_anchors", "series_id:i ts:t tie:i price:f",
       with_sql(TICKS_SQL, body="""SELECT series_id, ts, tie, price FROM ticks
         QUALIFY row_number() OVER (PARTITION BY series_id, date_trunc('day', ts) ORDER BY ts, tie) = 1"""))
def p11(spark, sf):
    return B.anchors(ticks(spark, sf), "series_id", "day", ["ts", "tie"])


@query("p11_every_kth", "series_id:i tie:i",
       with_sql(TICKS_SQL, body="""SELECT series_id, tie FROM ticks
         QUALIFY (row_number() OVER (PARTITION BY series_id ORDER BY ts, tie) - 1) % 5 = 0"""))
def p11k(spark, sf):
    return B.every_kth(ticks(spark, sf), "series_id", ["ts", "tie"], 5)


@query("p12_quantile_gate", "series_id:s tie:i price:f",
       with_sql(TICKS_SQL, body="""SELECT t.event_type AS series_id, tie, price FROM ticks t JOIN
         (SELECT event_type, quantile_cont(price, 0.9) AS q FROM ticks WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) g
         ON t.event_type = g.event_type WHERE price <= q"""))
def p12(spark, sf):
    return P.quantile_gate(ticks(spark, sf, "event_type"), "series_id", "price", 0.9, F.col("ts") < "2024-01-15")
