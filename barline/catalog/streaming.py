"""Streaming operators (G1-G14) driven over the events table with ``availableNow``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barline.catalog.inputs import TICKS_SQL, ticks, with_sql
from barline.catalog.indicators import sar_sql
from barline.catalog.registry import query
from barline.functions.clock import HOUR_US
from barline.operators.bars import resample
from barline.plans.sequential import run_kernel
from barline.plans.series import Series
from barline.session import shared_dir
from barline.sources.readers import read_table
from barline.sources.sinks import materialize
from barline.streaming import by_name as BN
from barline.streaming import keyed as KS
from barline.streaming import streams as G

DONE = "(SELECT max(ts) FROM ticks) - INTERVAL 1 HOUR"
OHLC_SQL = "first(price ORDER BY ts, tie) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, tie) AS close, sum(volume) AS volume"


def stream(spark, sf):
    """The events table as a stream with tick columns."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = G.stream_ticks(spark, sf, schema, glob="events.parquet")
    return e.select(F.col("event_type").alias("series_id"), "ts", F.col("event_id").alias("tie"), F.col("value").alias("price"),
                    F.get_json_object("props", "$.k").cast("double").alias("volume"), "user_id")


def parts(spark, sf, delayed_hours=0):
    """The same rows in three parts by time, each cut through an instant: between two rows of
    equal time where there are such. With ``delayed_hours`` a tenth of the rows of so many
    hours before a cut come with the next part. Returns their folder and schema."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    # approximate quantiles differ from run to run: drawn once, and one pass deals the rows
    cuts = materialize(e.agg(F.percentile_approx("ts", [1 / 3, 2 / 3]).alias("q")).select(F.col("q")[0].alias("a"), F.col("q")[1].alias("b")), "cuts")
    ties = e.join(F.broadcast(cuts)).agg(  # one row
        F.min(F.when(F.col("ts") == F.col("a"), F.col("event_id"))).alias("ta"), F.min(F.when(F.col("ts") == F.col("b"), F.col("event_id"))).alias("tb"))
    marked = e.join(F.broadcast(cuts.join(ties)))  # one row
    upto = lambda x: (F.col("ts") < F.col(x)) | ((F.col("ts") == F.col(x)) & (F.col("event_id") <= F.col(f"t{x}")))
    part = F.when(upto("a"), 0).when(upto("b"), 1).otherwise(2)
    if delayed_hours:
        behind = lambda x: upto(x) & (F.col("ts") > F.col(x) - F.expr(f"INTERVAL {delayed_hours} HOURS"))
        part = part + F.when((F.col("event_id") % 10 == 0) & (behind("a") | (~upto("a") & behind("b"))), 1).otherwise(0)
    base = shared_dir(spark, f"batches-{uuid.uuid4().hex}")
    marked.select(*e.columns, part.alias("part")).write.partitionBy("part").parquet(base)
    return base, e.schema


def drain_parts(spark, source, build, name):
    """One run over the same checkpoint for each part that has arrived."""
    base, schema = source
    to = shared_dir(spark, f"stream-{name}-{uuid.uuid4().hex}")
    for i in range(3):
        raw = spark.readStream.schema(schema).parquet(f"{base}/part=[0-{i}]")
        df = build(raw.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), F.col("value").alias("price")))
        G.run_available(df, f"{to}/out", f"{to}/checkpoint")
    return G.read_sink(spark, f"{to}/out", df.schema)


def keyed(spark, sf, kernel, name, shape=lambda s: s, delay=None, delayed_hours=0, **more):
    run = lambda s: KS.keyed_kernel(shape(s), "user_id", ["ts", "tie"], kernel, delay, **more)
    return drain_parts(spark, parts(spark, sf, delayed_hours), run, name)


#: Rows come up to half a day late and wait for a day on the event clock.
LATE_HOURS, WAIT = 12, "24 hours"
WATERMARK_SQL = "wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 24 HOUR AS upto FROM ticks)"


def drain(spark, df, name, batch=None, path=None):
    base = path or shared_dir(spark, f"stream-{name}-{uuid.uuid4().hex}")
    G.run_available(df, f"{base}/out", f"{base}/checkpoint", batch=batch)
    return G.read_sink(spark, f"{base}/out", df.schema)


@query("g01_ingest", "tie:i ts:t price:f", with_sql(TICKS_SQL, body="SELECT tie, ts, price FROM ticks"))
def g01(spark, sf):
    return drain(spark, stream(spark, sf), "ingest")


@query("g02_dedupe", "tie:i ts:t price:f", with_sql(TICKS_SQL, body="SELECT tie, ts, price FROM ticks"))
def g02(spark, sf):
    s = stream(spark, sf)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return drain(spark, G.stream_dedupe(twice, ["series_id", "ts", "tie"], "ts", "1 hour"), "dedupe")


@query("g03_tumbling_bars", "series_id:s ts:t open:f high:f low:f close:f volume:f",
       with_sql(TICKS_SQL, body=f"SELECT event_type AS series_id, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, {OHLC_SQL.replace('ORDER BY ts', 'ORDER BY ticks.ts')} FROM ticks GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTE, ticks.ts) + INTERVAL 5 MINUTE <= {DONE}"))
def g03(spark, sf):
    return drain(spark, G.stream_bars(stream(spark, sf), "series_id", "5 minutes", "1 hour"), "bars")


@query("g04_sliding", "series_id:s start:t end:t high:f low:f mean:f n_ticks:i",
       with_sql(TICKS_SQL, "w AS (SELECT event_type AS series_id, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s, price FROM ticks)",
                body=f"SELECT series_id, s AS start, s + INTERVAL 2 HOUR AS \"end\", max(price) AS high, min(price) AS low, avg(price) AS mean, count(*) AS n_ticks FROM w GROUP BY 1, 2 HAVING s + INTERVAL 2 HOUR <= {DONE}"))
def g04(spark, sf):
    return drain(spark, G.stream_sliding(stream(spark, sf), "series_id", "2 hours", "1 hour", "1 hour"), "sliding")


@query("g05_sessions", "user_id:i start:t end:t n:i total:f",
       with_sql(TICKS_SQL, "b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY ts))", "g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS grp FROM b)",
                body=f"SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n, sum(price) AS total FROM g GROUP BY user_id, grp HAVING max(ts) + INTERVAL 6 HOUR <= {DONE}"))
def g05(spark, sf):
    return drain(spark, G.stream_sessions(stream(spark, sf), "user_id", "6 hours", "1 hour"), "sessions")


def day_files(spark, sf, shift_hours=0):
    """Events rewritten as one file per arrival day; with a shift some rows arrive late."""
    base = shared_dir(spark, f"arrivals-{uuid.uuid4().hex}")
    e = read_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    late = F.when(F.col("event_id") % 50 == 0, shift_hours).otherwise(0)
    arrive = F.timestamp_micros(F.unix_micros("ts") + late * HOUR_US)
    day = F.date_trunc("day", arrive)
    d = e.withColumn("arrival", day)
    days = [r[0] for r in d.select("arrival").distinct().orderBy("arrival").limit(4).collect()]
    first, rest = days[:3], days[3:]
    for i, x in enumerate(first):
        d.filter(F.col("arrival") == x).drop("arrival").coalesce(1).write.parquet(f"{base}/{i}")
    d.filter(F.col("arrival") >= rest[0]).drop("arrival").coalesce(1).write.parquet(f"{base}/{len(first)}")
    return base, e.schema, len(first) + 1


@query("g06_late_side_output", "side:s n:i")
def g06(spark, sf):
    base, schema, n = day_files(spark, sf, 36)
    out = shared_dir(spark, f"late-{uuid.uuid4().hex}")
    write = G.late_to_side(f"{out}/main", f"{out}/side", "ts", 24 * HOUR_US)
    for i in range(n):
        s = G.stream_ticks(spark, f"{base}/[0-{i}]", schema)
        G.run_available(s, "", f"{out}/checkpoint", batch=write)
    main, side = spark.read.parquet(f"{out}/main"), spark.read.parquet(f"{out}/side")
    return main.select(F.lit("main").alias("side")).unionAll(side.select(F.lit("late").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("g07_enrich", "tie:i price:f c_mktsegment:s", "SELECT event_id AS tie, value AS price, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def g07(spark, sf):
    dim = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return drain(spark, G.enrich(stream(spark, sf), dim, "user_id"), "enrich")


@query("g08_stateful_ema", "user_id:i tie:i ema:f",
       with_sql(TICKS_SQL, "b AS (SELECT user_id, tie, price, row_number() OVER (PARTITION BY user_id ORDER BY ts, tie) AS rn FROM ticks)",
                "r AS (SELECT user_id, rn, tie, price AS total, CAST(NULL AS DOUBLE) AS ema FROM b WHERE rn = 1 UNION ALL SELECT b.user_id, b.rn, b.tie, total + price, "
                "CASE WHEN b.rn = 8 THEN (total + price) / 8 WHEN b.rn > 8 THEN ema + 2 / 9.0 * (price - ema) END FROM r JOIN b ON b.user_id = r.user_id AND b.rn = r.rn + 1)",
                body="SELECT user_id, tie, ema FROM r", recursive=True))
def g08(spark, sf):
    out = KS.in_time(keyed(spark, sf, BN.kernel("ema", "price", 8), "ema"))
    return out.withColumn("ema", F.when(~F.isnan("ema"), F.col("ema")))


@query("g08_stateful_sar", "user_id:i tie:i sar:f sar_dir:i",
       with_sql(TICKS_SQL, "b AS (SELECT user_id AS series_id, tie, price + 1 AS high, price - 1 AS low, row_number() OVER (PARTITION BY user_id ORDER BY ts, tie) AS rn FROM ticks)", sar_sql("b"),
                body="SELECT series_id AS user_id, tie, stop AS sar, side AS sar_dir FROM b JOIN sar USING (series_id, rn)", recursive=True))
def g08s(spark, sf):
    around = lambda s: s.withColumn("high", F.col("price") + 1).withColumn("low", F.col("price") - 1)
    return KS.in_time(keyed(spark, sf, BN.kernel("parabolic_sar"), "sar", around))


@query("g09_stateful_swings", "user_id:i tie:i is_high:i value:f",
       with_sql(TICKS_SQL, "p AS (SELECT user_id, tie, lag(price) OVER w AS p1, lag(price, 2) OVER w AS p2, price AS p0 FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY ts, tie))",
                body='SELECT user_id, tie, 1 AS is_high, p1 AS "value" FROM p WHERE p1 > p2 AND p1 > p0 UNION ALL SELECT user_id, tie, 0, p1 FROM p WHERE p1 < p2 AND p1 < p0'))
def g09(spark, sf):
    at = lambda s: s.withColumn("high", F.col("price")).withColumn("low", F.col("price"))
    return KS.in_time(keyed(spark, sf, BN.kernel("swings"), "swings", at))


@query("g10_alerts", "user_id:i tie:i zone:i at_value:f",
       with_sql(TICKS_SQL, "z AS (SELECT user_id, tie, ts, price, CASE WHEN price > 120 THEN 1 WHEN price < 5 THEN -1 ELSE 0 END AS zone FROM ticks)", "e AS (SELECT *, lag(zone, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, tie) AS p FROM z)",
                body="SELECT user_id, tie, zone, price AS at_value FROM e WHERE zone <> p AND zone <> 0"))
def g10(spark, sf):
    return KS.in_time(keyed(spark, sf, BN.kernel("alerts", "price", 120.0, 5.0), "alerts"))


@query("g08_indicators_by_name", "user_id:i tie:i sma:f std:f zscore:f roc:f efficiency:f stochastic:f slope:f median:f channel_high:f",
       with_sql(TICKS_SQL, WATERMARK_SQL, """w AS (SELECT user_id, tie, ts, price, row_number() OVER u AS rn, avg(price) OVER w10 AS sma, stddev_pop(price) OVER w10 AS std,
         lag(price, 5) OVER u AS p5, lag(price, 10) OVER u AS p10, max(price) OVER w14 AS hi, min(price) OVER w14 AS lo,
         median(price) OVER w9 AS med, max(price) OVER w20 AS top FROM ticks
         WINDOW u AS (PARTITION BY user_id ORDER BY ts, tie), w9 AS (PARTITION BY user_id ORDER BY ts, tie ROWS 8 PRECEDING), w10 AS (PARTITION BY user_id ORDER BY ts, tie ROWS 9 PRECEDING),
         w14 AS (PARTITION BY user_id ORDER BY ts, tie ROWS 13 PRECEDING), w20 AS (PARTITION BY user_id ORDER BY ts, tie ROWS 19 PRECEDING))""",
         """m AS (SELECT *, sum(abs(step)) OVER (PARTITION BY user_id ORDER BY rn ROWS 9 PRECEDING) AS path, regr_slope(price, rn) OVER (PARTITION BY user_id ORDER BY rn ROWS 9 PRECEDING) AS sl
         FROM (SELECT *, price - lag(price) OVER (PARTITION BY user_id ORDER BY rn) AS step FROM w))""",
         body="""SELECT user_id, tie, CASE WHEN rn >= 10 THEN sma END AS sma, CASE WHEN rn >= 10 THEN std END AS std, CASE WHEN rn >= 10 AND std > 0 THEN (price - sma) / std END AS zscore,
         CASE WHEN rn >= 6 AND p5 <> 0 THEN 100 * (price - p5) / p5 END AS roc, CASE WHEN rn >= 11 AND path > 0 THEN abs(price - p10) / path END AS efficiency,
         CASE WHEN rn >= 14 AND hi > lo THEN 100 * (price - lo) / (hi - lo) END AS stochastic, CASE WHEN rn >= 10 THEN sl END AS slope,
         CASE WHEN rn >= 9 THEN med END AS median, CASE WHEN rn >= 20 THEN top END AS channel_high FROM m, wm WHERE ts < upto"""))
def g08n(spark, sf):
    ask = {"sma": {"n": 10}, "std": {"n": 10}, "zscore": {"n": 10}, "roc": {"n": 5}, "efficiency": {"n": 10}, "slope": {"n": 10}, "median": {"n": 9}}
    ks = {name: BN.kernel(name, "price", **p) for name, p in ask.items()}
    ks |= {"stochastic": BN.kernel("stochastic", "price", "price", "price", n=14), "channel_high": BN.kernel("channel_high", "price", n=20)}
    out = KS.in_time(keyed(spark, sf, BN.together(ks), "named", delay=WAIT, delayed_hours=LATE_HOURS))
    return out.select("user_id", "tie", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ks])


@query("g10_heartbeats", "user_id:i at:t kind:s zone:i at_value:f n_rows:i",
       with_sql(TICKS_SQL, WATERMARK_SQL, "z AS (SELECT user_id, tie, ts, price, CASE WHEN price > 120 THEN 1 WHEN price < 5 THEN -1 ELSE 0 END AS zone, row_number() OVER (PARTITION BY user_id ORDER BY ts, tie) AS rn FROM ticks, wm WHERE ts < upto)",
                "e AS (SELECT *, lag(zone, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, tie) AS p FROM z)", "a AS (SELECT * FROM e WHERE zone <> p AND zone <> 0)",
                "b AS (SELECT user_id, unnest(generate_series(time_bucket(INTERVAL 12 HOUR, min(ts)) + INTERVAL 12 HOUR, max(upto), INTERVAL 12 HOUR)) AS at FROM z, wm GROUP BY user_id)",
                body="""SELECT user_id, ts AS at, 'row' AS kind, zone, price AS at_value, rn AS n_rows FROM a UNION ALL
                SELECT b.user_id, b.at, 'beat', (SELECT arg_max(zone, (a.ts, a.tie)) FROM a WHERE a.user_id = b.user_id AND a.ts < b.at),
                (SELECT arg_max(price, (a.ts, a.tie)) FROM a WHERE a.user_id = b.user_id AND a.ts < b.at), (SELECT count(*) FROM z WHERE z.user_id = b.user_id AND z.ts < b.at) FROM b"""))
def g10h(spark, sf):
    kernel = BN.kernel("alerts", "price", 120.0, 5.0)
    out = keyed(spark, sf, kernel, "beats", delay=WAIT, delayed_hours=LATE_HOURS, beat_ms=12 * 3600 * 1000)
    return out.filter("kind <> 'late'").withColumnRenamed("ts", "at")


@query("g11_stream_match", "user_id:i sig:i fill:i",
       "SELECT s.user_id, s.event_id AS sig, f.event_id AS fill FROM events s JOIN events f ON s.user_id = f.user_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 6 HOUR WHERE s.event_type = 'click' AND f.event_type = 'purchase'")
def g11(spark, sf):
    a = stream(spark, sf).filter("series_id = 'click'").select("user_id", F.col("tie").alias("sig"), F.col("ts").alias("signal_ts"))
    b = stream(spark, sf).filter("series_id = 'purchase'").select("user_id", F.col("tie").alias("fill"), F.col("ts").alias("fill_ts"))
    return drain(spark, G.stream_match(a, b, "user_id", "6 hours", "1 hour"), "match")


@query("g12_cross_section", "series_id:s ts:t close:f rk:i",
       with_sql(TICKS_SQL, f"b AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, last(price ORDER BY ticks.ts, tie) AS close FROM ticks GROUP BY 1, 2 HAVING date_trunc('hour', ticks.ts) + INTERVAL 1 HOUR <= {DONE})",
                body="SELECT *, rank() OVER (PARTITION BY ts ORDER BY close DESC) AS rk FROM b"))
def g12(spark, sf):
    base = shared_dir(spark, f"cross-{uuid.uuid4().hex}")
    bars, write = G.stream_cross_section(stream(spark, sf), "series_id", "1 hour", "1 hour", f"{base}/ranks")
    G.run_available(bars, "", f"{base}/checkpoint", batch=write)
    return spark.read.parquet(f"{base}/ranks")


@query("g13_parity", "n_stream:i n_batch:i n_apart:i",
       with_sql(TICKS_SQL, f"b AS (SELECT event_type, date_trunc('hour', ts) AS h FROM ticks GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {DONE})",
                body="SELECT count(*) AS n_stream, count(*) AS n_batch, 0 AS n_apart FROM b"))
def g13(spark, sf):
    st = drain(spark, G.stream_bars(stream(spark, sf), "series_id", "1 hour", "1 hour"), "parity")
    t = ticks(spark, sf, "event_type")
    mark = t.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("__wm"))
    bt = resample(t, "series_id", HOUR_US).join(F.broadcast(mark)).filter(F.col("available_at") <= F.col("__wm")).drop("__wm")  # one row
    cols = ["series_id", "ts", "open", "high", "low", "close", "volume", "n_ticks"]
    return G.parity_counts(st.select(*cols), bt.select(*cols))


@query("g13_kernel_parity", "n_stream:i n_batch:i n_apart:i", "SELECT count(*) AS n_stream, count(*) AS n_batch, 0 AS n_apart FROM events")
def g13k(spark, sf):
    kernel = BN.kernel("rsi", "price", 14)
    st = KS.in_time(keyed(spark, sf, kernel, "rsi"))
    bt = run_kernel(Series(ticks(spark, sf), "user_id", ["ts", "tie"]), kernel)
    return G.parity_counts(st.select("user_id", "tie", F.round("rsi", 9).alias("rsi")), bt.select("user_id", "tie", F.round("rsi", 9).alias("rsi")))


@query("g13_disordered_parity", "n_stream:i n_batch:i n_apart:i n_late:i",
       with_sql(TICKS_SQL, WATERMARK_SQL, body="SELECT count(*) AS n_stream, count(*) AS n_batch, 0 AS n_apart, 0 AS n_late FROM ticks, wm WHERE ts < upto"))
def g13d(spark, sf):
    kernel = BN.together({"ema": BN.kernel("ema", "price", 9), "macd": BN.kernel("macd", "price"), "rsi": BN.kernel("rsi", "price", 14), "wma": BN.kernel("wma", "price", 12)})
    st = keyed(spark, sf, kernel, "disordered", delay=WAIT, delayed_hours=LATE_HOURS)
    t = ticks(spark, sf)
    mark = t.agg((F.unix_millis(F.max("ts")) - 24 * 3_600_000).alias("__wm"))
    bt = run_kernel(Series(t, "user_id", ["ts", "tie"]), kernel).join(F.broadcast(mark)).filter(F.unix_millis("ts") < F.col("__wm"))  # one row
    near = lambda d: d.select("user_id", "tie", *[F.round(c, 9).alias(c) for c in ("ema", "macd", "rsi", "wma")])
    late = st.filter("kind = 'late'").agg(F.count(F.lit(1)).alias("n_late"))
    return G.parity_counts(near(KS.in_time(st)), near(bt)).join(F.broadcast(late))  # one row


@query("g14_retention", "event_id:i", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY")
def g14(spark, sf):
    e = read_table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("__now"))
    return G.expire(e.join(F.broadcast(now)), "ts", F.col("__now"), 14)  # one row


