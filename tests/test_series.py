"""Block layout: split keys give the same results as one window per key."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.operators import kernels as K
from barline.operators.asof import asof
from barline.operators.indicators import with_indicators
from barline.plans.quantiles import average_ranks, group_quantiles, ntile_labels
from barline.plans.scan import affine_scan
from barline.plans.sequential import run_kernel, walk
from barline.plans.series import Series

T0 = dt.datetime(2024, 1, 1)


def walk_table(spark, n=240, seed=3):
    """One hot key with two thirds of all rows and a few short ones."""
    rnd = random.Random(seed)
    rows = []
    for key, count in (("hot", n), ("a", n // 4), ("b", 12)):
        p, t = 100.0, T0
        for i in range(count):
            t += dt.timedelta(minutes=rnd.choice([1, 1, 2, 30]))
            o = p
            p = max(p + rnd.gauss(0, 1), 1.0)
            h, low = max(o, p) + rnd.random(), min(o, p) - rnd.random()
            rows.append((key, t, i, o, h, low, p, float(rnd.randint(1, 50))))
    return spark.createDataFrame(rows, "series_id string, ts timestamp, tie long, open double, high double, low double, close double, volume double")


def collected(df, cols, digits=6):
    out = []
    for r in df.select(*cols).collect():
        out.append(tuple(round(v, digits) if isinstance(v, float) else v for v in r))
    return sorted(out, key=str)


def test_hot_key_is_split_and_rows_kept_once(spark, small_blocks):
    df = walk_table(spark)
    s = Series(df, "series_id", ["ts", "tie"])
    assert s.is_split()
    blocks, fr = s.blocks(back_rows=5)
    assert blocks.filter("__own").count() == df.count()
    largest = blocks.groupBy(*fr.parts).count().agg(F.max("count")).collect()[0][0]
    assert largest < 200


@pytest.mark.parametrize("kind", ["sum", "count", "min", "max", "last", "first"])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_equals_plain_window(spark, small_blocks, kind, reverse):
    df = walk_table(spark).withColumn("x", F.when(F.col("tie") % 7 != 3, F.col("close")))
    got = Series(df, "series_id", ["ts", "tie"]).running({"y": (kind, F.col("x"))}, reverse=reverse)
    o = [F.col("ts").desc(), F.col("tie").desc()] if reverse else ["ts", "tie"]
    w = Window.partitionBy("series_id").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    fn = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
          "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True)}[kind]
    want = df.withColumn("y", fn("x").over(w))
    assert collected(got, ["series_id", "ts", "tie", "y"]) == collected(want, ["series_id", "ts", "tie", "y"])


def test_indicators_equal_with_and_without_split(spark):
    df = walk_table(spark)
    names = ["sma", "ema", "rsi", "macd", "adx", "aroon", "cci", "keltner", "adaptive_ma", "smi", "schaff", "stoch_rsi"]
    cols = ["series_id", "ts", "sma", "ema", "rsi", "macd_hist", "adx", "aroon_osc", "cci", "kc_upper", "adaptive_ma", "smi", "schaff", "stoch_rsi"]
    whole = collected(with_indicators(Series(df, "series_id", ["ts", "tie"], bounded_rows=240, block_rows=10_000), names), cols, 6)
    spark.conf.set("spark.barline.measureBytes", "0")
    split = collected(with_indicators(Series(df, "series_id", ["ts", "tie"], block_rows=60), names), cols, 6)
    spark.conf.unset("spark.barline.measureBytes")
    assert whole == split


def test_affine_scan_against_loop(spark, small_blocks):
    df = walk_table(spark).withColumn("a", F.when(F.col("tie") % 11 == 0, 0.0).when(F.col("tie") % 5 == 0, 1.0).otherwise(0.8))
    got = affine_scan(Series(df, "series_id", ["ts", "tie"]), "y", F.col("a"), F.col("close"), init=2.0)
    got = {(r.series_id, r.tie): r.y for r in got.collect()}
    for key in ("hot", "a", "b"):
        y = 2.0
        for r in sorted(df.filter(F.col("series_id") == key).collect(), key=lambda r: (r.ts, r.tie)):
            y = r.a * y + r.close
            assert got[(key, r.tie)] == pytest.approx(y, rel=1e-10)


KERNELS = [
    (K.parabolic_sar(), ("high", "low")),
    (K.zigzag(4.0), ("high", "low")),
    (K.box_column(1.0, 3), ("price",)),
    (K.range_bar(3.0), ("price", "volume", "at")),
    (K.range_bar(3.0, (5, 1.5, 1.0, 6.0)), ("price", "volume", "at")),
    (K.tick_reset_bar(120.0), ("price", "volume", "at")),
    (K.min_gap(600e6), ("at",)),
]


@pytest.mark.parametrize("i", range(len(KERNELS)))
def test_kernels_split_equals_sequential_walk(spark, small_blocks, i):
    """Blocks that guessed a wrong start state are run again until all states agree."""
    kernel, inputs = KERNELS[i]
    df = walk_table(spark, 400).withColumn("price", F.col("close")).withColumn("at", F.unix_micros("ts").cast("double"))
    out = run_kernel(Series(df, "series_id", ["ts", "tie"]), kernel, halo_rows=10)
    names = [c for c in out.columns if c not in ("series_id", "ts", "tie")]
    want = []
    for key in ("hot", "a", "b"):
        rows = sorted(df.filter(F.col("series_id") == key).collect(), key=lambda r: (r.ts, r.tie))
        _, emitted = walk(kernel, kernel.init(), [[float(r[c]) for r in rows] for c in inputs])
        want += [(key, rows[j].ts, rows[j].tie, *[round(float(v), 6) for v in r]) for j, r in emitted]
    got = [(r.series_id, r.ts, r.tie, *[round(float(r[n]), 6) for n in names]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_asof_split_equals_brute_force(spark, small_blocks):
    df = walk_table(spark, 300)
    right = df.filter("tie % 3 = 0").select("series_id", F.col("ts").alias("available_at"), F.col("close").alias("seen"))
    left = df.select("series_id", "ts", "tie")
    rows = right.collect()
    for direction in ("backward", "forward"):
        got = {(r.series_id, r.tie): r.seen for r in asof(left, right, "series_id", direction=direction).collect()}
        for r in left.collect():
            if direction == "backward":
                c = [(x.available_at, x.seen) for x in rows if x.series_id == r.series_id and x.available_at <= r.ts]
                want = max(c)[1] if c else None
            else:
                c = [(x.available_at, x.seen) for x in rows if x.series_id == r.series_id and x.available_at >= r.ts]
                want = min(c)[1] if c else None
            assert got[(r.series_id, r.tie)] == want


def test_asof_refuses_opening_stamp(spark):
    df = walk_table(spark, 20)
    with pytest.raises(ValueError):
        asof(df.select("series_id", "ts"), df.select("series_id", "ts", "close"), "series_id", right_ts="ts")


def test_quantiles_and_ranks_without_gathering(spark, small_blocks):
    df = walk_table(spark).withColumn("x", F.round("close", 1))
    got = {r.series_id: (r.a, r.b) for r in group_quantiles(df, "series_id", "x", {"a": 0.25, "b": 0.9}).collect()}
    want = {r.series_id: tuple(r.q) for r in df.groupBy("series_id").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.9))).alias("q")).collect()}
    for k in want:
        assert got[k] == pytest.approx(want[k])
    ranks = average_ranks(df, "series_id", "x", "r").collect()
    xs = [r.x for r in ranks if r.series_id == "hot"]
    for r in ranks:
        if r.series_id == "hot":
            assert r.r == pytest.approx(sum(v < r.x for v in xs) + (xs.count(r.x) + 1) / 2)
    labels = ntile_labels(df, None, ["ts", "tie"], 7, "f")
    sizes = sorted(r["count"] for r in labels.groupBy("f").count().collect())
    assert max(sizes) - min(sizes) <= 1


def test_a_hot_derived_series_is_written_once(spark, small_blocks):
    from barline.plans.series import Series, reads_files_alone

    a = spark.range(300).selectExpr("id % 2 AS k", "id AS i")
    s = Series(a.join(spark.range(300).withColumnRenamed("id", "i"), "i").select("k", "i"), "k", ["i"])
    assert not reads_files_alone(s.df)
    got = s.numbered("rn").collect()
    assert reads_files_alone(s.df) and sorted(r.rn for r in got if r.k == 0) == list(range(1, 151))


def test_dates_are_looked_up_once(spark):
    """Next calendar day of rows that repeat few instants; none after the last one or for null."""
    import datetime as dt

    from barline.operators.asof import next_after

    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    left = spark.createDataFrame([(i, day(i % 5) if i % 7 else None) for i in range(40)], "i int, t timestamp")
    cal = spark.createDataFrame([(day(1),), (day(3),), (day(3),)], "c timestamp")
    got = {r.i: r.nxt for r in next_after(left, cal, "t", "c", "nxt").collect()}
    assert got == {i: ([day(1), day(3), day(3), None, None][i % 5] if i % 7 else None) for i in range(40)}
