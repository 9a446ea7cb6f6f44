"""Operators against hand-made expectations: clocks, causality, labels, sinks, nulls."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barline.functions.clock import HOUR_US, MINUTE_US
from barline.operators import bars as B
from barline.operators import outcomes as O
from barline.operators import stats as S
from barline.operators.asof import asof
from barline.operators.indicators import INDICATORS, with_indicators
from barline.plans.series import Series
from barline.sources import sinks as K

UTC = dt.datetime


def hours(spark, start, n, step_minutes=60):
    rows = [(start + dt.timedelta(minutes=step_minutes * i), i, 100.0 + i, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "ts timestamp, tie long, price double, volume double").withColumn("k", F.lit("x"))


@pytest.mark.parametrize("start", [UTC(2024, 3, 8), UTC(2024, 11, 1)])
def test_anchored_bars_across_clock_change(spark, start):
    t = hours(spark, start, 24 * 5)
    bars = B.resample_anchored(t, "k", 4, "America/New_York", 17).orderBy("ts").collect()
    lost = 24 * 5 - sum(b.volume for b in bars)
    assert 0 <= lost <= 5  # only a bin that starts in the repeated hour is dropped
    assert {(b.ts.hour - 21) % 4 for b in bars if b.ts < UTC(2024, 3, 10)} <= {1}
    daily = B.resample_anchored(t, "k", 24, "America/New_York", 17).collect()
    assert sum(b.volume for b in daily) == 24 * 5


def test_completed_bar_is_visible_only_after_close_and_open_stamp_would_leak(spark):
    fine = hours(spark, UTC(2024, 1, 1), 48, 15)
    coarse = B.resample(fine, "k", HOUR_US)
    j = asof(fine.select("k", "ts", "price"), coarse.select("k", "available_at", "close"), "k").collect()
    for r in j:
        if r.close is not None:
            assert r.close < r.price
    bad = asof(fine.select("k", "ts", "price"), coarse.select("k", F.col("ts").alias("available_at"), "close"), "k").collect()
    assert any(r.close is not None and r.close > r.price for r in bad)


def test_asof_boundaries(spark):
    t = UTC(2024, 1, 1)
    left = spark.createDataFrame([(t,)], "ts timestamp")
    right = spark.createDataFrame([(t, 1)], "available_at timestamp, v int")
    assert asof(left, right, None).collect()[0].v == 1
    assert asof(left, right, None, strict=True).collect()[0].v is None
    assert asof(left, right, None, direction="forward").collect()[0].v == 1
    assert asof(left, right, None, direction="forward", strict=True).collect()[0].v is None


def test_stop_comes_before_target_inside_one_bar(spark):
    t = UTC(2024, 1, 1)
    bars = spark.createDataFrame(
        [("x", t + dt.timedelta(hours=i), 100.0 + d[0], 100.0 + d[1], 100.0 + d[2]) for i, d in enumerate([(1, -1, 0), (12, -12, 0), (12, 0, 5)])],
        "k string, ts timestamp, high double, low double, close double")
    ev = spark.createDataFrame([("x", t, 100.0, 1, 1), ("x", t + dt.timedelta(hours=1), 100.0, 1, 2)], "k string, event_ts timestamp, entry double, side int, id int")
    r = {x.id: x for x in O.first_passage(ev, bars, "k", 10.0, 10.0, 10 * HOUR_US, ["id"]).collect()}
    assert (r[1].label, r[1].bars_held) == (-1, 1)
    assert (r[2].label, r[2].bars_held) == (1, 1)


def test_indicators_are_null_in_warm_up_and_finite_on_flat_series(spark):
    rows = [("x", UTC(2024, 1, 1) + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, open double, high double, low double, close double, volume double")
    for chunk in (["sma", "zscore", "stochastic", "cci", "bb_position"], ["rsi", "atr", "adx", "kaufman_er", "vortex"]):
        out = with_indicators(Series(df, "series_id", ["ts"]), chunk).orderBy("ts").collect()
        for name in ("sma", "cci", "rsi", "atr"):
            if name in out[0].asDict():
                assert out[0][name] is None
        for v in out[-1].asDict().values():
            assert not (isinstance(v, float) and math.isnan(v))
    assert len(INDICATORS) >= 60


def test_random_walk_has_no_signal(spark):
    import random

    rnd = random.Random(1)
    rows = [(str(i % 5), UTC(2024, 1, 1) + dt.timedelta(minutes=i // 5), rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, x double, y double")
    assert S.sign_flip_p(df, "x", ["k", "ts"], 256, 3).collect()[0].p_value > 0.02
    for mode in ("entities", "time"):
        assert S.permutation_p(df, "k", "ts", "x", F.corr("x_perm", "y"), mode, 30).collect()[0].p_value > 0.02
    strong = df.withColumn("y", F.col("x") + 0.1 * F.col("y"))
    assert S.permutation_p(strong, "k", "ts", "x", F.corr("x_perm", "y"), "blocks", 30, block_us=10 * MINUTE_US).collect()[0].p_value < 0.05


def test_block_bootstrap_interval_holds_the_mean_and_repeats(spark):
    df = hours(spark, UTC(2024, 1, 1), 400).withColumn("x", F.sin("tie"))
    run = [S.block_bootstrap(Series(df, None, ["ts"]), "x", 20, 200).collect()[0] for _ in range(2)]
    assert run[0] == run[1]
    assert run[0].lo <= run[0].real <= run[0].hi


def test_causality_check_catches_a_centred_window(spark):
    df = hours(spark, UTC(2024, 1, 1), 60)
    cut = F.lit("2024-01-02 06:00:00").cast("timestamp")

    def trailing(d):
        return Series(d, "k", ["ts"]).columns(lambda fr: {"m": F.avg("price").over(fr.rows(-4, 0))}, back_rows=4)

    def centred(d):
        return Series(d, "k", ["ts"]).columns(lambda fr: {"m": F.avg("price").over(fr.rows(-2, 2))}, back_rows=2, fwd_rows=2)

    assert S.check_causal(trailing, df, "ts", cut).count() == 0
    assert S.check_causal(centred, df, "ts", cut).count() > 0


def test_upsert_and_dedup_are_idempotent(spark, tmp_path):
    a = spark.createDataFrame([(1, "d1", 1, 10.0), (2, "d1", 1, 20.0), (3, "d2", 1, 30.0)], "id int, day string, version int, v double")
    b = spark.createDataFrame([(2, "d1", 2, 21.0), (4, "d1", 1, 40.0)], "id int, day string, version int, v double")
    path = str(tmp_path / "t")
    for x in (a, b, b):
        K.upsert(x, path, ["id", "day"], ["version"], "day")
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, 10.0), (2, 21.0), (3, 30.0), (4, 40.0)]
    log = str(tmp_path / "l")
    for x in (a, a, b):
        K.append_dedup(x, log, ["id"])
    assert spark.read.parquet(log).count() == 4


def test_binomial_tail_is_exact(spark):
    from math import comb

    from barline.operators.stats import binomial_tail

    rows = [(h, n) for n in (1, 5, 30, 200) for h in {0, 1, n // 3, n // 2, n - 1, n}] + [(530, 1000), (470, 1000)]
    df = spark.createDataFrame(rows, "h int, n int")
    for p in (0.1, 0.5, 0.9):
        for r in df.select("h", "n", binomial_tail(F.col("h"), F.col("n"), p).alias("got")).collect():
            want = sum(comb(r.n, k) * p**k * (1 - p) ** (r.n - k) for k in range(r.h, r.n + 1))
            assert abs(r.got - want) < 1e-9, (r, p, want)


def test_adaptive_bars_start_from_the_first_moves():
    from barline.operators.kernels import range_bar
    from barline.plans.sequential import walk

    prices = [10.0, 11.0, 13.0, 14.0, 17.0, 15.0, 20.0]
    n = len(prices)
    _, rows = walk(range_bar(99.0, (2, 2.0, 1.0, 50.0)), range_bar(99.0, (2, 2.0, 1.0, 50.0)).init(), [prices, [1.0] * n, [float(i) for i in range(n)]])
    # moves 1 and 2 give a width of 3 from 13; then ranges 2 and 4 give 6 from 17
    assert [(i, r[0], r[3]) for i, r in rows] == [(4, 13.0, 17.0)]
