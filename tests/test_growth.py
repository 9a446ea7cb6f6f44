"""What is sorted or held by one task does not follow the size of the tables."""

import datetime as dt

from pyspark.sql import functions as F

from barline.operators import ledger as L

T0 = dt.datetime(2024, 1, 1)


def test_floating_equity_sorts_bars_not_trades(spark, monkeypatch):
    """Bars at odd times, trades that begin and end at, just after and far from them."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    stops = [0, 1800, 3600, 3700, 3750, 40_000]
    bars = [("a", at(s), float(s % 97), float(s % 97) + 1) for s in stops] + [("b", at(s), 5.0, 6.0) for s in stops[::2]]
    trades = [(k, at(s), at(s + held), 3.0, side, float(s % 11)) for k in "ab" for s in range(0, 9000, 50) for held, side in ((50, 1), (3650, -1))]
    seen, asof = [], L.asof
    monkeypatch.setattr(L, "asof", lambda left, right, *a, **k: seen.append(right.count()) or asof(left, right, *a, **k))
    led = spark.createDataFrame(trades, "k string, t0 timestamp, t1 timestamp, entry_price double, side int, pnl double")
    got = L.floating_equity(led, spark.createDataFrame(bars, "k string, ts timestamp, bid_c double, ask_c double"), "k", "t0", "t1", 1)
    for r in got.collect():
        marks = [(b[2] - 3.0 if x[4] > 0 else 3.0 - b[3]) for b in bars if b[1] == r.ts for x in trades if x[0] == b[0] and x[1] <= r.ts < x[2]]
        assert (r.n_open, round(r.floating, 6), r.realised) == (len(marks), round(sum(marks), 6), sum(x[5] for x in trades if x[2] <= r.ts))
    assert max(seen) < 30


def test_a_model_is_fitted_on_bounded_tasks(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor

    from barline.operators import xsection as X

    fit, tasks = GBTRegressor.fit, []
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, x: tasks.append(x.rdd.getNumPartitions()) or fit(self, x))
    monkeypatch.setattr(X, "FIT_ROWS", 50, raising=False)
    df = spark.range(0, 1000, 1, 2).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    found = {r.feature: r.importance for r in X.feature_importance(df.withColumn("y", F.col("a") * 2), ["a", "b"], "y", trees=2, depth=2).collect()}
    assert tasks == [20] and found["a"] > 0.9


def test_overlaps_are_counted_by_bounded_tasks(spark):
    from barline.operators import joins as J

    spans = [(k, i, (i * 7) % 50, (i * 7) % 50 + i % 9) for k in range(3) for i in range(100)]
    df = spark.createDataFrame(spans, "k long, i long, t0 long, t1 long")
    spark.conf.set("spark.barline.measureBytes", "0")
    spark.conf.set("spark.barline.taskRows", "50")
    try:
        out = J.overlap_counts(df, df.filter("i % 2 = 0").selectExpr("k", "t0 AS u0", "t1 AS u1"), "k", ("t0", "t1"), ("u0", "u1"), ["i"])
        got, tasks = {(r.k, r.i): r.n for r in out.collect()}, out.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.barline.measureBytes")
        spark.conf.unset("spark.barline.taskRows")
    assert got == {(k, i): sum(x[0] == k and x[1] % 2 == 0 and a <= x[3] and b >= x[2] for x in spans) for k, i, a, b in spans}
    assert tasks == 18  # of 900 marks; the session has 4
