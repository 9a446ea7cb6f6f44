"""Keyed streaming state over several micro-batches: ties, disorder, late rows, timers."""

import datetime as dt

import numpy as np
import pytest

from barline.plans.sequential import run_kernel, walk
from barline.plans.series import Series
from barline.streaming import by_name as BN
from barline.streaming import keyed as KS
from barline.streaming import streams as G

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k long, ts timestamp, tie long, price double"


def rows(*items, k=1):
    return [(k, T0 + dt.timedelta(seconds=s), tie, float(price)) for s, tie, price in items]


def run(spark, tmp_path, batches, delay=None, kernel=None, **more):
    """One run of the stream for each batch, over one checkpoint."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/in/{i}")
        s = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/[0-{i}]")
        out = KS.keyed_kernel(s, "k", ["ts", "tie"], kernel or BN.kernel("ema", "price", 2), delay, **more)
        G.run_available(out, f"{tmp_path}/out", f"{tmp_path}/check")
    return sorted(G.read_sink(spark, f"{tmp_path}/out", out.schema).collect(), key=lambda r: (r.k, r.ts, r.tie if r.tie is not None else -1))


def seconds(found, kind, k=1):
    return [int((r.ts - T0).total_seconds()) for r in found if r.kind == kind and r.k == k]


def test_instant_cut_by_batches_loses_nothing(spark, tmp_path):
    batches = [rows((0, 1, 1), (5, 1, 2), (5, 2, 3)), rows((5, 3, 4), (6, 1, 5)), rows((6, 2, 6), (7, 1, 7))]
    got = run(spark, tmp_path, batches)
    df = spark.createDataFrame(sum(batches, []), SCHEMA)
    want = sorted(run_kernel(Series(df, "k", ["ts", "tie"]), BN.kernel("ema", "price", 2)).collect(), key=lambda r: (r.ts, r.tie))
    assert all(r.kind == "row" for r in got) and [r.n_rows for r in got] == list(range(1, 8))
    assert [(r.ts, r.tie, pytest.approx(r.ema, nan_ok=True)) for r in got] == [(r.ts, r.tie, r.ema) for r in want]


def test_without_delay_rows_behind_are_late(spark, tmp_path):
    got = run(spark, tmp_path, [rows((0, 1, 1), (9, 1, 2)), rows((4, 1, 3), (9, 1, 9), (9, 2, 4))])
    assert seconds(got, "row") == [0, 9, 9] and seconds(got, "late") == [4, 9]
    assert all(r.ema is None and r.n_rows is None for r in got if r.kind == "late")


def test_disorder_waits_for_the_watermark(spark, tmp_path):
    batches = [rows((0, 1, 1), (10, 1, 5)), rows((8, 1, 3), (30, 1, 9)), rows((7, 1, 100), (12, 1, 4), (60, 1, 1))]
    got = run(spark, tmp_path, batches, "11 seconds")
    # 0 to 10 are released behind 30; 7 comes after 10 was released; 60 waits
    assert seconds(got, "row") == [0, 8, 10, 12, 30] and seconds(got, "late") == [7]
    assert [r.ema for r in got if r.kind == "row"][1:3] == pytest.approx([2.0, 2 + 2 / 3 * 3])


def test_an_idle_key_releases_its_rows(spark, tmp_path):
    batches = [rows((0, 1, 1), (1, 1, 2)) + rows((0, 1, 7), k=2), rows((100, 1, 3), k=2)]
    got = run(spark, tmp_path, batches, "10 seconds")
    assert seconds(got, "row") == [0, 1] and seconds(got, "row", 2) == [0]


def test_heartbeats_and_end_of_life(spark, tmp_path):
    batches = [rows((1, 1, 200), (12, 1, 3)) + rows((1, 1, 50), k=2), rows((61, 1, 50), k=2), rows((70, 1, 500)) + rows((200, 1, 50), k=2)]
    kernel = BN.kernel("alerts", "price", 100.0, 5.0)
    got = run(spark, tmp_path, batches, "1 second", kernel, beat_ms=10_000, ttl_ms=30_000)
    mine = [(int((r.ts - T0).total_seconds()), r.kind, r.zone, r.n_rows) for r in got if r.k == 1]
    # beats until 30 s after the last row; then the key is forgotten, and begins anew at 70
    assert mine == [(1, "row", 1, 1), (10, "beat", 1, 1), (12, "row", -1, 2), (20, "beat", -1, 2), (30, "beat", -1, 2), (40, "beat", -1, 2),
                    (70, "row", 1, 1), (80, "beat", 1, 1), (90, "beat", 1, 1), (100, "beat", 1, 1)]
    assert all(r.zone is None for r in got if r.k == 2)


def test_heartbeats_need_a_watermark(spark):
    df = spark.readStream.format("rate").load().selectExpr("value AS k", "timestamp AS ts", "value AS tie", "1D AS price")
    with pytest.raises(ValueError):
        KS.keyed_kernel(df, "k", ["ts", "tie"], BN.kernel("ema", "price", 2), beat_ms=5)


@pytest.mark.parametrize("name", sorted(BN.INDICATORS))
def test_named_indicators_together(name):
    """Run with another indicator, and against numpy over whole frames."""
    rng = np.random.default_rng(3)
    close = 100 + rng.normal(size=80).cumsum()
    high, low = close + rng.random(80), close - rng.random(80)
    table = {"close": close, "high": high, "low": low}
    kernel = BN.together({"other": BN.kernel("ema", "low", 5), name: BN.kernel(name)})
    _, out = walk(kernel, kernel.init(), [table[c].tolist() for c in kernel.inputs])
    got = np.array([r[1] for _, r in out])
    alone = BN.kernel(name)
    _, single = walk(alone, alone.init(), [table[c].tolist() for c in alone.inputs])
    np.testing.assert_array_equal(got, [r[0] for _, r in single])
    frames = {
        "sma": (20, lambda i: close[i - 19 : i + 1].mean()),
        "zscore": (20, lambda i: (close[i] - close[i - 19 : i + 1].mean()) / close[i - 19 : i + 1].std()),
        "roc": (11, lambda i: 100 * (close[i] / close[i - 10] - 1)),
        "slope": (14, lambda i: np.polyfit(np.arange(14), close[i - 13 : i + 1], 1)[0]),
        "stochastic": (14, lambda i: 100 * (close[i] - low[i - 13 : i + 1].min()) / (high[i - 13 : i + 1].max() - low[i - 13 : i + 1].min())),
        "wma": (20, lambda i: np.average(close[i - 19 : i + 1], weights=np.arange(1, 21))),
    }
    if name in frames:
        n, value = frames[name]
        assert np.isnan(got[: n - 1]).all()
        np.testing.assert_allclose(got[n - 1 :], [value(i) for i in range(n - 1, 80)])
    if name == "atr":
        true = [max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(1, 80)]
        want = [np.mean(true[:14])]
        for x in true[14:]:
            want.append((want[-1] * 13 + x) / 14)
        np.testing.assert_allclose(got[14:], want)


def test_parts_hold_each_row_once_and_in_order(spark, tmp_path, monkeypatch):
    """Cuts that come out differently each time they are computed (approximate quantiles of
    large tables do) neither lose nor repeat a row."""
    from pyspark.sql import functions as F

    from barline.catalog import streaming as C

    spark.range(300).selectExpr("id AS event_id", "timestamp_seconds(id div 3) AS ts", "0L AS user_id", "1D AS value").write.parquet(f"{tmp_path}/events.parquet")
    unsteady = lambda c, q: F.array(*[F.timestamp_seconds((F.max(F.unix_seconds(c)) * x + F.lit(1) + F.floor(F.rand() * 20)).cast("long")) for x in q])
    monkeypatch.setattr(C.F, "percentile_approx", unsteady)
    base, schema = C.parts(spark, str(tmp_path))
    rows = [(r.part, r.event_id) for r in spark.read.parquet(base).collect()]
    assert sorted(i for _, i in rows) == list(range(300))
    assert [i for _, i in sorted(rows)] == list(range(300)) and {p for p, _ in rows} == {0, 1, 2}


@pytest.mark.parametrize("delayed_hours", [0, 12])
def test_parts_survive_cuts_that_change_with_each_job(spark, tmp_path, monkeypatch, delayed_hours):
    """A seeded draw repeats from job to job; these cuts come from the JVM's own random source."""
    from pyspark.sql import functions as F

    from barline.catalog import streaming as C

    spark.range(3000).selectExpr("id AS event_id", "timestamp_seconds(id div 3 * 60) AS ts", "0L AS user_id", "1D AS value").write.parquet(f"{tmp_path}/events.parquet")
    draw = lambda: F.expr("CAST(java_method('java.lang.Math', 'random') AS double)")
    unsteady = lambda c, q: F.array(*[F.timestamp_seconds((F.max(F.unix_seconds(c)) * x * (F.lit(0.5) + draw())).cast("long")) for x in q])
    monkeypatch.setattr(C.F, "percentile_approx", unsteady)
    base, schema = C.parts(spark, str(tmp_path), delayed_hours)
    found = [r.event_id for r in spark.read.schema(schema).parquet(f"{base}/*").collect()]
    assert sorted(found) == list(range(3000))


class _Calls:
    """States in memory that count their calls."""

    def __init__(self):
        self.map, self.value, self.n, self.timers = {}, None, 0, set()

    def __getattr__(self, name):
        act = {
            "getValueState": lambda *a: self, "getMapState": lambda *a: self, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v),
            "keys": lambda: iter(list(self.map)), "getValue": lambda k: self.map[tuple(k)], "updateValue": lambda k, v: self.map.__setitem__(tuple(k), v),
            "containsKey": lambda k: tuple(k) in self.map, "removeKey": lambda k: self.map.pop(tuple(k)),
            "registerTimer": self.timers.add, "deleteTimer": self.timers.discard, "getCurrentWatermarkInMs": lambda: self.now,
        }[name]

        def call(*a):
            self.n += 1
            return act(*a)

        return call


@pytest.mark.parametrize("waits", [False, True])
def test_state_calls_do_not_follow_the_rows(waits):
    import pandas as pd
    from pyspark.sql import types as T

    state = _Calls()
    m = KS._Machine(BN.kernel("ema", "price", 2), [T.StructField("tie", T.LongType())], ["ema"], waits, None, None)
    m.init(state)
    rng = np.random.default_rng(1)
    # 60,000 rows in disorder: more than are held, so runs are cut and merged again
    us = rng.permutation(60_000) * 1_000
    found = []
    for lot in (us[:30_000], us[30_000:]) if waits else (us,):
        frames = [pd.DataFrame({"us__": f, "tie": 1, "price": f.astype(float)}) for f in np.array_split(lot, 3)]
        found += list(m.handleInputRows((1,), iter(frames), state))
    if waits:
        for state.now in (20_000, 100_000):
            found += list(m.handleExpiredTimer((1,), state, None))
    got = [u for f in found for u in f["us__"]]
    assert got == sorted(us.tolist()) and not state.map and state.n < 2_000
