"""Rolling order statistics against numpy on plain and split keys."""

import numpy as np
import pytest

from barline.plans import orderstats as O
from barline.plans.series import Series


def frames(values, n):
    for i in range(len(values)):
        yield values[i], [v for v in values[max(0, i - n + 1) : i + 1] if v is not None]


def expected(values, stat):
    out = []
    for x, w in frames(values, stat.n):
        if len(w) < (1 if stat.partial else stat.n) or (stat.kind == "rank" and x is None):
            out.append(None)
        elif stat.kind == "quantile":
            out.append(np.quantile(w, stat.p))
        elif stat.kind == "rank":
            out.append((sum(v < x for v in w) + (sum(v == x for v in w) + 1) / 2) / len(w))
        elif stat.kind == "mad":
            out.append(np.median(np.abs(np.array(w) - np.median(w))))
        else:
            out.append(np.abs(np.array(w) - 1.5).mean())
    return out


STATS = {
    "q": O.OrderStat("quantile", "x", 7, 0.3), "some": O.OrderStat("quantile", "x", 30, 0.9, partial=True), "r": O.OrderStat("rank", "x", 7),
    "m": O.OrderStat("mad", "x", 8), "odd": O.OrderStat("mad", "y", 5), "d": O.OrderStat("deviation", "y", 6, centre="c"),
}


@pytest.mark.parametrize("split", [False, True])
def test_matches_numpy(spark, request, split):
    if split:
        request.getfixturevalue("small_blocks")
    rng = np.random.default_rng(1)
    rows = []
    for key, n in (("a", 150), ("b", 9), (None, 4)):
        for i in range(n):
            x = None if rng.random() < 0.1 else float(rng.integers(0, 12))
            rows.append((key, i, x, float(rng.normal()), 1.5, "kept"))
    if split:
        rows = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(rows, "k string, at long, x double, y double, c double, note string").repartition(5)
    out = Series(df, "k", ["at"]).map(lambda d, fr: O.order_statistics(d, fr, STATS), back_rows=30).collect()
    assert len(out) == len(rows) and all(r.note == "kept" for r in out)
    for key in {r[0] for r in rows}:
        got = sorted((r for r in out if r.k == key), key=lambda r: r.at)
        mine = [r for r in rows if r[0] == key]
        for name, stat in STATS.items():
            want = expected([r[2 if stat.column == "x" else 3] for r in mine], stat)
            assert [r[name] for r in got] == [None if w is None else pytest.approx(w, abs=1e-12) for w in want], name


def test_two_ended_search_on_ties_and_ends():
    rng = np.random.default_rng(5)
    for _ in range(300):
        w = sorted(rng.integers(0, 6, rng.integers(1, 12)).tolist())
        assert O.median_deviation(w, O.quantile(w, 0.5)) == np.median(np.abs(np.array(w) - np.median(w)))
        assert O.mean_deviation(w, 2.5) == pytest.approx(np.abs(np.array(w) - 2.5).mean())


def test_unknown_kind(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "k string, at long, x double")
    with pytest.raises(Exception, match="no order statistic"):
        Series(df, "k", ["at"]).map(lambda d, fr: O.order_statistics(d, fr, {"z": O.OrderStat("mode", "x", 2)})).collect()
