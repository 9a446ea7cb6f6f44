"""Vector recurrences in blocks and a tree of blocks against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators.outcomes import ceiling
from barline.plans.matrixscan import act, block_starts, fold, matrix_fold, matrix_scan, scan
from barline.plans.series import Series

N = 3


def maps(kind, rows, seed=1):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=(rows, N, N)) * 0.5, r.normal(size=(rows, N))
    if kind == "max":
        a[r.random(a.shape) < 0.3] = -np.inf
    return a, b


def loop(kind, a, b, x):
    out = []
    for i in range(len(a)):
        if kind == "plus":
            x = a[i] @ x + b[i]
        else:
            x = np.array([max(max(a[i][p][q] + x[q] for q in range(N)), b[i][p]) for p in range(N)])
        out.append(x)
    return np.array(out)


@pytest.mark.parametrize("kind", ["plus", "max"])
@pytest.mark.parametrize("rows", [1, 2, 3, 17, 100])
def test_composed_maps_equal_the_loop(kind, rows):
    a, b = maps(kind, rows)
    start = np.array([1.0, -2.0, 0.5])
    want = loop(kind, a, b, start)
    assert np.allclose(scan(kind, a, b, start), want, rtol=1e-10)
    assert np.allclose(act(kind, *fold(kind, a, b), start), want[-1], rtol=1e-10)


@pytest.mark.parametrize("kind", ["plus", "max"])
def test_tree_of_several_levels_with_gaps_and_a_null_key(spark, kind):
    a, b = maps(kind, 41)
    rows, blocks = [], {None: list(range(0, 41)), "gaps": [0, 1, 7, 8, 9, 30, 40], "one": [5]}
    for key, at in blocks.items():
        rows += [(key, i, a[i].ravel().tolist(), b[i].tolist()) for i in at]
    folds = spark.createDataFrame(rows, "k string, __blk long, __A array<double>, __b array<double>")
    init = [0.1, 0.2, 0.3]
    got = {(r.k, r["__blk"]): r["__x0"] for r in block_starts(folds, ["k"], init, kind, radix=3).collect()}
    assert len(got) == len(rows)
    for key, at in blocks.items():
        want = [np.array(init), *loop(kind, a[at], b[at], np.array(init))]
        for i, x in zip(at, want):
            assert np.allclose(got[(key, i)], x, rtol=1e-10)
    assert block_starts(folds.limit(0), ["k"], init, kind, radix=3).count() == 0


def table(spark, hot=330):
    r = np.random.default_rng(5)
    rows = [(k, i, float(r.uniform(0, 1)), None if i % 9 == 4 else float(r.normal())) for k, n in (("hot", hot), ("a", 30), ("b", 1)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, at long, u double, y double").repartition(4), rows


def row_maps():
    def terms(cols):  # inside a function, so that workers need not import this file
        u, y = cols["u"], np.nan_to_num(cols["y"])
        a = np.stack((np.stack((u, -u / 2), 1), np.stack((u / 3, np.ones_like(u)), 1)), 1)
        return a, np.stack((y, -y), 1)

    return terms


@pytest.mark.parametrize("split", [False, True])
def test_scan_and_fold_of_a_table(spark, request, split):
    if split:
        request.getfixturevalue("small_blocks")
    df, rows = table(spark)
    series = Series(df, "k", ["at"])
    assert series.is_split() == split
    got = {(r.k, r.at): (r.p, r.q) for r in matrix_scan(series, ["u", "y"], ["p", "q"], row_maps(), [1.0, 2.0]).collect()}
    ends = {r.k: (r.p, r.q) for r in matrix_fold(series, ["u", "y"], ["p", "q"], row_maps(), [1.0, 2.0]).collect()}
    assert len(got) == len(rows)
    for key in ("hot", "a", "b"):
        p, q = 1.0, 2.0
        for _, at, u, y in [x for x in rows if x[0] == key]:
            y = y or 0.0
            p, q = u * p - u / 2 * q + y, u / 3 * p + q - y
            assert got[(key, at)] == pytest.approx((p, q), rel=1e-9)
        assert ends[key] == pytest.approx((p, q), rel=1e-9)


@pytest.mark.parametrize("split", [False, True])
def test_ceiling_equals_dynamic_programming(spark, request, split):
    if split:
        request.getfixturevalue("small_blocks")
    df, rows = table(spark)
    got = {r.k: r.ceiling for r in ceiling(Series(df, "k", ["at"]), "u", 0.2).collect()}
    for key in ("hot", "a"):
        best = (0.0, -np.inf, -np.inf)
        price = [x[2] for x in rows if x[0] == key]
        for x in np.diff(price):
            f, l, s = best
            best = (max(f, l, s), max(f - 0.2, l, s - 0.2) + x, max(f - 0.2, l - 0.2, s) - x)
        assert got[key] == pytest.approx(max(best), abs=1e-9)
    assert "b" not in got


def test_an_empty_table_gives_an_empty_one(spark):
    df, _ = table(spark)
    series = Series(df.filter(F.lit(False)), "k", ["at"])
    assert matrix_scan(series, ["u", "y"], ["p", "q"], row_maps(), [1.0, 2.0]).count() == 0
