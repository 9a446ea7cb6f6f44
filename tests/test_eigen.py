"""Eigen-factor scores against the definition, window by window."""

import datetime as dt

import numpy as np

from barline.operators.xsection import eigen_residual, eigen_scores


def one_window(rows, k):
    """Factors, regression and AR(1) of one window, step by step."""
    risk = rows.std(axis=0)
    z = (rows - rows.mean(axis=0)) / risk
    values, vectors = np.linalg.eigh(np.corrcoef(z, rowvar=False))
    weights = vectors[:, np.argsort(values)[::-1][:k]].T / risk
    factors = np.column_stack([np.ones(len(rows)), rows @ weights.T])
    beta, *_ = np.linalg.lstsq(factors, rows, rcond=None)
    path = np.cumsum(rows - factors @ beta, axis=0)
    out = []
    for x in path.T:
        slope, level = np.polyfit(x[:-1], x[1:], 1)
        if not 0 < slope < 1:
            out.append((np.nan, np.nan))
            continue
        noise = x[1:] - level - slope * x[:-1]
        out.append(((x[-1] - level / (1 - slope)) / np.sqrt(noise.var() / (1 - slope**2)), -np.log(slope)))
    return np.array(out).T


def returns(n=160, cols=5):
    rng = np.random.default_rng(2)
    return 3.0 + rng.normal(size=(n, 1)) @ rng.normal(size=(1, cols)) + 0.6 * rng.normal(size=(n, cols))


def test_stacked_windows_match_single_ones():
    x = returns()
    for window, k in ((30, 1), (45, 2)):
        scores, speeds = eigen_scores(x, window, k)
        assert len(scores) == len(x) - window + 1 and np.isfinite(scores).mean() > 0.5
        for i in range(len(scores)):
            s, v = one_window(x[i : i + window], k)
            np.testing.assert_allclose(scores[i], s, rtol=1e-6, atol=1e-8)
            np.testing.assert_allclose(speeds[i], v, rtol=1e-6, atol=1e-8)
    assert eigen_scores(x[:10], 30, 1)[0].shape == (0, 5)


def test_blocks_of_rows(spark, monkeypatch):
    x = returns(5000, 3)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "ts timestamp, a double, b double, c double").repartition(6)
    got = sorted(eigen_residual(df, "ts", ["a", "b", "c"], 40, 1).collect(), key=lambda r: r.ts)
    scores, speeds = eigen_scores(x, 40, 1)
    none = lambda a: [None if np.isnan(v) else v for v in a]
    assert [r.ts for r in got] == [r[0] for r in rows[39:]]
    near = lambda a, b: all((u is None) == (v is None) and (u is None or abs(u - v) < 1e-6) for u, v in zip(a, b, strict=True))
    assert all(near([r.s_a, r.s_b, r.s_c, r.k_a], [*none(s), none(v)[0]]) for r, s, v in zip(got, scores, speeds, strict=True))
