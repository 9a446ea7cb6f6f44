"""Cross-sections, factors, lead-lag, transitions, regressions on moments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.asof import asof
from barline.operators.joins import signed_explode
from barline.plans.series import Series, as_list


def xs_rank(df: DataFrame, ts: str | Sequence[str], score: str, tie: str, tiles: int = 5) -> DataFrame:
    """Rank, dense rank, percent rank and tile inside each instant, best first.

    Distinct scores are counted first; ranks are running sums over them, so an
    instant with very many members is cut into blocks of the score.
    """
    keys = as_list(ts)
    rows = df.filter(F.col(score).isNotNull()).withColumn("__neg", -F.col(score))
    vc = rows.groupBy(*keys, "__neg").agg(F.count(F.lit(1)).alias("__n"))
    cum = Series(vc, keys, ["__neg"]).running({"__c": ("sum", F.col("__n")), "dense": ("count", F.lit(1))})
    ranks = cum.select(*keys, "__neg", (F.col("__c") - F.col("__n") + 1).alias("rk"), "dense")
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__t"))
    j = Series(rows, keys, ["__neg", tie]).numbered("__rn").join(ranks, [*keys, "__neg"]).join(n, keys)
    base, extra = F.floor(F.col("__t") / tiles), F.col("__t") % tiles
    big = (base + 1) * extra
    tile = F.when(F.col("__rn") <= big, F.ceil(F.col("__rn") / (base + 1))).otherwise(extra + F.ceil((F.col("__rn") - big) / base))
    pct = F.when(F.col("__t") > 1, (F.col("rk") - 1) / (F.col("__t") - 1)).otherwise(0.0)
    return j.withColumn("pct", pct).withColumn("tile", tile).drop("__neg", "__rn", "__t")


def strength_spread(returns: DataFrame, bridge: DataFrame, key: str, ts: str, ret: str) -> DataFrame:
    """Entity strength = mean of signed returns; z across entities; spread base - quote per pair."""
    signed = signed_explode(returns.select(key, ts, ret), bridge, key)
    strength = signed.groupBy("entity", ts).agg(F.avg(F.col("sign") * F.col(ret)).alias("strength"))
    # moments of a cross-section by a partial aggregate, joined back on the instant
    m = strength.groupBy(ts).agg(F.avg("strength").alias("__m"), F.stddev_pop("strength").alias("__s"))
    z = strength.join(m, ts).select("entity", ts, F.when(F.col("__s") > 0, (F.col("strength") - F.col("__m")) / F.col("__s")).alias("z"))
    legs = returns.select(key, ts).join(bridge, key).join(z, ["entity", ts])
    return legs.groupBy(key, ts).agg(F.sum(F.col("sign") * F.col("z")).alias("spread"), F.count("z").alias("n_legs"))


COST_BASE = 150.0  # fixed value: added to the cost in the economic factor


def economic_factor(unit_value: Column, margin: Column, cost: Column) -> Column:
    """Value of a unit move per root of the margin, less the dearer it is to trade."""
    return unit_value / F.sqrt(margin) / (COST_BASE + cost)


def tradeability(d: DataFrame, econ: Column, adxr: Column, atr: Column, ts: str, key: str) -> DataFrame:
    """Directional movement x volatility x economic factor, ranked at each instant."""
    scored = d.withColumn("tradeability", adxr * atr * econ).filter(F.col("tradeability").isNotNull())
    return xs_rank(scored, ts, "tradeability", key)


def triangulate(df: DataFrame, ts: str, numeraire: str, legs: dict[str, tuple[str, str]]) -> DataFrame:
    """Entity against the numeraire from pair prices; pairs quoted the other way are inverted.

    ``df`` is a wide panel, ``legs`` maps a price column to (base, quote).
    """
    out = [F.col(ts)]
    for col, (base, quote) in legs.items():
        if quote == numeraire:
            out.append(F.col(col).alias(f"{base}_{numeraire}"))
        elif base == numeraire:
            out.append(F.when(F.col(col) != 0, 1.0 / F.col(col)).alias(f"{quote}_{numeraire}"))
    wide = df.select(*out)
    names = [c for c in wide.columns if c != ts]
    logs = sum((F.log(F.col(c)) for c in names), F.lit(0.0)) / (len(names) + 1)
    return wide.withColumn(f"{numeraire}_index", F.exp(-logs))


def factor_scores(
    prices: DataFrame, levels: DataFrame, rates: DataFrame, dates: DataFrame, entity: str,
    price: str = "price", level: str = "level", rate: str = "rate", skip: int = 1, look: int = 12,
) -> DataFrame:
    """Carry, momentum and value of each entity at each date, all known by then.

    Carry is the rate; momentum the log price ``skip`` months ago over that ``look`` months
    ago; value the log price over the price level. Look-ups are as-of joins (``levels`` and
    ``rates`` bring ``available_at``); a missing or non-positive input gives null.
    """
    paid = prices.select(entity, F.col("ts").alias("available_at"), F.col(price).alias("__p"))
    d = dates
    for name, months in (("p_now", 0), ("p_skip", skip), ("p_look", look)):
        d = d.withColumn("__at", F.add_months("date", -months).cast("timestamp"))
        d = asof(d, paid.withColumnRenamed("__p", name), entity, left_ts="__at").drop("__at")
    for table, column, name in ((levels, level, "__level"), (rates, rate, "carry")):
        d = d.withColumn("__at", F.col("date").cast("timestamp"))
        d = asof(d, table.select(entity, "available_at", F.col(column).alias(name)), entity, left_ts="__at").drop("__at")
    ratio = lambda x, y: F.when((F.col(x) > 0) & (F.col(y) > 0), F.log(x) - F.log(y))
    return d.withColumn("momentum", ratio("p_skip", "p_look")).withColumn("value", ratio("p_now", "__level")).drop("__level")


def rank_composite(d: DataFrame, by: str, factors: Sequence[str], tie: str) -> DataFrame:
    """Mean of the available ranks (1 = lowest) per date."""
    out = d
    for f in factors:
        r = xs_rank(d, by, f, tie).select(by, tie, F.col("rk").alias(f"__r_{f}"))
        n = d.filter(F.col(f).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias(f"__n_{f}"))
        out = out.join(r, [by, tie], "left").join(n, by, "left")
        out = out.withColumn(f"rank_{f}", F.col(f"__n_{f}") - F.col(f"__r_{f}") + 1).drop(f"__r_{f}", f"__n_{f}")
    ranks = [F.col(f"rank_{f}") for f in factors]
    have = sum((r.isNotNull().cast("int") for r in ranks), F.lit(0))
    total = sum((F.coalesce(r.cast("double"), F.lit(0.0)) for r in ranks), F.lit(0.0))
    return out.withColumn("composite", F.when(have > 0, total / have))


def inverse_vol(returns: Series, n: int, ret: str, dates: DataFrame, entity: str) -> DataFrame:
    """Weights proportional to 1/vol, vol as of each date, summing to one per date."""
    from barline.operators.windows import roll

    vol = returns.columns(lambda fr: {"vol": roll(fr, F.col(ret), n, "std")}, back_rows=n)
    right = vol.select(*returns.key, F.col(returns.order[0]).alias("available_at"), "vol").filter(F.col("vol") > 0)
    d = asof(dates, right, entity, left_ts="date").withColumn("__i", 1.0 / F.col("vol"))
    total = d.groupBy("date").agg(F.sum("__i").alias("__t"))
    return d.join(total, "date").withColumn("weight", F.col("__i") / F.col("__t")).drop("__i", "__t")


def transition_signal(series: Series, n: int, threshold: float, price: str = "close") -> DataFrame:
    """Three-state label from an n-bar return; P(up)-P(down) from past transitions only."""
    key = list(series.key)
    d = series.columns(lambda fr: {"__r": F.try_divide(F.col(price), F.lag(price, n).over(fr.w())) - 1}, back_rows=n)
    d = d.withColumn("state", F.when(F.col("__r") > threshold, 1).when(F.col("__r") < -threshold, -1).when(F.col("__r").isNotNull(), 0))
    s = series.with_df(d)
    d = s.columns(lambda fr: {"__from": F.lag("state").over(fr.w())}, back_rows=1)
    s = series.with_df(d)
    # transitions seen up to now, counted per origin state
    run = s.running({
        f"__{o}_{t}": ("sum", F.when((F.col("__from") == o) & (F.col("state") == t), 1).otherwise(0))
        for o in (-1, 0, 1) for t in (-1, 0, 1)
    })

    def pick(t):
        return F.coalesce(*[F.when(F.col("state") == o, F.col(f"__{o}_{t}")) for o in (-1, 0, 1)])

    total = pick(-1) + pick(0) + pick(1)
    sig = F.when(total > 0, (pick(1) - pick(-1)) / total)
    return run.withColumn("signal", sig).select(*key, *series.order, "state", "signal")


def coint_residual(panel: DataFrame, ts: str, a: str, b: str, until: Column) -> DataFrame:
    """Spread a - (alpha + beta b) with in-sample coefficients, on every row."""
    fit = panel.filter(until).agg(F.regr_slope(a, b).alias("__beta"), F.regr_intercept(a, b).alias("__alpha"))
    return panel.join(F.broadcast(fit)).withColumn(  # one row
        "resid", F.col(a) - F.col("__alpha") - F.col("__beta") * F.col(b)
    ).select(ts, a, b, F.col("__alpha").alias("alpha"), F.col("__beta").alias("beta"), "resid")


def adf_t(series: Series, x: str) -> DataFrame:
    """t-statistic of the slope of dx[t] on x[t-1], from one aggregate of moments."""
    d = series.columns(lambda fr: {"__p": F.lag(x).over(fr.w())}, back_rows=1).filter(F.col("__p").isNotNull())
    y = F.col(x) - F.col("__p")
    g = d.groupBy(*series.key).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, F.col("__p")).alias("slope"),
        F.regr_sxx(y, F.col("__p")).alias("__sxx"), F.regr_syy(y, F.col("__p")).alias("__syy"), F.regr_sxy(y, F.col("__p")).alias("__sxy"))
    sse = F.col("__syy") - F.col("slope") * F.col("__sxy")
    se = F.sqrt(sse / (F.col("n") - 2) / F.col("__sxx"))
    return g.select(*series.key, "n", "slope", (F.col("slope") / se).alias("t_stat"))


def lead_lag(panel: DataFrame, ts: str, target: str, legs: tuple[str, str]) -> DataFrame:
    """Fit target = sum of legs, then correlate each leg's change with the next residual and back."""
    a, b = legs
    s = Series(panel, None, [ts])
    d = s.columns(lambda fr: {f"__d_{x}": F.col(x) - F.lag(x).over(fr.w()) for x in (target, a, b)}, back_rows=1)
    d = d.withColumn("__resid", F.col(f"__d_{target}") - F.col(f"__d_{a}") - F.col(f"__d_{b}"))
    d = s.with_df(d).columns(lambda fr: {**{f"__l_{x}": F.lag(f"__d_{x}").over(fr.w()) for x in (a, b)}, "__l_r": F.lag("__resid").over(fr.w())}, back_rows=2)
    return d.agg(
        *[F.corr(f"__l_{x}", "__resid").alias(f"lead_{x}") for x in (a, b)],
        *[F.corr("__l_r", f"__d_{x}").alias(f"back_{x}") for x in (a, b)],
        F.count("__l_r").alias("n"),
    )


def xcorr(df: DataFrame, key: str | Sequence[str] | None, order: Sequence[str], a: str, b: str, max_lag: int) -> DataFrame:
    """corr(a[t-lag], b[t]) for lags 0..L, all lags in one pass of lag columns."""
    s = Series(df, key, list(order))
    keys = as_list(key)
    d = s.columns(lambda fr: {f"__a{k}": F.lag(a, k).over(fr.w()) for k in range(max_lag + 1)}, back_rows=max_lag)
    row = d.groupBy(*keys).agg(*[F.corr(f"__a{k}", b).alias(f"__c{k}") for k in range(max_lag + 1)])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__c{k}").alias("corr")) for k in range(max_lag + 1)])
    return row.select(*keys, F.explode(cells).alias("__x")).select(*keys, "__x.lag", "__x.corr")


def _moment_matrix(d: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """X'X of listed columns as one aggregate row (size fixed by the number of columns)."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = d.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"m{i}_{j}") for i, j in pairs]).collect()[0]
    m = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        m[i, j] = m[j, i] = float(row[f"m{i}_{j}"] or 0.0)
    return m


def granger(df: DataFrame, key: str | Sequence[str] | None, order: Sequence[str], cause: str, effect: str, lags: int) -> DataFrame:
    """F-statistic of adding lags of ``cause`` to an autoregression of ``effect``.

    Only the moment matrix leaves the cluster. Both series are centred first: the fit has an
    intercept, so nothing changes but the digits that large levels would cost.
    """
    level = df.agg(F.avg(cause).alias("c"), F.avg(effect).alias("e")).first()
    df = df.withColumns({cause: F.col(cause) - F.lit(level["c"] or 0.0), effect: F.col(effect) - F.lit(level["e"] or 0.0)})
    s = Series(df, key, list(order))
    d = s.columns(
        lambda fr: {**{f"__y{k}": F.lag(effect, k).over(fr.w()) for k in range(1, lags + 1)},
                    **{f"__x{k}": F.lag(cause, k).over(fr.w()) for k in range(1, lags + 1)}}, back_rows=lags
    ).filter(F.col(f"__y{lags}").isNotNull()).withColumn("__one", F.lit(1.0))
    own = ["__one", *[f"__y{k}" for k in range(1, lags + 1)]]
    allv = [*own, *[f"__x{k}" for k in range(1, lags + 1)]]
    m = _moment_matrix(d, [*allv, effect])
    n = m[0, 0]

    def ssr(k: int) -> float:
        beta = np.linalg.lstsq(m[:k, :k], m[:k, -1], rcond=None)[0]
        return float(m[-1, -1] - beta @ m[:k, -1])

    r, u = ssr(len(own)), ssr(len(allv))
    dof = n - len(allv)
    f = (r - u) / lags / (u / dof) if u > 0 and dof > 0 else float("nan")
    return df.sparkSession.createDataFrame([(cause, effect, int(n), float(f), float(r), float(u))], "cause string, effect string, n long, f_stat double, ssr_restricted double, ssr_full double")


def transfer_entropy(series: Series, src: str, dst: str, lag: int = 1) -> DataFrame:
    """H(dst', dst) + H(dst, src) - H(dst) - H(dst', dst, src) of binary columns, in bits."""
    d = series.columns(lambda fr: {"__s": F.lag(src, lag).over(fr.w()), "__d": F.lag(dst, lag).over(fr.w())}, back_rows=lag)
    d = d.filter(F.col("__s").isNotNull() & F.col("__d").isNotNull()).groupBy(*series.key, F.col(dst).alias("__f"), "__d", "__s").agg(F.count(F.lit(1)).alias("__n"))
    keys = list(series.key)

    def h(cols):
        cells = d.groupBy(*keys, *cols).agg(F.sum("__n").alias("__m"))
        return cells.groupBy(*keys).agg((F.log2(F.sum("__m").cast("double")) - F.sum(F.col("__m") * F.log2(F.col("__m").cast("double"))) / F.sum("__m")).alias("__h"))

    parts = {"a": ["__f", "__d"], "b": ["__d", "__s"], "c": ["__d"], "e": ["__f", "__d", "__s"]}
    out = None
    for n, cols in parts.items():
        hn = h(cols).withColumnRenamed("__h", f"__h{n}")
        out = hn if out is None else (out.join(hn, keys) if keys else out.join(F.broadcast(hn)))
    return out.select(*keys, (F.col("__ha") + F.col("__hb") - F.col("__hc") - F.col("__he")).alias("te"))


def eigen_scores(x: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and reversion speeds (windows by series) of every window of rows.

    Moments of all windows come from prefix sums, factors from one stacked eigen
    decomposition of the correlations. Factors are weighted by risk (vectors over
    deviations) and each series is regressed on them with an intercept. An AR(1) is fitted
    to the running sum of its residuals: the score is the distance of the last value from
    the equilibrium a / (1 - b) in equilibrium deviations, the speed -ln b. Both are NaN
    unless 0 < b < 1.
    """
    length, n = x.shape
    ends = length - window + 1
    if ends <= 0:
        return np.empty((0, n)), np.empty((0, n))
    centred = x - x.mean(axis=0)
    first, second = (np.concatenate((np.zeros((1, *p.shape[1:])), np.cumsum(p, axis=0))) for p in (centred, centred[:, :, None] * centred[:, None, :]))
    mean = (first[window:] - first[:-window]) / window
    cov = (second[window:] - second[:-window]) / window - mean[:, :, None] * mean[:, None, :]
    risk = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0.0))
    risk = np.where(risk > 0, risk, 1e-12)
    _, vectors = np.linalg.eigh(cov / risk[:, :, None] / risk[:, None, :])
    q = np.swapaxes(vectors[:, :, -k:], 1, 2) / risk[:, None, :]
    loads = np.linalg.pinv(q @ cov @ np.swapaxes(q, 1, 2), hermitian=True) @ q @ cov
    keep = np.eye(n) - np.swapaxes(q, 1, 2) @ loads
    scores, speeds = np.empty((ends, n)), np.empty((ends, n))
    frames = np.swapaxes(np.lib.stride_tricks.sliding_window_view(centred, window, axis=0), 1, 2)
    for at in range(0, ends, 256):
        part = slice(at, min(at + 256, ends))
        path = np.cumsum((frames[part] - mean[part, None, :]) @ keep[part], axis=1)
        before, after = path[:, :-1], path[:, 1:]
        mb, ma, vb = before.mean(axis=1), after.mean(axis=1), before.var(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            b = ((before - mb[:, None]) * (after - ma[:, None])).mean(axis=1) / vb
            a = ma - b * mb
            noise = (after - a[:, None] - b[:, None] * before).var(axis=1)
            spread = np.sqrt(noise / (1 - b * b))
            good = (vb > 1e-18) & (b > 0) & (b < 1) & (spread > 0) & (window > 10)
            scores[part] = np.where(good, (path[:, -1] - a / (1 - b)) / spread, np.nan)
            speeds[part] = np.where(good, -np.log(b), np.nan)
    return scores, speeds


def eigen_residual(wide: DataFrame, ts: str, cols: Sequence[str], window: int, k: int) -> DataFrame:
    """Score ``s_`` and reversion speed ``k_`` of each series after taking out the top-k
    risk-weighted factors of the trailing window (see ``eigen_scores``); null where the
    residual does not revert.

    Rows are numbered over all blocks; a row goes to its block and, as halo, to the next
    one, and an Arrow group solves the windows of one block together.
    """
    block = max(4 * window, 2048)
    d = Series(wide, None, [ts]).numbered("__rn").select(ts, *cols, "__rn")
    own = F.floor((F.col("__rn") - 1) / block)
    rows = d.withColumn("__b", F.explode(F.array_distinct(F.array(own, F.floor((F.col("__rn") - 2 + window) / block)))))
    names = list(cols)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn", kind="stable")
        scores, speeds = eigen_scores(pdf[names].to_numpy(dtype=float), window, k)
        ends = pdf.iloc[window - 1 :] if len(scores) else pdf.iloc[:0]
        out = pd.concat([ends[[ts]].reset_index(drop=True), pd.DataFrame(np.hstack((scores, speeds)), columns=outputs)], axis=1)
        return out[((ends["__rn"] - 1) // block == int(pdf["__b"].iloc[0])).to_numpy()]

    outputs = [f"{p}_{c}" for p in ("s", "k") for c in names]
    schema = f"{ts} timestamp, " + ", ".join(f"{c} double" for c in outputs)
    out = rows.groupBy("__b").applyInPandas(run, schema)
    return out.select(ts, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in outputs])


#: Rows of a task while a model is fitted; each boosting round reads its cached points again.
FIT_ROWS = 500_000


def fit_rows(rows: DataFrame) -> DataFrame:
    """The rows dealt over enough tasks that none holds many more than ``FIT_ROWS``."""
    tasks = -(-rows.count() // FIT_ROWS)
    return rows.repartition(tasks) if tasks > rows.rdd.getNumPartitions() else rows


def feature_importance(df: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """Importance of each feature in a gradient-boosted tree model of the label."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = fit_rows(df.select(*features, F.col(label).cast("double").alias("__y")).dropna())
    x = VectorAssembler(inputCols=list(features), outputCol="__x").transform(rows)
    model = GBTRegressor(featuresCol="__x", labelCol="__y", maxIter=trees, maxDepth=depth, seed=seed).fit(x)
    vals = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(vals, "feature string, importance double")


def select_features(df: DataFrame, features: Sequence[str], y: str, min_r: float, dedup: float) -> DataFrame:
    """Keep features with |corr(y)| >= min_r, greedily dropping ones correlated with a kept one.

    All correlations come from one aggregate row; the greedy step runs on that
    small matrix.
    """
    fs = list(features)
    pairs = [(a, b) for i, a in enumerate(fs) for b in fs[i + 1:]]
    row = df.agg(*[F.corr(f, y).alias(f"y_{i}") for i, f in enumerate(fs)], *[F.corr(a, b).alias(f"p_{i}") for i, (a, b) in enumerate(pairs)]).collect()[0]
    with_y = {f: row[f"y_{i}"] or 0.0 for i, f in enumerate(fs)}
    between = {frozenset(p): row[f"p_{i}"] or 0.0 for i, p in enumerate(pairs)}
    kept: list[str] = []
    for f in sorted(fs, key=lambda f: (-abs(with_y[f]), f)):
        if abs(with_y[f]) >= min_r and all(abs(between[frozenset((f, g))]) < dedup for g in kept):
            kept.append(f)
    return df.sparkSession.createDataFrame([(f, float(with_y[f]), int(f in kept)) for f in fs], "feature string, corr_y double, kept int")
