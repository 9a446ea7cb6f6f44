"""Indicators made of bounded frames and lags only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.clock import clock_features
from barline.functions.scalar import clip, position_in_range
from barline.functions.shape import true_range, typical
from barline.operators import windows as W
from barline.operators.indicators.registry import indicator
from barline.plans.series import Frame


def o() -> Column:
    return F.col("open")


def h() -> Column:
    return F.col("high")


def l() -> Column:  # noqa: E743
    return F.col("low")


def c() -> Column:
    return F.col("close")


def v() -> Column:
    return F.col("volume")


def span(n: int = 0, **kw) -> int:
    return int(max([n, *[x for x in kw.values() if isinstance(x, int)]]))


def total(**kw) -> int:
    return int(sum(x for x in kw.values() if isinstance(x, int)))


def hh(fr: Frame, n: int) -> Column:
    return F.max("high").over(fr.last_n(n))


def ll(fr: Frame, n: int) -> Column:
    return F.min("low").over(fr.last_n(n))


def ready(fr: Frame, n: int, value: Column) -> Column:
    return F.when(F.count("close").over(fr.last_n(n)) == n, value)


def with_pos(d: DataFrame, fr: Frame) -> DataFrame:
    return d.withColumn("__pos", F.row_number().over(fr.w()))


@indicator(span)
def sma(d, fr, n=20):
    return d.withColumn("sma", W.roll(fr, c(), n, "mean"))


@indicator(span)
def wma(d, fr, n=20):
    return d.withColumn("wma", W.wma(fr, c(), n))


@indicator(span)
def std_dev(d, fr, n=20):
    return d.withColumn("std_dev", W.roll(fr, c(), n, "std_pop"))


@indicator(span)
def bollinger(d, fr, n=20, k=2.0):
    m, s = W.roll(fr, c(), n, "mean"), W.roll(fr, c(), n, "std_pop")
    return d.select("*", m.alias("bb_mid"), (m + k * s).alias("bb_upper"), (m - k * s).alias("bb_lower"))


@indicator(span)
def zscore(d, fr, n=20):
    return d.withColumn("zscore", F.coalesce(W.zscore(fr, c(), n, 0), W.full(fr, c(), n, F.lit(0.0))))


@indicator(lambda n=20: n + 1)
def kaufman_er(d, fr, n=20):
    d = d.withColumn("__dc", F.abs(W.diff(fr, c())))
    path = F.sum("__dc").over(fr.last_n(n))
    er = F.when(path > 0, F.abs(c() - F.lag("close", n).over(fr.w())) / path).otherwise(0.0)
    return d.withColumn("kaufman_er", F.when(F.lag("close", n).over(fr.w()).isNotNull(), er)).drop("__dc")


@indicator(span)
def linreg_slope(d, fr, n=20):
    d = with_pos(d, fr)
    s = W.slope(fr, c(), F.col("__pos"), n)
    return d.select("*", s.alias("linreg_slope"), F.signum(s).alias("linreg_regime")).drop("__pos")


@indicator(total)
def stochastic(d, fr, k=14, dk=3):
    lo, hi = ll(fr, k), hh(fr, k)
    d = d.withColumn("stoch_k", ready(fr, k, F.when(hi > lo, 100.0 * (c() - lo) / (hi - lo)).otherwise(50.0)))
    return d.withColumn("stoch_d", W.roll(fr, F.col("stoch_k"), dk, "mean"))


@indicator(span)
def cci(d, fr, n=20):
    d = d.withColumn("__tp", typical())
    mad = W.mean_abs_dev(fr, F.col("__tp"), n)
    val = (F.col("__tp") - F.avg("__tp").over(fr.last_n(n))) / (0.015 * mad)
    return d.withColumn("cci", F.when(mad > 0, val).otherwise(F.when(mad.isNotNull(), 0.0))).drop("__tp")


@indicator(lambda n=25: n + 1)
def aroon(d, fr, n=25):
    d = with_pos(d, fr)
    up = 100.0 * (n - W.bars_since(fr, "high", n + 1, "__pos")) / n
    dn = 100.0 * (n - W.bars_since(fr, "low", n + 1, "__pos", "min")) / n
    return d.select("*", up.alias("aroon_up"), dn.alias("aroon_down"), (up - dn).alias("aroon_osc")).drop("__pos")


@indicator(span)
def donchian(d, fr, n=20):
    hi, lo = ready(fr, n, hh(fr, n)), ready(fr, n, ll(fr, n))
    return d.select("*", hi.alias("dc_high"), lo.alias("dc_low"), ((hi + lo) / 2).alias("dc_mid"))


@indicator(span)
def ichimoku(d, fr, tenkan=9, kijun=26, senkou=52):
    def mid(n):
        return ready(fr, n, (hh(fr, n) + ll(fr, n)) / 2)

    return d.select(
        "*", mid(tenkan).alias("tenkan"), mid(kijun).alias("kijun"),
        ((mid(tenkan) + mid(kijun)) / 2).alias("senkou_a"), mid(senkou).alias("senkou_b"),
    )


@indicator(span)
def williams_r(d, fr, n=14):
    hi, lo = hh(fr, n), ll(fr, n)
    return d.withColumn("williams_r", ready(fr, n, F.when(hi > lo, -100.0 * (hi - c()) / (hi - lo)).otherwise(0.0)))


@indicator(lambda n=14: n + 1)
def mfi(d, fr, n=14):
    d = d.withColumn("__tp", typical())
    d = d.withColumn("__p", F.lag("__tp").over(fr.w()))
    flow = F.col("__tp") * v()
    pos = F.sum(F.when(F.col("__tp") > F.col("__p"), flow).otherwise(0.0)).over(fr.last_n(n))
    neg = F.sum(F.when(F.col("__tp") < F.col("__p"), flow).otherwise(0.0)).over(fr.last_n(n))
    val = F.when(neg == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + pos / neg))
    return d.withColumn("mfi", W.full(fr, F.col("__p"), n, val)).drop("__tp", "__p")


@indicator(lambda n=10: n + 1)
def roc(d, fr, n=10):
    return d.withColumn("roc", 100.0 * W.pct_change(fr, c(), n))


@indicator(lambda n=10: n + 1)
def momentum(d, fr, n=10):
    return d.withColumn("momentum", W.diff(fr, c(), n))


@indicator(span)
def dto(d, fr, n=20):
    m = W.roll(fr, c(), n, "mean")
    return d.withColumn("dto", F.when(m != 0, (c() - m) / m * 100.0))


@indicator(lambda n=14: n + 1)
def vortex(d, fr, n=14):
    pl, ph = F.lag("low").over(fr.w()), F.lag("high").over(fr.w())
    d = d.select("*", F.abs(h() - pl).alias("__vp"), F.abs(l() - ph).alias("__vm"),
                 F.when(pl.isNotNull(), true_range(fr)).alias("__tr"))
    tr = F.sum("__tr").over(fr.last_n(n))

    def part(x):
        return W.full(fr, F.col("__tr"), n, F.when(tr > 0, F.sum(x).over(fr.last_n(n)) / tr).otherwise(0.0))

    return d.select("*", part("__vp").alias("vi_plus"), part("__vm").alias("vi_minus")).drop("__vp", "__vm", "__tr")


@indicator(span)
def bb_width(d, fr, n=20, k=2.0):
    m, s = W.roll(fr, c(), n, "mean"), W.roll(fr, c(), n, "std_pop")
    return d.withColumn("bb_width", F.when(m != 0, 2 * k * s / m))


@indicator(span)
def retracement(d, fr, n=10):
    d = with_pos(d, fr)
    hi, lo = hh(fr, n), ll(fr, n)
    peak, trough = W.bars_since(fr, "high", n, "__pos"), W.bars_since(fr, "low", n, "__pos", "min")
    raw = F.when(peak <= trough, (hi - c()) / (hi - lo)).otherwise((c() - lo) / (hi - lo))
    return d.withColumn("retracement", ready(fr, n, F.when(hi > lo, clip(raw, 0.0, 1.0)).otherwise(0.0))).drop("__pos")


@indicator(lambda n=20: n + 1)
def breakout_channel(d, fr, n=20):
    ch = W.channel(fr, n)
    hi, lo = ch["chan_high"], ch["chan_low"]
    val = F.when(c() > hi, 1.0).when(c() < lo, -1.0).when(hi == lo, 0.0).otherwise((c() - lo) / (hi - lo) * 2 - 1)
    return d.withColumn("breakout_channel", F.when(hi.isNotNull(), val))


@indicator(span)
def range_position(d, fr, n=240):
    hi, lo = hh(fr, n), ll(fr, n)
    return d.withColumn("range_position", ready(fr, n, F.when(hi > lo, F.tanh((c() - lo) / (hi - lo) * 20.0 - 10.0)).otherwise(0.0)))


@indicator(span)
def bb_position(d, fr, n=20):
    m, s = W.roll(fr, c(), n, "mean"), W.roll(fr, c(), n, "std_pop")
    return d.withColumn("bb_position", F.when(s > 0, clip((c() - m) / (4.0 * s), -1.0, 1.0)).otherwise(F.when(s.isNotNull(), 0.0)))


@indicator(total)
def mom_strength(d, fr, m=5, n=10):
    d = d.withColumn("__up", F.when(W.diff(fr, c(), m).isNotNull(), (W.diff(fr, c(), m) > 0).cast("double")))
    share = F.sum("__up").over(fr.last_n(n)) / n
    val = (share - 0.5) * 2.0 * F.abs(W.diff(fr, c(), n))
    return d.withColumn("mom_strength", W.full(fr, F.col("__up"), n, val)).drop("__up")


def swing_index(fr: Frame, limit: Column | None = None) -> Column:
    """Wilder's one-bar swing index; null on the first bar, 0 where degenerate.

    ``limit`` is the limit move; without one it is the bar's own true range."""
    po, pc = F.lag("open").over(fr.w()), F.lag("close").over(fr.w())
    up, dn, body = F.abs(h() - pc), F.abs(l() - pc), 0.25 * F.abs(pc - po)
    r = F.greatest(up - 0.5 * dn + body, dn - 0.5 * up + body, (h() - l()) + body)
    tr = F.greatest(h() - l(), up, dn)
    move = (c() - pc) + 0.5 * (c() - o()) + 0.25 * (pc - po)
    if limit is not None:
        tiny = F.lit(1e-10)
        share = F.greatest(up, dn) / F.greatest(limit, tiny)
        return F.when(pc.isNotNull(), 50.0 * move / F.when(r > 0, r).otherwise(tiny) * share)
    return F.when(pc.isNotNull(), F.when((tr == 0) | (r == 0), 0.0).otherwise(50.0 * move / r * F.greatest(up, dn) / tr))


@indicator(2)
def asi_velocity(d, fr):
    return d.withColumn("asi_velocity", swing_index(fr))


@indicator(3)
def asi_acceleration(d, fr):
    d = d.withColumn("__si", swing_index(fr))
    return d.withColumn("asi_acceleration", W.diff(fr, F.col("__si"))).drop("__si")


@indicator(span)
def chaikin_money_flow(d, fr, n=21):
    d = d.withColumn("__mf", money_flow())
    vol = F.sum("volume").over(fr.last_n(n))
    val = F.when(vol > 0, F.sum("__mf").over(fr.last_n(n)) / vol).otherwise(0.0)
    return d.withColumn("cmf", W.full(fr, c(), n, val)).drop("__mf")


def money_flow() -> Column:
    return F.when(h() > l(), ((c() - l()) - (h() - c())) / (h() - l())).otherwise(0.0) * v()


@indicator(lambda r1=14, r2=11, n=10: max(r1, r2) + n + 1)
def coppock(d, fr, r1=14, r2=11, n=10):
    d = d.withColumn("__r", 100.0 * (W.pct_change(fr, c(), r1) + W.pct_change(fr, c(), r2)))
    return d.withColumn("coppock", W.wma(fr, F.col("__r"), n)).drop("__r")


@indicator(lambda n=20: n + n // 2 + 1)
def dpo(d, fr, n=20):
    k = n // 2 + 1
    # null until n + k rows exist, like the rows the displaced close needs
    ok = F.count("close").over(fr.last_n(n + k)) == n + k
    return d.withColumn("dpo", F.when(ok, F.lag("close", k).over(fr.w()) - F.avg("close").over(fr.last_n(n))))


@indicator(total)
def dynamic_zone_stochastic(d, fr, n=14, k=3, bb=20, coeff=0.8):
    lo, hi = ll(fr, n), hh(fr, n)
    d = d.withColumn("__raw", ready(fr, n, F.when(hi > lo, 100.0 * (c() - lo) / (hi - lo)).otherwise(50.0)))
    d = d.withColumn("dz_stoch", F.when(F.col("__raw").isNotNull(), F.avg("__raw").over(fr.last_n(k)))).drop("__raw")
    m, s = W.roll(fr, F.col("dz_stoch"), bb, "mean"), W.roll(fr, F.col("dz_stoch"), bb, "std_pop")
    return d.select("*", (m + coeff * s).alias("dz_stoch_upper"), (m - coeff * s).alias("dz_stoch_lower"))


@indicator(span)
def envelopes(d, fr, n=20, pct=2.5):
    m = W.roll(fr, c(), n, "mean")
    return d.select("*", m.alias("env_mid"), (m * (1 + pct / 100)).alias("env_upper"), (m * (1 - pct / 100)).alias("env_lower"))


@indicator(lambda n=14: n + 1)
def vroc(d, fr, n=14):
    return d.withColumn("vroc", 100.0 * W.pct_change(fr, v(), n))


@indicator(span)
def vwma(d, fr, n=20):
    vol = F.sum("volume").over(fr.last_n(n))
    return d.withColumn("vwma", W.full(fr, c(), n, F.when(vol > 0, F.sum(c() * v()).over(fr.last_n(n)) / vol)))


@indicator(lambda n=9: n + int(n**0.5) + 1)
def hull(d, fr, n=9):
    """Weighted mean, over the root of ``n`` rows, of twice the half-length weighted mean
    less the whole one."""
    d = d.withColumn("__hull", 2 * W.wma(fr, c(), n // 2) - W.wma(fr, c(), n))
    return d.withColumn("hull", W.wma(fr, F.col("__hull"), int(n**0.5))).drop("__hull")


@indicator(lambda short=5, long=34: long + 1)
def awesome(d, fr, short=5, long=34):
    mid = (h() + l()) / 2.0
    return d.withColumn("awesome", W.roll(fr, mid, short, "mean") - W.roll(fr, mid, long, "mean"))


@indicator(span)
def base_line(d, fr, n=26):
    return d.withColumn("base_line", ready(fr, n, (hh(fr, n) + ll(fr, n)) / 2.0))


@indicator(lambda n=7: 4 * n + 1)
def ultimate(d, fr, n=7):
    """Buying pressure over true range in frames of n, 2n and 4n rows, weighted 4, 2 and 1."""
    before = F.lag("close").over(fr.w())
    low = F.least(l(), before)
    d = d.withColumn("__bp", F.when(before.isNotNull(), c() - low)).withColumn("__tr", F.when(before.isNotNull(), F.greatest(h(), before) - low))
    part = lambda m: F.try_divide(W.roll(fr, F.col("__bp"), m, "sum"), W.roll(fr, F.col("__tr"), m, "sum"))
    return d.withColumn("ultimate", 100.0 * (4 * part(n) + 2 * part(2 * n) + part(4 * n)) / 7.0).drop("__bp", "__tr")


@indicator(span)
def highs_and_lows(d, fr, n=20):
    hi, lo = ready(fr, n, hh(fr, n)), ready(fr, n, ll(fr, n))
    return d.select("*", hi.alias("highest"), lo.alias("lowest"), (hi - lo).alias("hl_range"))


def divergence_of(fr: Frame, price: Column, x: str, n: int) -> Column:
    """+1 when price makes a lower low but x a higher low between window halves, -1 mirrored."""
    half = n // 2
    early, late = fr.rows(-(n - 1), -(n - half)), fr.rows(-(n - half - 1), 0)
    ind = F.col(x)
    bull = (F.min(price).over(late) < F.min(price).over(early)) & (F.min(ind).over(late) > F.min(ind).over(early))
    bear = (F.max(price).over(late) > F.max(price).over(early)) & (F.max(ind).over(late) < F.max(ind).over(early))
    return F.when(F.count(ind).over(fr.last_n(n)) == n, F.when(bear, -1).when(bull, 1).otherwise(0))


@indicator(total)
def cci_divergence(d, fr, n=20, lookback=20):
    had = "cci" in d.columns
    base = d.withColumnRenamed("cci", "__keep") if had else d
    d = cci(base, fr, n)
    d = d.withColumn("cci_divergence", divergence_of(fr, c(), "cci", lookback)).drop("cci")
    return d.withColumnRenamed("__keep", "cci") if had else d


@indicator(0)
def hour_of_day(d, fr):
    f = clock_features(fr.ts)
    hour = F.hour(fr.ts)
    session = F.when(hour < 8, 0).when(hour < 16, 1).otherwise(2)
    return d.select("*", f["hour_sin"].alias("hod_sin"), f["hour_cos"].alias("hod_cos"), session.alias("hod_session"))


@indicator(0)
def day_of_week(d, fr):
    f = clock_features(fr.ts, 5.0)
    return d.select("*", f["dow_sin"].alias("dw_sin"), f["dow_cos"].alias("dw_cos"))


@indicator(span)
def range_pos(d, fr, n=30):
    return d.withColumn("range_pos", ready(fr, n, position_in_range(c(), ll(fr, n), hh(fr, n))))
