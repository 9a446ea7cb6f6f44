"""Indicators with exponential memory: affine scans, chained without extra exchanges."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.functions.scalar import clip
from barline.functions.shape import true_range
from barline.operators import windows as W
from barline.operators.indicators.frames import c, divergence_of, h, hh, l, ll, ready, v
from barline.operators.indicators.registry import indicator
from barline.plans.orderstats import OrderStat, order_statistics
from barline.plans.scan import affine, ema_first, ema_rows, ema_seeded, lookback, wilder
from barline.plans.series import Frame


def wrows(n: int) -> int:
    return ema_rows(n, 1.0 / n) + 1


def add_atr(d, fr: Frame, out: str, n: int):
    d = d.withColumn("__tr", true_range(fr))
    return wilder(d, fr, out, F.col("__tr"), n).drop("__tr")


def add_rsi(d, fr: Frame, out: str, n: int, x: str = "close"):
    move = F.col(x) - F.lag(x).over(fr.w())
    d = d.withColumn("__g", F.greatest(move, F.lit(0.0))).withColumn("__lo", F.greatest(-move, F.lit(0.0)))
    # greatest skips nulls, so the first bar has to be blanked
    first = F.lag(x).over(fr.w()).isNull()
    d = d.withColumn("__g", F.when(~first, F.col("__g"))).withColumn("__lo", F.when(~first, F.col("__lo")))
    d = wilder(d, fr, "__ag", F.col("__g"), n)
    d = wilder(d, fr, "__al", F.col("__lo"), n)
    rsi = F.when(F.col("__al") <= 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("__ag") / F.col("__al")))
    return d.withColumn(out, F.when(F.col("__al").isNotNull(), rsi)).drop("__g", "__lo", "__ag", "__al")


def add_ema(d, fr: Frame, out: str, x: Column, n: int):
    return ema_seeded(d, fr, out, x, n)


def chain(d, fr: Frame, out: str, x: Column, n: int, depth: int):
    """EMA of EMA of ... as columns ``out``1..depth."""
    for i in range(1, depth + 1):
        d = add_ema(d, fr, f"{out}{i}", x, n)
        x = F.col(f"{out}{i}")
    return d


@indicator(lambda n=14: wrows(n))
def atr(d, fr, n=14):
    return add_atr(d, fr, "atr", n)


def add_adx(d, fr: Frame, n: int):
    ph, pl = F.lag("high").over(fr.w()), F.lag("low").over(fr.w())
    up, dn = h() - ph, pl - l()
    d = d.select(
        "*", F.when(ph.isNotNull(), true_range(fr)).alias("__t"),
        F.when(ph.isNotNull(), F.when((up > dn) & (up > 0), up).otherwise(0.0)).alias("__p"),
        F.when(ph.isNotNull(), F.when((dn > up) & (dn > 0), dn).otherwise(0.0)).alias("__m"),
    )
    for src, out in (("__t", "__ts"), ("__p", "__ps"), ("__m", "__ms")):
        d = wilder(d, fr, out, F.col(src), n)
    d = d.withColumn("plus_di", F.when(F.col("__ts") > 0, 100.0 * F.col("__ps") / F.col("__ts")))
    d = d.withColumn("minus_di", F.when(F.col("__ts") > 0, 100.0 * F.col("__ms") / F.col("__ts")))
    both = F.col("plus_di") + F.col("minus_di")
    d = d.withColumn("__dx", F.when(both > 0, 100.0 * F.abs(F.col("plus_di") - F.col("minus_di")) / both).otherwise(F.when(both.isNotNull(), 0.0)))
    d = wilder(d, fr, "adx", F.col("__dx"), n)
    return d.drop("__t", "__p", "__m", "__ts", "__ps", "__ms", "__dx")


def adx_rows(n: int = 14, **_) -> int:
    return 2 * wrows(n)


@indicator(adx_rows)
def adx(d, fr, n=14):
    d = add_adx(d, fr, n)
    return d.withColumn("adx_regime", F.when(F.col("adx") < 20, -1).when(F.col("adx") > 40, 1).when(F.col("adx").isNotNull(), 0))


def _hidden_adx(d, fr, n):
    keep = [x for x in ("adx", "plus_di", "minus_di") if x in d.columns]
    for x in keep:
        d = d.withColumnRenamed(x, f"__keep_{x}")
    d = add_adx(d, fr, n)
    for x in ("adx", "plus_di", "minus_di"):
        d = d.withColumnRenamed(x, f"__{x}")
    for x in keep:
        d = d.withColumnRenamed(f"__keep_{x}", x)
    return d


@indicator(lambda n=14, window=200: wrows(n) + window)
def vol_regime(d, fr, n=14, window=200):
    d = add_atr(d, fr, "__atr", n).withColumn("__pct", F.when(c() > 0, F.col("__atr") / c() * 100.0))
    d = d.withColumn("__seen", F.count("__pct").over(fr.last_n(window)))
    d = order_statistics(d, fr, {f"__q{p}": OrderStat("quantile", "__pct", window, p / 100, partial=True) for p in (33, 67)})
    val = F.when(F.col("__pct") < F.col("__q33"), -1).when(F.col("__pct") > F.col("__q67"), 1).otherwise(0)
    ok = (F.col("__seen") >= 20) & F.col("__pct").isNotNull()
    return d.withColumn("vol_regime", F.when(ok, val)).drop("__atr", "__pct", "__seen", "__q33", "__q67")


@indicator(lambda n=14, k=3.0: wrows(n))
def chandelier(d, fr, n=14, k=3.0):
    d = add_atr(d, fr, "__atr", n)
    a = F.col("__atr")
    return d.select("*", ready(fr, n, hh(fr, n) - k * a).alias("chandelier_long"), ready(fr, n, ll(fr, n) + k * a).alias("chandelier_short")).drop("__atr")


@indicator(lambda fast=12, slow=26, signal=9: ema_rows(slow) + ema_rows(signal))
def macd(d, fr, fast=12, slow=26, signal=9):
    d = add_ema(d, fr, "__f", c(), fast)
    d = add_ema(d, fr, "__s", c(), slow)
    d = d.withColumn("macd", F.col("__f") - F.col("__s")).drop("__f", "__s")
    d = add_ema(d, fr, "macd_signal", F.col("macd"), signal)
    return d.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


@indicator(lambda n=20, k=1.5: max(ema_rows(n), wrows(n)))
def keltner(d, fr, n=20, k=1.5):
    d = add_atr(add_ema(d, fr, "kc_mid", c(), n), fr, "__atr", n)
    return d.select("*", (F.col("kc_mid") + k * F.col("__atr")).alias("kc_upper"), (F.col("kc_mid") - k * F.col("__atr")).alias("kc_lower")).drop("__atr")


@indicator(lambda n=20, bb=2.0, kc=1.5: wrows(n))
def squeeze(d, fr, n=20, bb=2.0, kc=1.5):
    d = add_atr(d, fr, "__atr", n)
    m, s = W.roll(fr, c(), n, "mean"), W.roll(fr, c(), n, "std_pop")
    # same middle line, so the bands nest when their half-widths do
    return d.select("*", (bb * s < kc * F.col("__atr")).cast("int").alias("squeeze_on"), (c() - m).alias("squeeze_momentum")).drop("__atr")


@indicator(lambda short=5, long=200: wrows(long))
def atr_ratio(d, fr, short=5, long=200):
    d = add_atr(add_atr(d, fr, "__a", short), fr, "__b", long)
    return d.withColumn("atr_ratio", F.when(F.col("__b") > 0, F.tanh((F.col("__a") / F.col("__b") - 1) * 5.0))).drop("__a", "__b")


@indicator(lambda n=14, m=20: wrows(n) + m)
def vol_expansion(d, fr, n=14, m=20):
    d = add_atr(d, fr, "__a", n)
    mean = W.roll(fr, F.col("__a"), m, "mean")
    return d.withColumn("vol_expansion", F.when(mean > 0, F.atan((F.col("__a") / mean - 1) * 10.0) * 2.0 / math.pi)).drop("__a")


@indicator(lambda n=14: wrows(n))
def rsi(d, fr, n=14):
    return add_rsi(d, fr, "rsi", n)


@indicator(lambda n=14: wrows(n))
def rsi_extreme(d, fr, n=14):
    d = add_rsi(d, fr, "__r", n)
    return d.withColumn("rsi_extreme", clip((F.col("__r") - 50.0) / 50.0, -1.0, 1.0)).withColumn(
        "rsi_extreme", F.when(F.col("__r").isNotNull(), F.col("rsi_extreme"))).drop("__r")


@indicator(lambda n=14, fast=50, slow=200: adx_rows(n) + slow)
def trend_quality(d, fr, n=14, fast=50, slow=200):
    d = _hidden_adx(d, fr, n)
    f, s = W.roll(fr, c(), fast, "mean"), W.roll(fr, c(), slow, "mean")
    lined = ((c() > f) & (f > s)) | ((c() < f) & (f < s))
    return d.withColumn("trend_quality", lined.cast("double") * F.when(F.col("__adx").isNotNull(), F.least(F.col("__adx") / 50.0, F.lit(1.0)))).drop("__adx", "__plus_di", "__minus_di")


@indicator(adx_rows)
def dmi_signal(d, fr, n=14):
    d = _hidden_adx(d, fr, n)
    side = F.when(F.col("__plus_di") > F.col("__minus_di"), 1.0).otherwise(-1.0)
    return d.withColumn("dmi_signal", side * F.col("__adx") / 100.0).drop("__adx", "__plus_di", "__minus_di")


@indicator(lambda n=14: wrows(n))
def delta_price(d, fr, n=14):
    d = add_atr(d, fr, "__a", n)
    return d.withColumn("delta_price", F.when(F.col("__a") > 0, F.tanh(W.diff(fr, c()) / F.col("__a")))).drop("__a")


def _stochastic_of(fr, x: str, n: int):
    lo, hi = F.min(x).over(fr.last_n(n)), F.max(x).over(fr.last_n(n))
    return lo, hi


def _held_ema(d, fr, out, x: str, factor: float, start: float):
    """y += factor*(x-y), y held where x is null but the scan has begun; starts from ``start``."""
    begun = f"__{out}_n"
    d = d.withColumn(begun, F.count(x).over(fr.rows(-(2**31 - 2), 0)))
    first = (F.col(begun) == 1) & F.col(x).isNotNull()
    a = F.when(F.col(x).isNotNull(), F.lit(1.0 - factor)).otherwise(F.lit(1.0))
    b = F.when(F.col(x).isNull(), 0.0).otherwise(factor * F.col(x)) + F.when(first, (1.0 - factor) * start).otherwise(0.0)
    d = affine(d, fr, out, a, b)
    return d.drop(begun)


@indicator(lambda fast=23, slow=50, n=10, factor=0.5: ema_rows(slow) + 2 * (n + lookback(0.5)) + 512)
def schaff(d, fr, fast=23, slow=50, n=10, factor=0.5):
    """Double stochastic of the MACD; on a flat range the smoothed value is held."""
    d = add_ema(d, fr, "__f", c(), fast)
    d = add_ema(d, fr, "__s", c(), slow)
    d = d.withColumn("__x", F.col("__f") - F.col("__s"))
    lo, hi = _stochastic_of(fr, "__x", n)
    full1 = F.count("__x").over(fr.last_n(n)) == n
    d = d.withColumn("__ok1", full1).withColumn("__q1", F.when(full1 & (hi > lo), (F.col("__x") - lo) / (hi - lo) * 100.0))
    d = _held_ema(d, fr, "__pf", "__q1", factor, 0.0)
    d = d.withColumn("__pf", F.when(F.col("__ok1"), F.col("__pf")))
    lo2, hi2 = _stochastic_of(fr, "__pf", n)
    full2 = F.count("__pf").over(fr.last_n(n)) == n
    d = d.withColumn("__ok2", full2).withColumn("__q2", F.when(full2 & (hi2 > lo2), (F.col("__pf") - lo2) / (hi2 - lo2) * 100.0))
    d = _held_ema(d, fr, "__stc", "__q2", factor, 50.0)
    return d.withColumn("schaff", F.when(F.col("__ok2"), clip("__stc", 0.0, 100.0))).drop(
        "__f", "__s", "__x", "__ok1", "__q1", "__pf", "__ok2", "__q2", "__stc")


@indicator(lambda n=5: n + ema_rows(5 * n))
def repulse(d, fr, n=5):
    first_open = F.lag("open", n - 1).over(fr.w())
    bull = F.when(c() != 0, 100.0 * (3.0 * c() - 2.0 * ll(fr, n) - first_open) / c()).otherwise(0.0)
    bear = F.when(c() != 0, 100.0 * (first_open + 2.0 * hh(fr, n) - 3.0 * c()) / c()).otherwise(0.0)
    d = d.select("*", ready(fr, n, bull).alias("__bu"), ready(fr, n, bear).alias("__be"))
    d = add_ema(d, fr, "__b1", F.col("__bu"), 5 * n)
    d = add_ema(d, fr, "__b2", F.col("__be"), 5 * n)
    return d.withColumn("repulse", F.col("__b1") - F.col("__b2")).drop("__bu", "__be", "__b1", "__b2")


@indicator(lambda n=14, m=14, k=3: wrows(n) + m + k)
def stoch_rsi(d, fr, n=14, m=14, k=3):
    d = add_rsi(d, fr, "__r", n)
    lo, hi = _stochastic_of(fr, "__r", m)
    ok = F.count("__r").over(fr.last_n(m)) == m
    d = d.withColumn("__q", F.when(ok, F.when(hi > lo, (F.col("__r") - lo) / (hi - lo) * 100.0).otherwise(50.0)))
    return d.withColumn("stoch_rsi", F.when(F.col("__q").isNotNull(), F.avg("__q").over(fr.last_n(k)))).drop("__r", "__q")


@indicator(lambda n=10, m=3, signal=10: n + 2 * lookback(1 - 2 / (m + 1)) + lookback(1 - 2 / (signal + 1)))
def smi(d, fr, n=10, m=3, signal=10):
    a = 2.0 / (m + 1)
    hi, lo = hh(fr, n), ll(fr, n)
    d = d.select("*", ready(fr, n, c() - (hi + lo) / 2).alias("__rel"), ready(fr, n, hi - lo).alias("__rng"))
    for x in ("__rel", "__rng"):
        d = ema_first(d, fr, f"{x}1", F.col(x), a)
        d = ema_first(d, fr, f"{x}2", F.col(f"{x}1"), a)
    half = F.col("__rng2") / 2
    val = F.when(half != 0, clip(100.0 * F.col("__rel2") / half, -100.0, 100.0)).otherwise(F.when(half.isNotNull(), 0.0))
    d = d.withColumn("smi", val)
    d = ema_first(d, fr, "smi_signal", F.col("smi"), 2.0 / (signal + 1))
    return d.drop(*[f"{x}{s}" for x in ("__rel", "__rng") for s in ("", "1", "2")])


@indicator(lambda n=10: ema_rows(n) + n)
def chaikin_volatility(d, fr, n=10):
    d = add_ema(d, fr, "__e", h() - l(), n)
    return d.withColumn("chaikin_volatility", 100.0 * W.pct_change(fr, F.col("__e"), n)).drop("__e")


@indicator(lambda n=20: 2 * ema_rows(n))
def dema(d, fr, n=20):
    d = chain(d, fr, "__e", c(), n, 2)
    return d.withColumn("dema", 2 * F.col("__e1") - F.col("__e2")).drop("__e1", "__e2")


@indicator(lambda n=20: 3 * ema_rows(n))
def tema(d, fr, n=20):
    d = chain(d, fr, "__e", c(), n, 3)
    return d.withColumn("tema", 3 * F.col("__e1") - 3 * F.col("__e2") + F.col("__e3")).drop("__e1", "__e2", "__e3")


@indicator(lambda fast=12, slow=26, signal=9: 2 * ema_rows(slow) + 2 * ema_rows(signal))
def macd_zero_lag(d, fr, fast=12, slow=26, signal=9):
    d = chain(chain(d, fr, "__f", c(), fast, 2), fr, "__s", c(), slow, 2)
    line = (2 * F.col("__f1") - F.col("__f2")) - (2 * F.col("__s1") - F.col("__s2"))
    d = chain(d.withColumn("zl_macd", line), fr, "__g", F.col("zl_macd"), signal, 2)
    d = d.withColumn("zl_signal", 2 * F.col("__g1") - F.col("__g2"))
    return d.drop("__f1", "__f2", "__s1", "__s2", "__g1", "__g2")


@indicator(lambda n=14, bb=20, coeff=1.3185: wrows(n) + bb)
def dynamic_zone_rsi(d, fr, n=14, bb=20, coeff=1.3185):
    d = add_rsi(d, fr, "dz_rsi", n)
    m, s = W.roll(fr, F.col("dz_rsi"), bb, "mean"), W.roll(fr, F.col("dz_rsi"), bb, "std_pop")
    return d.select("*", (m + coeff * s).alias("dz_rsi_upper"), (m - coeff * s).alias("dz_rsi_lower"))


@indicator(lambda n=20: ema_rows(n))
def ema(d, fr, n=20):
    return add_ema(d, fr, "ema", c(), n)


@indicator(lambda n=10, fast=2, slow=30: n + lookback(1 - (2 / (slow + 1)) ** 2))
def adaptive_ma(d, fr, n=10, fast=2, slow=30):
    """Kaufman's average: time-varying smoothing from the efficiency ratio."""
    fa, sa = 2.0 / (fast + 1), 2.0 / (slow + 1)
    d = d.withColumn("__dc", F.abs(W.diff(fr, c())))
    old = F.lag("close", n).over(fr.w())
    path = F.sum("__dc").over(fr.last_n(n))
    er = F.when(path > 0, F.abs(c() - old) / path).otherwise(0.0)
    d = d.withColumn("__sc", F.when(old.isNotNull(), F.pow(er * (fa - sa) + sa, 2)))
    # until n+1 bars exist the average is the close itself
    a = F.coalesce(1.0 - F.col("__sc"), F.lit(0.0))
    first = F.col("__sc").isNotNull() & F.lag("__sc").over(fr.w()).isNull()
    a = F.when(first, 0.0).otherwise(a)
    b = F.when(first | F.col("__sc").isNull(), c()).otherwise(F.col("__sc") * c())
    d = d.withColumn("__a", a).withColumn("__b", b)
    d = affine(d, fr, "adaptive_ma", F.col("__a"), F.col("__b"))
    return d.withColumn("adaptive_ma", F.when(F.col("__sc").isNotNull(), F.col("adaptive_ma"))).drop("__dc", "__sc", "__a", "__b")


def _oscillator(d, fr, out, x, fast, slow):
    d = add_ema(add_ema(d, fr, "__f", x, fast), fr, "__s", x, slow)
    return d.withColumn(out, F.when(F.col("__s") != 0, 100.0 * (F.col("__f") - F.col("__s")) / F.col("__s"))).drop("__f", "__s")


@indicator(lambda fast=12, slow=26: ema_rows(slow))
def price_oscillator(d, fr, fast=12, slow=26):
    return _oscillator(d, fr, "price_oscillator", c(), fast, slow)


@indicator(lambda fast=12, slow=26: ema_rows(slow))
def volume_oscillator(d, fr, fast=12, slow=26):
    return _oscillator(d, fr, "volume_oscillator", v(), fast, slow)


@indicator(lambda fast=12, slow=26, lookback=20: ema_rows(slow) + lookback)
def macd_divergence(d, fr, fast=12, slow=26, lookback=20):
    d = add_ema(add_ema(d, fr, "__f", c(), fast), fr, "__s", c(), slow)
    d = d.withColumn("__m", F.col("__f") - F.col("__s"))
    return d.withColumn("macd_divergence", divergence_of(fr, c(), "__m", lookback)).drop("__f", "__s", "__m")


@indicator(lambda n=14, lookback=20: wrows(n) + lookback)
def rsi_divergence(d, fr, n=14, lookback=20):
    d = add_rsi(d, fr, "__r", n)
    return d.withColumn("rsi_divergence", divergence_of(fr, c(), "__r", lookback)).drop("__r")


@indicator(lambda n=15: 3 * ema_rows(n) + 1)
def trix(d, fr, n=15):
    d = chain(d, fr, "__e", c(), n, 3)
    return d.withColumn("trix", 100.0 * W.pct_change(fr, F.col("__e3"))).drop("__e1", "__e2", "__e3")


@indicator(lambda n=13: ema_rows(n))
def bull_bear_power(d, fr, n=13):
    d = add_ema(d, fr, "__e", c(), n)
    return d.select("*", (h() - F.col("__e")).alias("bull_power"), (l() - F.col("__e")).alias("bear_power")).drop("__e")


@indicator(lambda n=10: n + lookback(0.67))
def fisher(d, fr, n=10):
    """Fisher transform of the smoothed mid-price position in its range."""
    d = d.withColumn("__mid", (h() + l()) / 2)
    lo, hi = F.min("__mid").over(fr.last_n(n)), F.max("__mid").over(fr.last_n(n))
    raw = F.when(hi > lo, 2.0 * ((F.col("__mid") - lo) / (hi - lo) - 0.5)).otherwise(0.0)
    d = d.withColumn("__raw", ready(fr, n, 0.33 * raw))
    d = affine(d, fr, "__val", 0.67, F.col("__raw"))
    x = clip("__val", -0.999, 0.999)
    d = d.withColumn("__lg", F.when(F.col("__raw").isNotNull(), 0.5 * F.log((1 + x) / (1 - x))))
    d = affine(d, fr, "fisher", 0.5, F.col("__lg"))
    return d.withColumn("fisher", F.when(F.col("__raw").isNotNull(), F.col("fisher"))).drop("__mid", "__raw", "__val", "__lg")


