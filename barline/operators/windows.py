"""Rolling kernels; each takes the frame of a block and returns a column.

Values are null until the frame is full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.plans.series import Frame

_FNS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std_pop": F.stddev_pop,
    "std": F.stddev_samp,
    "var_pop": F.var_pop,
}


def full(fr: Frame, x: Column, n: int, value: Column) -> Column:
    return F.when(F.count(x).over(fr.last_n(n)) == n, value)


def roll(fr: Frame, x: Column, n: int, fn: str) -> Column:
    return full(fr, x, n, _FNS[fn](x).over(fr.last_n(n)))


def partial(fr: Frame, x: Column, n: int, fn: str) -> Column:
    """Same without the full-frame guard."""
    return _FNS[fn](x).over(fr.last_n(n))


def lag(fr: Frame, x: str | Column, k: int = 1) -> Column:
    return F.lag(x, k).over(fr.w())


def lead(fr: Frame, x: str | Column, k: int = 1) -> Column:
    return F.lead(x, k).over(fr.w())


def diff(fr: Frame, x: Column, k: int = 1) -> Column:
    return x - F.lag(x, k).over(fr.w())


def pct_change(fr: Frame, x: Column, k: int = 1) -> Column:
    p = F.lag(x, k).over(fr.w())
    return F.when(p != 0, (x - p) / p)


def roll_time(fr: Frame, minutes: int, o: str = "open", h: str = "high", l: str = "low", c: str = "close") -> dict[str, Column]:
    """OHLC of the trailing time window (t-m, t]."""
    w = fr.range_us(-(minutes * 60_000_000) + 1, 0)
    return {
        f"o_{minutes}": F.first(o).over(w),
        f"h_{minutes}": F.max(h).over(w),
        f"l_{minutes}": F.min(l).over(w),
        f"c_{minutes}": F.last(c).over(w),
    }


def zscore(fr: Frame, x: Column, n: int, ddof: int = 0) -> Column:
    sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)(x).over(fr.last_n(n))
    return full(fr, x, n, F.when(sd > 0, (x - F.avg(x).over(fr.last_n(n))) / sd))


def percentile(fr: Frame, x: Column, n: int, p: float, guard: bool = True) -> Column:
    v = F.percentile(x, F.lit(p)).over(fr.last_n(n))
    return full(fr, x, n, v) if guard else v


def percent_rank(fr: Frame, x: Column, n: int) -> Column:
    """Average-tie rank of the current value among the last n, divided by n."""
    arr = F.collect_list(x).over(fr.last_n(n))
    less = F.size(F.filter(arr, lambda v: v < x))
    equal = F.size(F.filter(arr, lambda v: v == x))
    return full(fr, x, n, (less + (equal + 1) / 2.0) / n)


def weighted(fr: Frame, x: Column, n: int, weights: list[float]) -> Column:
    """Weighted mean, ``weights`` from oldest to newest, as a sum of lags (no array)."""
    total = F.lit(0.0)
    for i, wt in enumerate(weights):
        back = n - 1 - i
        total = total + (x if back == 0 else F.lag(x, back).over(fr.w())) * F.lit(float(wt))
    return total / F.lit(float(sum(weights)))


def wma(fr: Frame, x: Column, n: int) -> Column:
    return weighted(fr, x, n, [float(i + 1) for i in range(n)])


def ewm_fir(fr: Frame, x: Column, alpha: float, k: int) -> Column:
    """Exponential weights truncated to the last ``k`` rows."""
    arr = F.collect_list(x).over(fr.last_n(k))
    acc = F.aggregate(arr, F.lit(None).cast("double"), lambda y, v: F.coalesce(y * (1 - alpha) + v * alpha, v * alpha))
    return full(fr, x, k, acc)


def mean_abs_dev(fr: Frame, x: Column, n: int) -> Column:
    arr = F.collect_list(x).over(fr.last_n(n))
    mean = F.avg(x).over(fr.last_n(n))
    return full(fr, x, n, F.aggregate(F.transform(arr, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v) / n)


def median_mad(fr: Frame, x: str, n: int) -> dict[str, Column]:
    """Trailing median and median absolute deviation around that same median."""
    med = F.percentile(F.col(x), F.lit(0.5)).over(fr.last_n(n))
    arr = F.collect_list(F.col(x)).over(fr.last_n(n))
    dev = F.array_sort(F.transform(arr, lambda v: F.abs(v - med)))
    lo = F.element_at(dev, int((n - 1) // 2 + 1))
    hi = F.element_at(dev, int(n // 2 + 1))
    ok = F.count(x).over(fr.last_n(n)) == n
    return {"med": F.when(ok, med), "mad": F.when(ok, (lo + hi) / 2.0)}


def mad_zscore(fr: Frame, x: str, n: int) -> Column:
    m = median_mad(fr, x, n)
    return F.when(m["mad"] > 0, (F.col(x) - m["med"]) / (F.lit(1.4826) * m["mad"]))


def bars_since(fr: Frame, x: str, n: int, pos: str, best: str = "max", oldest: bool = False) -> Column:
    """Rows since the extreme of the last n rows; ties take the latest, or the oldest."""
    w = fr.last_n(n)
    sign = -1 if (best == "max") == oldest else 1
    ranked = F.struct(F.col(x), (sign * F.col(pos)).alias("at"))
    at = sign * (F.max(ranked) if best == "max" else F.min(ranked)).over(w)["at"]
    return F.when(F.count(x).over(w) == n, F.col(pos) - at)


def slope(fr: Frame, y: Column, pos: Column, n: int) -> Column:
    return full(fr, y, n, F.regr_slope(y, pos).over(fr.last_n(n)))


def forecast(fr: Frame, y: Column, pos: Column, n: int) -> Column:
    w = fr.last_n(n)
    return full(fr, y, n, F.regr_intercept(y, pos).over(w) + F.regr_slope(y, pos).over(w) * pos)


def corr(fr: Frame, a: Column, b: Column, n: int) -> Column:
    both = F.when(a.isNotNull() & b.isNotNull(), F.lit(1))
    return F.when(F.count(both).over(fr.last_n(n)) == n, F.corr(a, b).over(fr.last_n(n)))


def channel(fr: Frame, n: int, hi: str = "high", lo: str = "low", exclude_current: bool = True) -> dict[str, Column]:
    w = fr.rows(-n, -1) if exclude_current else fr.last_n(n)
    ok = F.count(hi).over(w) == n
    return {"chan_high": F.when(ok, F.max(hi).over(w)), "chan_low": F.when(ok, F.min(lo).over(w))}


def forward_extremes(fr: Frame, horizon_us: int, hi: str = "high", lo: str = "low") -> dict[str, Column]:
    """Extremes strictly after t up to t+h, with the row count as coverage."""
    w = fr.range_us(1, horizon_us)
    return {"fwd_high": F.max(hi).over(w), "fwd_low": F.min(lo).over(w), "fwd_rows": F.count(hi).over(w)}


def haar(fr: Frame, x: Column, level: int) -> Column:
    """Trailing Haar detail: difference of two adjacent means of 2**(level-1) rows."""
    half = 2 ** (level - 1)
    recent = F.avg(x).over(fr.last_n(half))
    older = F.avg(x).over(fr.rows(-(2 * half - 1), -half))
    return full(fr, x, 2 * half, (recent - older) / F.sqrt(F.lit(2.0)) * F.sqrt(F.lit(float(half))))


def variance_ratio(fr: Frame, x: str, k: int, n: int) -> Column:
    """Var(k-step change) / (k * Var(1-step change)) over n rows; lags must exist."""
    one = F.col(f"__{x}_d1")
    many = F.col(f"__{x}_d{k}")
    w = fr.last_n(n)
    v1, vk = F.var_pop(one).over(w), F.var_pop(many).over(w)
    return F.when((F.count(many).over(w) == n) & (v1 > 0), vk / (F.lit(float(k)) * v1))
