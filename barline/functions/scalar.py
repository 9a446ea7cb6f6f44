"""Scalar column functions: squashes, safe logs, pips, pairs, JSON, arrays, maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(col: Column | str, kind: str, scale: float = 1.0) -> Column:
    x = _c(col) * F.lit(scale)
    if kind == "tanh":
        return F.tanh(x)
    if kind == "atan":
        return F.atan(x) * (2.0 / 3.141592653589793)
    if kind == "log1p":
        return F.signum(x) * F.log1p(F.abs(x))
    if kind == "sign":
        return F.signum(x)
    if kind == "sqrt":
        return F.signum(x) * F.sqrt(F.abs(x))
    raise ValueError(kind)


def clip(col: Column | str, lo: float, hi: float) -> Column:
    return F.greatest(F.least(_c(col), F.lit(hi)), F.lit(lo))


def clip_scale(col: Column | str, lim: float = 3.0) -> Column:
    """Clip to +-lim, scale to [-1, 1], null and NaN become 0."""
    return F.coalesce(F.nanvl(clip(col, -lim, lim), F.lit(0.0)), F.lit(0.0)) / F.lit(lim)


# fixed values: coefficients of the error-function polynomial (Abramowitz & Stegun 7.1.26)
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column | str) -> Column:
    v = F.abs(_c(x))
    t = 1.0 / (1.0 + ERF_P * v)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(_c(x)) * (1.0 - poly * F.exp(-v * v))


def cdf_signed(z: Column | str) -> Column:
    """2*Phi(z)-1, which equals erf(z/sqrt(2))."""
    return erf(_c(z) / F.sqrt(F.lit(2.0)))


def safe_log(col: Column | str) -> Column:
    return F.when(_c(col) > 0, F.log(_c(col)))


def log_delta(a: Column | str, b: Column | str) -> Column:
    return F.when((_c(a) > 0) & (_c(b) > 0), F.log(_c(a) / _c(b)))


def safe_div(a: Column, b: Column, default: float | None = None) -> Column:
    out = F.when(b != 0, a / b)
    return out if default is None else F.coalesce(out, F.lit(default))


def to_pips(price_move: Column | str, pip: Column | str) -> Column:
    return _c(price_move) / _c(pip)


def to_base(amount: Column | str, rate: Column | str, inverse: Column | str) -> Column:
    """Convert an amount with a quoted rate, or its inverse when quoted the other way."""
    return F.when(_c(inverse), _c(amount) / _c(rate)).otherwise(_c(amount) * _c(rate))


def split_pair(col: Column | str, sep: str = "_") -> dict[str, Column]:
    parts = F.split(_c(col), sep)
    return {"base": F.element_at(parts, 1), "quote": F.element_at(parts, -1)}


def strip_prefix(col: Column | str, prefix: str) -> Column:
    return F.when(_c(col).startswith(prefix), F.substr(_c(col), F.lit(len(prefix) + 1))).otherwise(_c(col))


def parse_state(col: Column | str, schema: str | T.StructType) -> Column:
    return F.from_json(_c(col), schema)


def weight_map(weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])


def mean_of(cols: Sequence[Column]) -> Column:
    """Row-wise mean skipping nulls."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n > 0, total / n)


def position_in_range(c: Column, lo: Column, hi: Column) -> Column:
    """Unclamped position in a range, 0.5 when the range is flat."""
    return F.when(hi > lo, (c - lo) / (hi - lo)).otherwise(F.when(hi.isNotNull(), F.lit(0.5)))
