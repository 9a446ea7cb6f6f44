"""Bar geometry: one-bar, two-bar and log-delta shapes, true range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.functions.scalar import log_delta, safe_log
from barline.plans.series import Frame

O, H, L, C = "open", "high", "low", "close"


def prev(fr: Frame, name: str, k: int = 1) -> Column:
    return F.lag(name, k).over(fr.w())


def typical() -> Column:
    return (F.col(H) + F.col(L) + F.col(C)) / 3.0


def true_range(fr: Frame) -> Column:
    """First bar: high - low."""
    pc = prev(fr, C)
    hl = F.col(H) - F.col(L)
    return F.coalesce(F.greatest(hl, F.abs(F.col(H) - pc), F.abs(F.col(L) - pc)), hl)


def body_ratio() -> Column:
    rng = F.col(H) - F.col(L)
    return F.when(rng > 0, (F.col(C) - F.col(O)) / rng).otherwise(F.lit(0.0))


def bar_shape() -> dict[str, Column]:
    o, h, l, c = F.col(O), F.col(H), F.col(L), F.col(C)
    rng = h - l
    top, bottom = F.greatest(o, c), F.least(o, c)
    return {
        "body": c - o,
        "abs_body": F.abs(c - o),
        "upper_wick": h - top,
        "lower_wick": bottom - l,
        "bar_range": rng,
        "body_share": F.when(rng > 0, F.abs(c - o) / rng).otherwise(F.lit(0.0)),
        "close_pos": F.when(rng > 0, (c - l) / rng).otherwise(F.lit(0.5)),
        "direction": F.signum(c - o),
    }


def two_bar_shape(fr: Frame) -> dict[str, Column]:
    o, h, l, c = F.col(O), F.col(H), F.col(L), F.col(C)
    po, ph, pl, pc = (prev(fr, x) for x in (O, H, L, C))
    overlap = F.greatest(F.least(h, ph) - F.greatest(l, pl), F.lit(0.0))
    span = F.greatest(h, ph) - F.least(l, pl)
    engulf = (F.greatest(o, c) >= F.greatest(po, pc)) & (F.least(o, c) <= F.least(po, pc))
    opposite = F.signum(c - o) * F.signum(pc - po) < 0
    return {
        "gap": o - pc,
        "overlap_share": F.when(span > 0, F.when(ph.isNotNull(), overlap / span)),
        "is_engulfing": (engulf & opposite).cast("int"),
        "is_inside": ((h <= ph) & (l >= pl)).cast("int"),
        "two_bar_move": c - po,
        "range_growth": F.when(ph - pl > 0, (h - l) / (ph - pl)),
        "reversal": F.when(opposite, F.abs(c - o)).otherwise(F.when(pc.isNotNull(), F.lit(0.0))),
    }


def log_delta_shape(fr: Frame) -> dict[str, Column]:
    c, h, l = F.col(C), F.col(H), F.col(L)
    pc, ph, pl = prev(fr, C), prev(fr, H), prev(fr, L)
    return {
        "dlog_close": log_delta(c, pc),
        "dlog_range": safe_log(h - l) - safe_log(ph - pl),
        "dlog_high": log_delta(h, ph),
        "dlog_low": log_delta(l, pl),
    }
