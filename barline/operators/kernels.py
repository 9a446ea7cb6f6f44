"""Small state machines used by batch jobs and by keyed streaming state."""

from __future__ import annotations

import math

from barline.plans.sequential import SequentialKernel

NAN = float("nan")


def parabolic_sar(start: float = 0.02, step: float = 0.02, top: float = 0.2, guarded: bool = True) -> SequentialKernel:
    """Stop and reverse (Wilder 1978), written once for both sides by mirroring prices.

    The stop moves towards the extreme of the trend and, if ``guarded``, never into the range
    of the two bars before; a bar that trades through it turns the trend, with the old extreme
    as the new stop. Guarded trends begin with the second bar, on the side to which it breaks
    the first; unguarded ones begin upwards with the first bar.
    State: side, stop, extreme, factor, and the two last bars as (high, low), newest first.
    """

    def advance(s, high, low):
        side, stop, extreme, factor, h1, l1, h2, l2 = s
        ahead = high if side > 0 else low
        if math.isnan(h1):
            stop, extreme = low, high
        elif guarded and math.isnan(h2):
            side = 1.0 if high > h1 else -1.0
            stop, extreme = (l1, high) if side > 0 else (h1, low)
        else:
            stop += factor * (extreme - stop)
            behind = low if side > 0 else high
            if guarded:
                stop = min(stop, l1, l2) if side > 0 else max(stop, h1, h2)
            if side * (behind - stop) < 0:
                side, stop, extreme, factor = -side, extreme, behind, start
            elif side * (ahead - extreme) > 0:
                extreme, factor = ahead, min(factor + step, top)
        return [side, stop, extreme, factor, high, low, h1, l1], [(stop, side)]

    return SequentialKernel(
        ("high", "low"), "sar double, sar_dir double", lambda: [1.0, 0.0, 0.0, start, NAN, NAN, NAN, NAN], advance
    )


def super_trend(mult: float = 3.0) -> SequentialKernel:
    """Bands at ``mult`` mean ranges around the bar's middle. The upper one only falls and the
    lower one only rises, until the close before has crossed it, which sets it anew. The trend
    turns when the close crosses the band it follows. Without a mean range only the close is kept.

    State: close before, upper band, lower band, side.
    """

    def ratchet(band: float, fresh: float, crossed: bool, tighter) -> float:
        return fresh if crossed or math.isnan(band) else tighter(band, fresh)

    def advance(s, high, low, close, atr):
        before, upper, lower, side = s
        if math.isnan(atr):
            return [close, upper, lower, side], [(NAN, side)]
        middle, reach = (high + low) / 2.0, mult * atr
        upper = ratchet(upper, middle + reach, before > upper, min)
        lower = ratchet(lower, middle - reach, before < lower, max)
        if (lower - close if side > 0 else close - upper) > 0:
            side = -side
        return [close, upper, lower, side], [(lower if side > 0 else upper, side)]

    return SequentialKernel(
        ("high", "low", "close", "st_atr"), "st_level double, st_dir double", lambda: [NAN, NAN, NAN, 1.0], advance
    )


def range_bar(width: float, atr: tuple[int, float, float, float] | None = None) -> SequentialKernel:
    """A bar closes when price has moved ``width`` from its open.

    With ``atr=(n, mult, lo, hi)`` the width follows the mean of the last ``n`` ranges,
    clamped to [lo, hi]: at first those of the first ``n`` price moves, which open no
    bar, then those of finished bars.
    State: has open (below 0: gathering moves), open, high, low, start, volume, ticks,
    then recent ranges.
    """

    def advance(s, price, volume, at):
        head, recent = s[:7], s[7:]
        started, o, h, l, start, vol, n = head
        if atr and started <= 0:
            recent = [*recent, abs(price - o)] if started < 0 else recent
            return [1.0 if len(recent) == atr[0] else -1.0, price, price, price, at, 0.0, 0.0, *recent], []
        if not started:
            return [1.0, price, price, price, at, 0.0, 0.0, *recent], []
        h, l, vol, n = max(h, price), min(l, price), vol + volume, n + 1
        limit = width
        if atr and recent:
            limit = min(max(sum(recent) / len(recent) * atr[1], atr[2]), atr[3])
        if abs(price - o) < limit:
            return [1.0, o, h, l, start, vol, n, *recent], []
        row = (o, h, l, price, vol, int(n), int(start))
        if atr:
            recent = [*recent, h - l][-atr[0]:]
        return [1.0, price, price, price, at, 0.0, 0.0, *recent], [row]

    return SequentialKernel(
        ("price", "volume", "at"),
        "open double, high double, low double, close double, volume double, n_ticks long, start_us long",
        lambda: [0.0] * 7,
        advance,
    )


def tick_reset_bar(threshold: float) -> SequentialKernel:
    """Bar closes when its summed volume reaches the threshold; the overshoot is dropped."""

    def advance(s, price, volume, at):
        started, o, h, l, start, vol, n = s
        if not started:
            o = h = l = price
            start = at
        h, l, vol, n = max(h, price), min(l, price), vol + volume, n + 1
        if vol >= threshold:
            return [0.0] * 7, [(o, h, l, price, vol, int(n), int(start))]
        return [1.0, o, h, l, start, vol, n], []

    return SequentialKernel(
        ("price", "volume", "at"),
        "open double, high double, low double, close double, volume double, n_ticks long, start_us long",
        lambda: [0.0] * 7,
        advance,
    )


def box_column(box: float, reversal: int) -> SequentialKernel:
    """Boxes of fixed size; a column turns after ``reversal`` boxes the other way.

    State: direction (0 before the first price), level.  Emits level, direction
    and whether the box opens a new column.
    """

    def advance(s, price):
        side, level = s
        if side == 0:
            level = math.floor(price / box) * box
            return [1.0, level], [(level, 1, 1)]
        boxes = int((price - level) / box)
        ahead = boxes * side
        if ahead < 1 and ahead > -reversal:
            return s, []
        turned = ahead < 0
        side = -side if turned else side
        rows = []
        for i in range(abs(boxes)):
            level += box * side
            rows.append((level, int(side), int(turned and i == 0)))
        return [side, level], rows

    return SequentialKernel(
        ("price",), "level double, direction int, new_column int", lambda: [0.0, 0.0], advance
    )


def zigzag(min_swing: float) -> SequentialKernel:
    """Support and resistance from swings of at least ``min_swing``.

    State: direction, running high, running low, support, resistance, started.
    """

    def advance(s, high, low):
        side, rh, rl, sup, res, started = s
        if not started:
            return [0.0, high, low, low, high, 1.0], [(low, high, 0)]
        rh, rl = max(rh, high), min(rl, low)
        falls, rises = rh - low >= min_swing, high - rl >= min_swing
        if side >= 0 and falls:
            side, res, rl = -1.0, rh, low
        elif side <= 0 and rises:
            side, sup, rh = 1.0, rl, high
        return [side, rh, rl, sup, res, 1.0], [(sup, res, int(side))]

    return SequentialKernel(
        ("high", "low"), "support double, resistance double, zz_dir int", lambda: [0.0] * 6, advance
    )


def swing_gate() -> SequentialKernel:
    """Keeps a swing of the other side than the last kept one, and one of the same side only
    when it goes beyond it. State: side of the last kept swing (0: none) and its value."""

    def advance(s, is_high, value):
        side, best = s
        own = 1.0 if is_high else -1.0
        if own == side and own * (value - best) <= 0:
            return s, [(0,)]
        return [own, value], [(1,)]

    return SequentialKernel(("is_high", "value"), "kept int", lambda: [0.0, 0.0], advance)


def min_gap(gap: float) -> SequentialKernel:
    """Keep an event when at least ``gap`` after the last kept one."""

    def advance(s, at):
        (last,) = s
        if math.isnan(last) or at - last >= gap:
            return [at], [(1,)]
        return s, []

    return SequentialKernel(("at",), "kept int", lambda: [NAN], advance)


def hysteresis(n: int) -> SequentialKernel:
    """Held state follows the raw state only after ``n`` rows in a row disagree with it.

    Works on runs: ``raw`` state and ``length`` of the run.  State: held value.
    Emits the held value at the run start and the row offset at which it changes
    (-1 when it does not).
    """

    def advance(s, raw, length):
        (held,) = s
        if math.isnan(held):
            return [raw], [(raw, -1)]
        if raw == held:
            return s, [(held, -1)]
        if length >= n:
            return [raw], [(held, n - 1)]
        return s, [(held, -1)]

    return SequentialKernel(("raw", "length"), "held double, flip_at int", lambda: [NAN], advance)
