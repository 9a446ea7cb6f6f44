"""Kernels by name for streams: ask for indicators and get one column each.

``kernel("rsi", "price", n=14)`` makes one kernel; ``together`` runs several over the same
rows with one state. A frame kernel keeps the last rows it needs, so every indicator over a
bounded frame runs incrementally with the batch definition: NaN until the frame is full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from barline.operators import kernels as K
from barline.plans.sequential import SequentialKernel
from barline.streaming import stateful as S

NAN = float("nan")


def frame_kernel(inputs: Sequence[str], n: int, output: str, value: Callable[[np.ndarray], float]) -> SequentialKernel:
    """``value`` of the last ``n`` rows (rows by inputs, oldest first). State: those rows, flat."""
    width = len(inputs)

    def step(s, *row):
        s = [*s, *row][-n * width :]
        if len(s) < n * width:
            return s, [(NAN,)]
        return s, [(float(value(np.array(s).reshape(n, width))),)]

    return SequentialKernel(tuple(inputs), f"{output} double", list, step)


def _ratio(a: float, b: float) -> float:
    return a / b if b else NAN


def _of_one(x: str, n: int, output: str, value: Callable[[np.ndarray], float]) -> SequentialKernel:
    return frame_kernel((x,), n, output, lambda f: value(f[:, 0]))


def _slope(v: np.ndarray) -> float:
    t = np.arange(len(v)) - (len(v) - 1) / 2
    return float(t @ v) / float(t @ t)


def _true_range(f: np.ndarray) -> float:
    high, low, close = f[1, 0], f[1, 1], f[0, 2]
    return max(high - low, abs(high - close), abs(low - close))


def wilder_mean(n: int, output: str, inputs: Sequence[str], back: int, value: Callable[[np.ndarray], float]) -> SequentialKernel:
    """Wilder's mean of a value over ``back`` rows. State: values seen, mean, then the rows."""
    inner = frame_kernel(inputs, back, output, value)

    def step(s, *row):
        seen, mean = s[:2]
        rows, [(x,)] = inner.step(s[2:], *row)
        if math.isnan(x):
            return [seen, mean, *rows], [(NAN,)]
        seen, mean = min(seen + 1, n), mean + x / n if seen < n else (mean * (n - 1) + x) / n
        return [seen, mean, *rows], [(mean if seen >= n else NAN,)]

    return SequentialKernel(tuple(inputs), f"{output} double", lambda: [0.0, 0.0], step)


def macd_kernel(x: str, fast: int, slow: int) -> SequentialKernel:
    """Difference of two mean-seeded exponential means."""
    both = together({"a": S.ema_kernel(x, fast), "b": S.ema_kernel(x, slow)})

    def step(s, *row):
        s, [(a, b)] = both.step(s, *row)
        return s, [(a - b,)]

    return SequentialKernel(both.inputs, "macd double", both.init, step)


#: One row out for each row in, one output: these can be taken together.
INDICATORS: dict[str, Callable[..., SequentialKernel]] = {
    "ema": lambda x="close", n=20: S.ema_kernel(x, n),
    "rsi": lambda x="close", n=14: S.rsi_kernel(x, n),
    "macd": lambda x="close", fast=12, slow=26: macd_kernel(x, fast, slow),
    "atr": lambda high="high", low="low", close="close", n=14: wilder_mean(n, "atr", (high, low, close), 2, _true_range),
    "sma": lambda x="close", n=20: _of_one(x, n, "sma", np.mean),
    "std": lambda x="close", n=20: _of_one(x, n, "std", np.std),
    "zscore": lambda x="close", n=20: _of_one(x, n, "zscore", lambda v: _ratio(v[-1] - v.mean(), v.std())),
    "wma": lambda x="close", n=20: _of_one(x, n, "wma", lambda v: v @ np.arange(1, len(v) + 1) * 2 / (len(v) * (len(v) + 1))),
    "momentum": lambda x="close", n=10: _of_one(x, n + 1, "momentum", lambda v: v[-1] - v[0]),
    "roc": lambda x="close", n=10: _of_one(x, n + 1, "roc", lambda v: 100 * _ratio(v[-1] - v[0], v[0])),
    "efficiency": lambda x="close", n=10: _of_one(x, n + 1, "efficiency", lambda v: _ratio(abs(v[-1] - v[0]), np.abs(np.diff(v)).sum())),
    "slope": lambda x="close", n=14: _of_one(x, n, "slope", _slope),
    "median": lambda x="close", n=20: _of_one(x, n, "median", np.median),
    "mean_deviation": lambda x="close", n=20: _of_one(x, n, "mean_deviation", lambda v: np.abs(v - v.mean()).mean()),
    "channel_high": lambda high="high", n=20: _of_one(high, n, "channel_high", np.max),
    "channel_low": lambda low="low", n=20: _of_one(low, n, "channel_low", np.min),
    "stochastic": lambda high="high", low="low", close="close", n=14: frame_kernel(
        (high, low, close), n, "stochastic", lambda f: 100 * _ratio(f[-1, 2] - f[:, 1].min(), f[:, 0].max() - f[:, 1].min())),
    "williams_r": lambda high="high", low="low", close="close", n=14: frame_kernel(
        (high, low, close), n, "williams_r", lambda f: -100 * _ratio(f[:, 0].max() - f[-1, 2], f[:, 0].max() - f[:, 1].min())),
    "cci": lambda high="high", low="low", close="close", n=20: frame_kernel(
        (high, low, close), n, "cci", lambda f: (lambda t: _ratio(t[-1] - t.mean(), 0.015 * np.abs(t - t.mean()).mean()))(f.mean(axis=1))),
}

#: State machines with outputs of their own, none, one or several rows for a row.
MACHINES: dict[str, Callable[..., SequentialKernel]] = {
    "parabolic_sar": K.parabolic_sar, "super_trend": K.super_trend, "range_bar": K.range_bar, "tick_reset_bar": K.tick_reset_bar,
    "box_column": K.box_column, "zigzag": K.zigzag, "swing_gate": K.swing_gate, "min_gap": K.min_gap, "hysteresis": K.hysteresis,
    "swings": S.swing_kernel, "alerts": S.alert_kernel,
}


def kernel(name: str, *args, **params) -> SequentialKernel:
    made = INDICATORS.get(name) or MACHINES.get(name)
    if made is None:
        raise KeyError(f"no kernel {name!r}; known: {sorted({**INDICATORS, **MACHINES})}")
    return made(*args, **params)


def together(kernels: dict[str, SequentialKernel]) -> SequentialKernel:
    """Several indicators over the same rows, one column each. State: for every one its
    length and numbers."""
    inputs = tuple(dict.fromkeys(c for k in kernels.values() for c in k.inputs))
    picks = [[inputs.index(c) for c in k.inputs] for k in kernels.values()]
    parts = list(kernels.values())

    def init():
        return [v for k in parts for v in (lambda s: [float(len(s)), *s])(k.init())]

    def step(s, *row):
        out, values, at = [], [], 0
        for k, pick in zip(parts, picks, strict=True):
            size = int(s[at])
            state, [(value,)] = k.step(s[at + 1 : at + 1 + size], *[row[i] for i in pick])
            out += [float(len(state)), *state]
            values.append(value)
            at += 1 + size
        return out, [tuple(values)]

    return SequentialKernel(inputs, ", ".join(f"`{n}` double" for n in kernels), init, step)
