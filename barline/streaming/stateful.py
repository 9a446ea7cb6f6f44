"""Small kernels for streams; ``keyed`` runs them, ``by_name`` finds them."""

from __future__ import annotations

from barline.plans.sequential import SequentialKernel


def ema_kernel(x: str, n: int) -> SequentialKernel:
    """Mean-seeded exponential mean; state: values seen (capped at n), seed sum, mean."""
    k = 2.0 / (n + 1)

    def step(s, v):
        c, acc, y = s
        if c < n:
            c, acc = c + 1, acc + v
            y = acc / n
            return [c, acc, y], [(y if c == n else float("nan"),)]
        y += k * (v - y)
        return [c, acc, y], [(y,)]

    return SequentialKernel((x,), "ema double", lambda: [0.0, 0.0, 0.0], step)


def rsi_kernel(x: str, n: int) -> SequentialKernel:
    """Wilder strength; state: moves seen (capped), previous value, mean gain, mean loss."""

    def step(s, v):
        c, prev, g, lo = s
        if c < 0:
            return [0.0, v, 0.0, 0.0], [(float("nan"),)]
        up, dn = max(v - prev, 0.0), max(prev - v, 0.0)
        if c < n:
            c, g, lo = c + 1, g + up / n, lo + dn / n
        else:
            g, lo = (g * (n - 1) + up) / n, (lo * (n - 1) + dn) / n
        out = float("nan") if c < n else (100.0 if lo <= 0 else 100.0 - 100.0 / (1.0 + g / lo))
        return [c, v, g, lo], [(out,)]

    return SequentialKernel((x,), "rsi double", lambda: [-1.0, 0.0, 0.0, 0.0], step)


def swing_kernel() -> SequentialKernel:
    """Local extremes one bar late; state: bars seen (capped at 2) and the two last highs and lows."""

    def step(s, high, low):
        n, h1, h2, l1, l2 = s  # 1 = previous bar, 2 = the one before
        rows = []
        if n >= 2:
            if h1 > h2 and h1 > high:
                rows.append((1, h1))
            if l1 < l2 and l1 < low:
                rows.append((0, l1))
        return [min(n + 1, 2.0), high, h1, low, l1], rows

    return SequentialKernel(("high", "low"), "is_high int, value double", lambda: [0.0] * 5, step)


def alert_kernel(x: str, hi: float, lo: float) -> SequentialKernel:
    """Edge-triggered alerts: +1 on entering above hi, -1 on entering below lo; state: current zone."""

    def step(s, v):
        zone = 1.0 if v > hi else (-1.0 if v < lo else 0.0)
        rows = [(int(zone), v)] if zone != s[0] and zone != 0.0 else []
        return [zone], rows

    return SequentialKernel((x,), "zone int, at_value double", lambda: [0.0], step)
