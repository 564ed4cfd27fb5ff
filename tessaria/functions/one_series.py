"""The operators of `series` for one weekly series in memory: it has as many values as there are weeks, and what decides
an investigation needs them all at once, so a dozen Spark jobs over some hundred rows would be all overhead.

Missing values are None. Results equal those of `series`, which serves many series at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from tessaria.functions import series as S

Values = Sequence[float | None]


@dataclass(frozen=True)
class Band:
    center: float
    scale: float

    @property
    def limits(self) -> list[float]:
        return [self.center - S.BAND_SIGMA * self.scale, self.center + S.BAND_SIGMA * self.scale]

    def z(self, values: Values) -> list[float]:
        return [(v - self.center) / self.scale if v is not None and self.scale > 0 else 0.0 for v in values]


def band(values: Values) -> Band:
    x = np.array([v for v in values if v is not None], float)
    if not len(x):
        return Band(float("nan"), 0.0)
    center = float(np.median(x))
    low, high = np.percentile(x, [25, 75])
    scale = max(1.4826 * float(np.median(np.abs(x - center))), float(high - low) / 1.349)
    return Band(center, scale if scale > 0 else float(x.std(ddof=1)) if len(x) > 1 else 0.0)


def spans(flags: Sequence[bool]) -> list[tuple[int, int]]:
    """(first, last) of each unbroken stretch."""
    edge = np.diff(np.array([0, *map(int, flags), 0]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


@dataclass(frozen=True)
class Core:
    rule: str
    direction: str
    start: int
    end: int


def core(z: Sequence[float]) -> Core | None:
    """The longest sustained run (downward ones first, then the earliest), else the most extreme week far out."""
    runs = [(-(b - a + 1), side, a, b) for side, sign in enumerate((-1, 1)) for a, b in spans([sign * v >= S.SUSTAINED_SIGMA for v in z]) if b - a + 1 >= S.SUSTAINED_RUN]
    if runs:
        _, side, a, b = min(runs)
        return Core("run", ("down", "up")[side], a, b)
    far = max(range(len(z)), key=lambda i: (abs(z[i]), -i), default=None)
    if far is None or abs(z[far]) < S.EXTREME_SIGMA:
        return None
    return Core("extreme", "down" if z[far] < 0 else "up", far, far)


def roles(z: Sequence[float], c: Core) -> list[str]:
    """'event' for the core widened over neighbours on its side, 'buffer' for two weeks around it, else 'baseline'."""
    sign = -1 if c.direction == "down" else 1
    first, last = next((a, b) for a, b in spans([sign * v >= S.WIDEN_SIGMA or c.start <= i <= c.end for i, v in enumerate(z)]) if a <= c.start <= b)
    return ["event" if first <= i <= last else "buffer" if first - S.BUFFER <= i <= last + S.BUFFER else "baseline" for i in range(len(z))]


def first_crossing(values: Values, z: Sequence[float], k: float = 0.5, h: float = 4.0) -> int | None:
    hi = lo = 0.0
    for i, v in enumerate(values):
        hi, lo = (0.0, 0.0) if v is None else (max(0.0, hi + z[i] - k), min(0.0, lo + z[i] + k))
        if hi > h or lo < -h:
            return i
    return None


def best_lag(cause: Values, effect: Values, max_lag: int = 4) -> int | None:
    """The lag of the effect behind the cause with the largest correlation; the earliest of equals."""
    pairs = np.array([(x, y) for x, y in zip(cause, effect) if x is not None and y is not None], float).reshape(-1, 2)
    found = []
    for lag in range(-max_lag, max_lag + 1):
        x, y = pairs[max(0, -lag) : len(pairs) - max(0, lag), 0], pairs[max(0, lag) : len(pairs) - max(0, -lag), 1]
        if len(x) >= 3 and x.std() > 0 and y.std() > 0:
            found.append((-round(abs(float(np.corrcoef(x, y)[0, 1])), 12), lag))
    return min(found)[1] if found else None
