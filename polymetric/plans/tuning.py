"""Tuning knobs by measured times."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

#: Knob: least, most, default.
KNOBS = {"shuffle_partitions": (1, 512, 8), "buckets": (1, 256, 16), "pivots": (1, 8, 2), "sample": (100, 10_000, 2000), "batch": (16, 10_000, 1000), "broadcast_mb": (1, 256, 10)}

Times = tuple[float, float, float]


def knobs_of(action: list[float]) -> dict[str, int]:
    """Knobs from numbers of 0 to 1: a share of the most, not below the least."""
    return {k: max(lo, int(hi * min(1.0, max(0.0, a)))) for (k, (lo, hi, _)), a in zip(KNOBS.items(), action)}


def reward(default: float, last: float, now: float) -> float:
    """Reward of one time against the default and the last: quadratic in the change against the default.

    Better than the default but not than the last gives nothing.
    """
    d0, d1 = (default - now) / default, (last - now) / last
    if d0 > 0:
        r = ((1 + d0) ** 2 - 1) * abs(1 + d1)
        return 0.0 if d1 < 0 else r
    return -((1 - d0) ** 2 - 1) * abs(1 - d1)


@dataclass
class Tuner:
    """Random search with the reward above; keeps the best mean of times."""

    run: Callable[[dict[str, int]], Times]
    seed: int = 1
    best: tuple[float, dict[str, int]] | None = None
    log: list[tuple[dict[str, int], Times, float]] = field(default_factory=list)

    def search(self, steps: int) -> dict[str, int]:
        rng = random.Random(self.seed)
        knobs = {k: v[2] for k, v in KNOBS.items()}
        first = last = self.run(knobs)
        self._keep(knobs, first, 0.0)
        for _ in range(steps):
            knobs = knobs_of([rng.random() for _ in KNOBS])
            now = self.run(knobs)
            self._keep(knobs, now, sum(reward(a, b, c) for a, b, c in zip(first[1:], last[1:], now[1:])))
            last = now
        return self.best[1]

    def _keep(self, knobs: dict[str, int], times: Times, got: float) -> None:
        self.log.append((knobs, times, got))
        mean = sum(times) / 3
        if self.best is None or mean < self.best[0]:
            self.best = (mean, knobs)

    def change(self) -> float:
        """Percent by which the best mean is under the default's."""
        first = sum(self.log[0][1]) / 3
        return 100 * (first - self.best[0]) / first if first else 0.0
