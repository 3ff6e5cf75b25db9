"""Driver-side recovery: retries with growing, jittered delays, and a circuit breaker. Tasks on executors are retried by Spark itself."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Backoff:
    attempts: int = 3
    first: float = 0.1
    growth: float = 2.0
    most: float = 30.0
    jitter: float = 0.1

    def delay(self, failures: int, rnd: Callable[[], float] = random.random) -> float:
        """Seconds before the next attempt, up to ``jitter`` of them more or less."""
        base = min(self.most, self.first * self.growth ** (failures - 1))
        return base * (1 + self.jitter * (2 * rnd() - 1))


@dataclass
class Breaker:
    """Opens after so many failures in a row; after ``rest`` seconds one call is let through, and its outcome closes or opens it again."""

    failures: int = 5
    rest: float = 60.0
    clock: Callable[[], float] = time.monotonic
    count: int = field(default=0, init=False)
    opened: float | None = field(default=None, init=False)

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.rest else "open"

    def call(self, action: Callable[[], object]) -> object:
        if self.state == "open":
            raise RuntimeError("the circuit is open")
        try:
            out = action()
        except Exception:
            self.count += 1
            if self.count >= self.failures or self.opened is not None:
                self.opened = self.clock()
            raise
        self.count, self.opened = 0, None
        return out


def retry(action: Callable[[], object], backoff: Backoff = Backoff(), worth: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> object:
    """Run again after failures that are ``worth`` it; the last failure is raised."""
    for failures in range(1, backoff.attempts + 1):
        try:
            return action()
        except Exception as e:
            if failures == backoff.attempts or not worth(e):
                raise
            sleep(backoff.delay(failures))
    raise ValueError("attempts must be at least 1")
