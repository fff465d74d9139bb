"""What to do when a call fails: classify, wait, try again, within a rate."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

# Statuses that are tried again, and the usual figures.
RETRIED = (429, 502, 503, 504)
TRIES, BASE, CAP, RATE, BURST = 4, 0.25, 30.0, 20.0, 5
PER_HOST, FAN_OUT = 8, 16


def retry_after(value: str | None, now: float | None = None) -> float | None:
    """Seconds of a Retry-After header (a number or a date); never negative."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return None


def full_jitter(base: float = BASE, cap: float = CAP, rng: random.Random | None = None) -> Callable[[int, float], float]:
    r = rng or random.Random()
    return lambda attempt, _: r.uniform(0, min(cap, base * 2**attempt))


def decorrelated(base: float = BASE, cap: float = CAP, rng: random.Random | None = None) -> Callable[[int, float], float]:
    r = rng or random.Random()
    return lambda _, last: r.uniform(base, max(base, min(cap, 3 * (last or base))))


def constant(seconds: float) -> Callable[[int, float], float]:
    return lambda *_: seconds


class Rate:
    """A token bucket: how long the next retry has to wait, at most the time a whole burst takes. Per worker."""

    def __init__(self, rate: float = RATE, burst: int = BURST, clock: Callable[[], float] = time.monotonic):
        self.rate, self.burst, self.clock, self.tokens, self.at, self.lock = rate, burst, clock, float(burst), clock(), threading.Lock()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lock"}

    def __setstate__(self, held):
        self.__dict__.update(held)
        self.lock = threading.Lock()

    def wait(self) -> float:
        with self.lock:
            now = self.clock()
            self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate) - 1
            self.at = now
            return min(max(0.0, -self.tokens / self.rate), self.burst / self.rate)


@dataclass
class RetryPolicy:
    tries: int = TRIES
    statuses: tuple[int, ...] = RETRIED
    backoff: Callable[[int, float], float] = field(default_factory=decorrelated)
    governor: Rate | None = None

    def retried(self, status: int | None) -> bool:
        """None is a transport error."""
        return status is None or status in self.statuses

    def delay(self, attempt: int, last: float, after: str | None) -> tuple[float, float]:
        """Seconds to wait before the next try, and the backoff to remember."""
        asked = retry_after(after)
        wait = self.backoff(attempt, last) if asked is None else asked
        return wait + (self.governor.wait() if self.governor else 0.0), wait


class Admission:
    """At most so many calls at once, by key; of a worker."""

    def __init__(self, most: int = PER_HOST):
        self.most, self.held, self.lock = max(1, most), {}, threading.Lock()

    @contextmanager
    def slot(self, key: str) -> Iterator[None]:
        with self.lock:
            gate = self.held.setdefault(key, threading.BoundedSemaphore(self.most))
        with gate:
            yield


_ADMISSIONS: dict[int, Admission] = {}


def admission(most: int) -> Admission:
    """The one admission with this bound that all tasks of a worker share."""
    return _ADMISSIONS.setdefault(most, Admission(most))


def host_key(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}"
