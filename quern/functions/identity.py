"""Identity generators."""

from __future__ import annotations

import secrets
import threading
import time
import uuid

#: Fixed value: digits of base 62.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int = 0) -> str:
    out = ""
    while number:
        number, k = divmod(number, 62)
        out = DIGITS[k] + out
    return out.rjust(max(width, 1), DIGITS[0])


def short_id(now_ms: int | None = None) -> str:
    """42 bits of time and 22 random ones in 11 digits."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    return base62((now & ((1 << 42) - 1)) << 22 | secrets.randbits(22), 11)


def uuid7(now_ms: int | None = None) -> str:
    now = int(time.time() * 1000) if now_ms is None else now_ms
    bits = (now & ((1 << 48) - 1)) << 80 | 7 << 76 | secrets.randbits(12) << 64 | 2 << 62 | secrets.randbits(62)
    return str(uuid.UUID(int=bits))


class Snowflake:
    """41 bits of time, 10 of the worker, 12 of a sequence; increasing within a worker."""

    def __init__(self, worker: int, epoch_ms: int = 1_577_836_800_000, clock=lambda: int(time.time() * 1000)):
        if not 0 <= worker < 1 << 10:
            raise ValueError("a worker has 10 bits")
        self._worker, self._epoch, self._clock, self._lock, self._last, self._n = worker, epoch_ms, clock, threading.Lock(), -1, 0

    def next(self) -> int:
        with self._lock:
            now = max(self._clock() - self._epoch, self._last)
            self._n = (self._n + 1) & 4095 if now == self._last else 0
            if now == self._last and not self._n:
                now += 1
            self._last = now
            return now << 22 | self._worker << 12 | self._n
