"""Time as nanoseconds since 1970 UTC. Survey ids: X1, X2, R13, T3, V37. The only module that reads the wall clock."""

from __future__ import annotations

import time
from datetime import UTC, datetime, timedelta
from typing import Protocol

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def to_datetime(ns: int) -> datetime:
    """To the microsecond at or before ns."""
    return _EPOCH + timedelta(microseconds=ns // 1000)


def to_nanos(moment: datetime) -> int:
    """Exact; a time without a zone is an error."""
    if moment.tzinfo is None:
        raise ValueError("a time needs a zone")
    return (moment - _EPOCH) // timedelta(microseconds=1) * 1000


class Clock(Protocol):
    def now_ns(self) -> int: ...


class LiveClock:
    def now_ns(self) -> int:
        return time.time_ns()


class SimClock:
    """A clock for replays: it stands still until told the time, and never runs back."""

    def __init__(self, start_ns: int = 0):
        self._now = start_ns

    def now_ns(self) -> int:
        return self._now

    def advance_to(self, ns: int) -> None:
        if ns < self._now:
            raise ValueError("a clock doesn't run backwards")
        self._now = ns

    def advance(self, by_ns: int) -> None:
        if by_ns < 0:
            raise ValueError("a clock doesn't run backwards")
        self._now += by_ns
