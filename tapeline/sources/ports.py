"""What a feed, a broker and a store have to offer. Survey ids: S7 to S14. corpus.py is the store; feeds and brokers are left to the user."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class MarketData(Protocol):
    """A vendor's bars with start <= ts_event < end. Gaps are legal; the implementation paces itself."""

    async def fetch_bars(self, ticker: str, venue: str, interval: str, start: int, end: int) -> DataFrame: ...

    def is_connected(self) -> bool: ...


@runtime_checkable
class Broker(Protocol):
    """A submitted order is accepted, not executed; its derived id shows a repeat. A cancellation is a request."""

    async def submit(self, order: dict) -> None: ...

    async def cancel(self, order_id: str) -> None: ...

    def is_connected(self) -> bool: ...


@runtime_checkable
class Storage(Protocol):
    """Bars written twice are there once; they are read in order."""

    def write_bars(self, rows: DataFrame) -> None: ...

    def read_bars(self, ticker: str, venue: str, interval: str, start: int, end: int) -> DataFrame: ...


@runtime_checkable
class EventStore(Protocol):
    """S11, S12"""

    def append(self, events: DataFrame, kind: str) -> None: ...

    def stream(self, start: int, end: int) -> DataFrame: ...
