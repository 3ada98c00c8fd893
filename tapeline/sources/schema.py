"""Record layouts and the values their columns may have. Survey ids: S1, P3, P16, V42."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE, QUANTITY, MONEY = T.DecimalType(18, 8), T.DecimalType(28, 8), T.DecimalType(38, 8)
SCHEMA_VERSION = "1"

#: The domains of the string columns.
SIDES = ("BUY", "SELL")
VENUES = ("NASDAQ", "NYSE", "ARCA", "AMEX", "BATS", "TSX", "TSXV", "SMART")
CANADIAN = ("TSX", "TSXV")
SESSIONS = ("PRE", "REGULAR", "POST", "CLOSED")
ORDER_TYPES = ("MARKET", "LIMIT", "STOP", "STOP_LIMIT")
TIMES_IN_FORCE = ("DAY", "GTC", "IOC", "FOK")
LIQUIDITY = ("MAKER", "TAKER", "UNKNOWN")
TRIGGERS = ("MARKET", "LIMIT", "STOP")
SOURCES = ("ibkr", "yfinance", "firstrate", "kibot", "alpaca_iex", "synthetic")
SECOND = 1_000_000_000
INTERVALS = {"1s": SECOND, "5s": 5 * SECOND, "15s": 15 * SECOND, "30s": 30 * SECOND, "1m": 60 * SECOND, "5m": 300 * SECOND, "15m": 900 * SECOND, "30m": 1800 * SECOND, "1h": 3600 * SECOND, "1d": 86_400 * SECOND}


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_L, _I, _S = T.LongType(), T.IntegerType(), T.StringType()
_EVENT = (("ts_event", _L, False), ("ts_init", _L, False), ("seq", _I, False))
_SYMBOL = (("ticker", _S, False), ("venue", _S, False))

#: The stored bar, column by column. Spark keeps the version as metadata of the first column.
BAR = _struct(
    *_SYMBOL, *_EVENT, ("interval", _S, False),
    ("open", PRICE, False), ("high", PRICE, False), ("low", PRICE, False), ("close", PRICE, False),
    ("volume", QUANTITY, False), ("vwap", PRICE, True), ("trade_count", _L, True),
    ("session_date", T.DateType(), False), ("source", _S, False), ("ingested_at", _L, False),
)
BAR = T.StructType([T.StructField("ticker", _S, False, {"schema_version": SCHEMA_VERSION}), *BAR.fields[1:]])
PROVENANCE = ("session_date", "source", "ingested_at")
PARTITIONS = ("venue", "ticker", "session_date")

QUOTE = _struct(*_SYMBOL, *_EVENT, ("bid_price", PRICE, False), ("bid_size", QUANTITY, False), ("ask_price", PRICE, False), ("ask_size", QUANTITY, False))
TICK = _struct(*_SYMBOL, *_EVENT, ("price", PRICE, False), ("size", QUANTITY, False), ("aggressor", _S, True))
SESSION = _struct(("venue", _S, False), *_EVENT, ("session", _S, False))
HALT = _struct(*_SYMBOL, *_EVENT, ("reason", _S, False))
RESUME = _struct(*_SYMBOL, *_EVENT, ("auction_price", PRICE, True))
INTENT = _struct(
    *_SYMBOL, *_EVENT, ("side", _S, False), ("entry", _S, False), ("entry_price", PRICE, True), ("invalidation", PRICE, False), ("target_r", PRICE, False),
    ("horizon_ns", _L, False), ("strategy", _S, False), ("strategy_version", _S, False), ("rationale", _S, False),
)
ORDER = _struct(
    ("id", _S, False), ("intent_id", _S, False), *_SYMBOL, *_EVENT, ("side", _S, False), ("quantity", QUANTITY, False), ("order_type", _S, False),
    ("limit_price", PRICE, True), ("stop_price", PRICE, True), ("time_in_force", _S, False), ("config_hash", _S, False),
)
FILL = _struct(
    ("id", _S, False), ("order_id", _S, False), *_SYMBOL, *_EVENT, ("side", _S, False), ("price", PRICE, False), ("quantity", QUANTITY, False),
    ("commission_amount", MONEY, False), ("commission_ccy", _S, False), ("liquidity", _S, False), ("reference_price", PRICE, True), ("broker_exec_id", _S, False),
)


def require(columns: dict[str, T.DataType], wanted: T.StructType) -> None:
    """Refuse a table whose columns lack a field, hold floats for decimals, or anything but integers for counts."""
    for f in wanted.fields:
        have = columns.get(f.name)
        if have is None:
            raise TypeError(f"column {f.name} is missing")
        if isinstance(f.dataType, T.DecimalType) and isinstance(have, (T.FloatType, T.DoubleType)):
            raise TypeError(f"column {f.name} is floating point; prices and sizes are decimals")
        if isinstance(f.dataType, (T.LongType, T.IntegerType)) and not isinstance(have, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            raise TypeError(f"column {f.name} is {have.simpleString()}, not an integer")
