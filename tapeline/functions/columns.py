"""Derived columns as Column functions. Survey ids in each docstring; NULL means unknown and is never made zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import schema

_EXACT = "decimal(18,8)"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _times(x: Column, digits: int, scale: int, quantity: Column) -> Column:
    """x as decimal(digits, scale) times a quantity, all digits kept: its whole part and its fraction are multiplied apart, as one product of both would not fit."""
    x = x.cast(f"decimal({digits},{scale})")
    q = quantity.cast("decimal(28,8)")
    whole = F.floor(q)
    parts = x * whole.cast(f"decimal({37 - digits},0)"), x * (q - whole).cast("decimal(9,8)")
    return (parts[0].cast("decimal(37,16)") + parts[1].cast("decimal(37,16)")).cast("decimal(38,16)")


def product(a: Column | str, b: Column | str) -> Column:
    """Exact product of a price and a quantity; ANSI casts refuse what does not fit."""
    return _times(_col(a), 18, 8, _col(b))


def latency_ns() -> Column:
    """May be negative."""
    return F.col("ts_init") - F.col("ts_event")


def interval_ns(interval: Column | str) -> Column:
    """Nanoseconds of a bar interval; an unknown one is an error."""
    key = _col(interval)
    table = F.create_map(*[F.lit(x) for kv in schema.INTERVALS.items() for x in kv])
    return F.when(F.map_contains_key(table, key), table[key]).otherwise(F.when(key.isNotNull(), F.raise_error(F.concat(F.lit("unknown interval "), key)).cast("long")))


def ts_open() -> Column:
    """Bars are stamped at their close."""
    return F.col("ts_event") - interval_ns("interval")


def bar_range() -> Column:
    """P5"""
    return F.col("high") - F.col("low")


def is_up() -> Column:
    """Strictly up."""
    return F.col("close") > F.col("open")


def spread() -> Column:
    """Negative when crossed."""
    return F.col("ask_price") - F.col("bid_price")


def mid() -> Column:
    """P8"""
    return ((F.col("bid_price") + F.col("ask_price")) / 2).cast("decimal(28,18)")


def microprice() -> Column:
    """Mid weighted by the opposite sizes; the plain mid without any size."""
    total = F.col("bid_size") + F.col("ask_size")
    weighted = product("bid_price", "ask_size") + product("ask_price", "bid_size")
    return F.when(total == 0, mid()).otherwise((weighted / F.nullif(total, F.lit(0))).cast("decimal(28,18)"))


def is_locked() -> Column:
    """P10"""
    return F.col("bid_price") == F.col("ask_price")


def is_crossed() -> Column:
    """Flagged, never rejected."""
    return F.col("bid_price") > F.col("ask_price")


def is_tradable(session: Column | str = "session") -> Column:
    """P13"""
    return _col(session) != "CLOSED"


def opens_regular_trading(session: Column | str = "session") -> Column:
    """P14"""
    return _col(session) == "REGULAR"


def sign(side: Column | str = "side") -> Column:
    """P15"""
    return F.when(_col(side) == "BUY", 1).when(_col(side) == "SELL", -1)


def opposite(side: Column | str = "side") -> Column:
    """P15"""
    return F.when(_col(side) == "BUY", "SELL").when(_col(side) == "SELL", "BUY")


def currency(venue: Column | str = "venue") -> Column:
    """P16"""
    return F.when(_col(venue).isin(*schema.CANADIAN), "CAD").otherwise("USD")


def symbol(ticker: Column | str = "ticker", venue: Column | str = "venue") -> Column:
    """P17"""
    return F.concat_ws(".", _col(ticker), _col(venue))


def slippage_per_share() -> Column:
    """Positive is a cost for both sides; NULL without a reference."""
    return (F.col("price") - F.col("reference_price")) * sign()


def slippage_cost() -> Column:
    """P20"""
    return product(slippage_per_share(), F.col("quantity"))


def total_cost() -> Column:
    """NULL when slippage is unmeasured, never the commission alone."""
    return F.col("commission_amount") + slippage_cost()


def needs_limit_price(order_type: Column | str = "order_type") -> Column:
    """P22"""
    return _col(order_type).isin("LIMIT", "STOP_LIMIT")


def needs_stop_price(order_type: Column | str = "order_type") -> Column:
    """P22"""
    return _col(order_type).isin("STOP", "STOP_LIMIT")


def is_marketable() -> Column:
    """P23"""
    return (F.col("order_type") == "MARKET") | F.col("time_in_force").isin("IOC", "FOK")


def risk_per_share(entry: Column | str) -> Column:
    """Distance from the realised entry to the stop; none is an error."""
    gap = F.abs(_col(entry) - F.col("invalidation"))
    return F.when(gap == 0, F.raise_error(F.lit("no defined risk: the stop is at the entry")).cast("decimal(19,8)")).otherwise(gap)


def target_price(entry: Column | str) -> Column:
    """P25: entry plus risk times target_r, to the side's good; not above zero is an error."""
    price = (_col(entry) + product(risk_per_share(entry), "target_r") * sign()).cast("decimal(38,8)")
    return F.when(price <= 0, F.raise_error(F.lit("the target isn't a price")).cast("decimal(38,8)")).otherwise(price)


def expires_at() -> Column:
    """P26"""
    return F.col("ts_event") + F.col("horizon_ns")


def reward_to_risk() -> Column:
    """Gross."""
    return F.col("target_r")


def is_flat() -> Column:
    """P28"""
    return F.col("side").isNull()


def is_long() -> Column:
    """P28"""
    return F.coalesce(F.col("side") == "BUY", F.lit(False))


def is_short() -> Column:
    """P28"""
    return F.coalesce(F.col("side") == "SELL", F.lit(False))


def signed_quantity() -> Column:
    """Zero when flat."""
    return F.coalesce(_signed(F.col("quantity").cast("decimal(28,8)")), F.lit(0).cast("decimal(28,8)"))


def _signed(x: Column) -> Column:
    """x, below zero for a sale; a product with sign() would lose a digit."""
    return F.when(F.col("side") == "SELL", -x).when(F.col("side") == "BUY", x)


def unrealised_pnl(mark: Column | str) -> Column:
    """Zero when flat, gross of fees."""
    open_ = _times(_col(mark) - F.col("average_price"), 22, 12, signed_quantity())
    return F.when(is_flat(), F.lit(0).cast("decimal(38,16)")).otherwise(open_)


def market_value(mark: Column | str) -> Column:
    """Negative for shorts."""
    return product(mark, signed_quantity())


def net_realised_pnl() -> Column:
    """P32"""
    return F.col("realised_pnl") - F.col("fees")


def total_pnl(mark: Column | str) -> Column:
    """P33"""
    return net_realised_pnl() + unrealised_pnl(mark)


def realised_r(risk: Column | str, size: Column | str) -> Column:
    """Net result in multiples of what was risked; no risk is an error."""
    staked = product(risk, size)
    return F.when(staked <= 0, F.raise_error(F.lit("total risk must be above zero")).cast("double")).otherwise(net_realised_pnl().cast("double") / staked.cast("double"))


def same_currency(a: Column | str, b: Column | str, value: Column) -> Column:
    """Value, unless the two currencies differ, which is an error."""
    return F.when(_col(a) == _col(b), value).otherwise(F.raise_error(F.lit("two currencies")).cast("decimal(38,8)"))


def money_zero() -> Column:
    """What a sum of money starts from."""
    return F.lit(0).cast(schema.MONEY)


def quantity_sum(a: Column | str, b: Column | str) -> Column:
    """P38"""
    return (_col(a) + _col(b)).cast("decimal(28,8)")


def is_zero(a: Column | str) -> Column:
    """P38"""
    return _col(a) == 0


def quantity_difference(a: Column | str, b: Column | str) -> Column:
    """Below zero is an error."""
    left = _col(a) - _col(b)
    return F.when(left < 0, F.raise_error(F.lit("quantity below zero")).cast("decimal(28,8)")).otherwise(left)


def price_difference(a: Column | str, b: Column | str) -> Column:
    """A signed decimal, not a price."""
    return _col(a) - _col(b)


def exact_price(value: Column | str) -> Column:
    """P40, P41, D-4: a price from a feed's double or text; digits beyond the eighth are an error instead of rounded off."""
    x = _col(value)
    narrow = x.cast(_EXACT)
    return F.when(narrow.cast("decimal(38,18)") == x.cast("decimal(38,18)"), narrow).when(x.isNull(), narrow).otherwise(F.raise_error(F.lit("more than eight decimals")).cast(_EXACT))


def try_price(value: Column | str) -> Column:
    """As exact_price, but NULL for what isn't one."""
    x = _col(value)
    narrow = x.try_cast(_EXACT)
    return F.when(narrow.cast("decimal(38,18)") == x.try_cast("decimal(38,18)"), narrow)


def qualified_name(name: Column | str = "name", version: Column | str = "version") -> Column:
    """name@version, or the name alone where the version is NULL."""
    return F.concat_ws("@", _col(name), _col(version))


def to_micros(ns: Column | str) -> Column:
    """Whole microseconds at or before ns, for negative times too."""
    n = _col(ns)
    return F.call_function("div", n - F.pmod(n, F.lit(1000)), F.lit(1000))


def to_timestamp(ns: Column | str) -> Column:
    """A timestamp for windows and display."""
    return F.timestamp_micros(to_micros(ns))


def to_nanos(ts: Column | str) -> Column:
    """Exact; a timestamp without a zone is read as UTC."""
    return F.unix_micros(_col(ts).cast("timestamp")) * 1000


def is_version(text: Column | str) -> Column:
    """X10, V35"""
    return _col(text).rlike(r"\A[0-9]+\.[0-9]+\.[0-9]+\z")


def version_parts(text: Column | str) -> Column:
    """Struct that sorts as versions do."""
    parts = F.split(_col(text), r"\.")
    return F.when(is_version(text), F.struct(*[parts[i].cast("int").alias(n) for i, n in enumerate(("major", "minor", "patch"))])).otherwise(F.raise_error(F.concat(F.lit("not a version: "), _col(text))).cast("struct<major:int,minor:int,patch:int>"))


def value_of(values: Column | str, name: str) -> Column:
    """A named feature; one that was never declared is an error, one that is warming up NULL."""
    m = _col(values)
    return F.when(F.map_contains_key(m, F.lit(name)), m[name]).otherwise(F.raise_error(F.lit(f"feature {name} isn't declared")).cast("double"))


def requires(*names: Column | str) -> Column:
    """all present; true of no names."""
    out = F.lit(True)
    for n in names:
        out = out & _col(n).isNotNull()
    return out
