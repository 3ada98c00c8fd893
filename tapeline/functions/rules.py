"""Integrity rules as (id, condition under which a row is rejected); V1 to V42 of the survey.

strict() stops at the first bad row, quarantine() sets bad rows aside with the names of the rules they break. A rule that
compares with NULL doesn't hold; columns that must not be NULL have a rule of their own (D-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import schema
from . import columns as c

Rules = list[tuple[str, Column]]


def finite(name: str) -> Column:
    """D-13: for doubles, before any cast makes NaN a NULL."""
    x = F.col(name).cast("double")
    return F.isnan(x) | (F.abs(x) == float("inf"))


def present(*names: str) -> Rules:
    return [(f"null_{n}", F.col(n).isNull()) for n in names]


def event() -> Rules:
    return [*present("ts_event", "ts_init", "seq"), ("V1_seq", F.col("seq") < 0)]


def listing() -> Rules:
    """V5, V6, V42. White space is all that a regular expression calls so."""
    t = F.col("ticker")
    return [
        *present("ticker", "venue"),
        ("V5_ticker_empty", t == ""),
        ("V5_ticker_space", t.rlike(r"(?U)^\s|\s$")),
        ("V5_ticker_case", F.upper(t) != t),
        ("V6_venue_is_route", F.col("venue") == "SMART"),
        ("V42_venue", ~F.col("venue").isin(*schema.VENUES)),
    ]


def price(*names: str) -> Rules:
    return [(f"V2_{n}", finite(n) | (F.col(n) <= 0)) for n in names]


def quantity(*names: str) -> Rules:
    return [(f"V3_{n}", finite(n) | (F.col(n) < 0)) for n in names]


def money(*names: str) -> Rules:
    return [(f"V4_{n}", finite(n)) for n in names]


def one_of(name: str, values: tuple[str, ...]) -> Rules:
    return [(f"V42_{name}", ~F.col(name).isin(*values))]


def bar() -> Rules:
    low, high = F.col("low"), F.col("high")
    outside = lambda n: (F.col(n) < low) | (F.col(n) > high)
    return [
        *event(), *listing(), *present("interval", "open", "high", "low", "close", "volume"), *price("open", "high", "low", "close", "vwap"), *quantity("volume"),
        ("V7_high_below_low", high < low),
        ("V8_open", outside("open")), ("V9_close", outside("close")), ("V10_vwap", outside("vwap")),
        ("V11_trade_count", F.col("trade_count") < 0), *one_of("interval", tuple(schema.INTERVALS)),
    ]


def quote() -> Rules:
    """Locked and crossed quotes pass."""
    names = ("bid_price", "ask_price", "bid_size", "ask_size")
    return [*event(), *listing(), *present(*names), *price(*names[:2]), *quantity(*names[2:])]


def tick() -> Rules:
    return [*event(), *listing(), *present("price", "size"), *price("price"), *quantity("size"), ("V12_size", F.col("size") == 0), *one_of("aggressor", schema.SIDES)]


def order() -> Rules:
    """V13 to V15."""
    limit, stop = c.needs_limit_price(), c.needs_stop_price()
    return [
        *event(), *listing(), *present("id", "intent_id", "side", "quantity", "order_type", "time_in_force"), *quantity("quantity"), *price("limit_price", "stop_price"),
        ("V13_quantity", F.col("quantity") == 0),
        ("V14_limit_price", limit == F.col("limit_price").isNull()), ("V15_stop_price", stop == F.col("stop_price").isNull()),
        *one_of("side", schema.SIDES), *one_of("order_type", schema.ORDER_TYPES), *one_of("time_in_force", schema.TIMES_IN_FORCE),
    ]


def fill() -> Rules:
    """V16, V17."""
    return [
        *event(), *listing(), *present("id", "order_id", "side", "price", "quantity", "commission_amount", "commission_ccy"),
        *price("price", "reference_price"), *quantity("quantity"), *money("commission_amount"),
        ("V16_quantity", F.col("quantity") == 0), ("V17_currency", F.col("commission_ccy") != c.currency()),
        *one_of("side", schema.SIDES), *one_of("liquidity", schema.LIQUIDITY),
    ]


def intent() -> Rules:
    """V18 to V23. A market entry has no price yet, so its stop cannot be on the wrong side."""
    entry, stop = F.col("entry_price"), F.col("invalidation")
    return [
        *event(), *listing(), *present("side", "entry", "invalidation", "target_r", "horizon_ns", "strategy", "strategy_version", "rationale"), *price("entry_price", "invalidation"),
        ("V18_entry_price", (F.col("entry") == "MARKET") != entry.isNull()), ("V19_target_r", F.col("target_r") <= 0), ("V20_horizon", F.col("horizon_ns") <= 0),
        ("V21_rationale", ~F.col("rationale").rlike(r"(?U)\S")), ("V22_strategy", (F.col("strategy") == "") | (F.col("strategy_version") == "")),
        ("V23_stop_side", F.when(F.col("side") == "BUY", stop >= entry).when(F.col("side") == "SELL", stop <= entry)),
        *one_of("side", schema.SIDES), *one_of("entry", schema.TRIGGERS),
    ]


def position() -> Rules:
    """V24 to V26."""
    flat = F.col("quantity") == 0
    return [("V24_side", flat != F.col("side").isNull()), ("V25_average", flat != F.col("average_price").isNull()), ("V26_currency", F.col("currency") != c.currency())]


def identifier(name: str, prefix: str) -> Rules:
    """The prefix, and sixteen characters after it, whatever they are."""
    return [(f"V28_{name}", ~F.col(name).startswith(prefix + "_") | (F.length(name) != len(prefix) + 17))]


def window_order(partition: list[str]) -> Column:
    """In order of arrival the time falls; ties are fine."""
    from pyspark.sql import Window

    return F.lag("ts_event").over(Window.partitionBy(*partition).orderBy("arrival")) > F.col("ts_event")


def no_lookahead(as_of: Column | str) -> Column:
    """What is seen lies after the time of seeing; equal times are fine."""
    return F.col("ts_event") > (F.col(as_of) if isinstance(as_of, str) else as_of)


def violations(rules: Rules) -> Column:
    """Names of the broken rules, in the rules' order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def quarantine(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, the others with their `violations`)."""
    marked = df.withColumn("violations", violations(rules))
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def strict(df: DataFrame, rules: Rules) -> DataFrame:
    """df itself; running it fails at the first row that breaks a rule. The check is a filter, so no plan can prune it (D-12)."""
    broken = violations(rules)
    return df.filter(F.when(F.size(broken) > 0, F.raise_error(F.concat(F.lit("rejected: "), F.array_join(broken, ", "))).cast("boolean")).otherwise(True))
