"""The domain's tables out of the star-schema test tables, by fixed rules (survey 7.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c

HOUR = 3_600_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def venue_of(user: str) -> F.Column:
    return F.when(F.col(user) % 3 == 0, "NASDAQ").when(F.col(user) % 3 == 1, "NYSE").otherwise("TSX")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from events; values that aren't prices go."""
    e = table(spark, sf_dir, "events").filter("value > 0")
    ts = c.to_nanos("ts")
    return e.select(
        F.upper("event_type").alias("ticker"), venue_of("user_id").alias("venue"), ts.alias("ts_event"), (ts + (F.col("event_id") % 1000) * 1000).alias("ts_init"), F.col("event_id").alias("seq"),
        F.col("value").cast("decimal(18,8)").alias("price"), (1 + F.col("user_id") % 5).cast("decimal(28,8)").alias("size"), F.col("user_id").alias("user_id"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes around each trade: ordinary, locked and crossed ones, and some without size."""
    step = (F.lit(2).cast("decimal(18,8)") / 100 * ((F.col("seq") % 4) - 1)).cast("decimal(18,8)")
    q = ticks(spark, sf_dir).select(
        "ticker", "venue", "ts_event", "ts_init", "seq", F.col("price").alias("bid_price"), (F.col("price") + step).cast("decimal(18,8)").alias("ask_price"),
        (100 * (F.col("user_id") % 7)).cast("decimal(28,8)").alias("bid_size"), (100 * (F.col("seq") % 7)).cast("decimal(28,8)").alias("ask_size"),
    )
    return q.filter("ask_price > 0")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of each venue on each day that has trades: PRE 08:00, REGULAR 14:00, POST 20:00, CLOSED 23:00 UTC."""
    days = ticks(spark, sf_dir).select("venue", F.expr("ts_event div 86400000000000").alias("day")).distinct()
    phases = F.array(*[F.struct(F.lit(h).alias("hour"), F.lit(p).alias("session")) for h, p in ((8, "PRE"), (14, "REGULAR"), (20, "POST"), (23, "CLOSED"))])
    return days.select("venue", "day", F.explode(phases).alias("p")).select("venue", (F.col("day") * 24 * HOUR + F.col("p.hour") * HOUR).alias("ts_event"), F.col("p.hour").alias("seq"), F.col("p.session").alias("session"))


def halts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(halts, resumes): each symbol is halted from 15:00 to 17:00 UTC on the days whose number divides by three."""
    days = ticks(spark, sf_dir).select("ticker", "venue", F.expr("ts_event div 86400000000000").alias("day")).distinct().filter("day % 3 = 0")
    at = lambda h: (F.col("day") * 24 * HOUR + h * HOUR).alias("ts_event")
    return days.select("ticker", "venue", at(15), F.lit("UNKNOWN").alias("reason")), days.select("ticker", "venue", at(17), F.lit(None).cast("decimal(18,8)").alias("auction_price"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions from line items: a supplier is a symbol, an order's key is its order. seq is a rank of the rows' unique key."""
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_quantity").cast("long"))
    joined = item.join(part, item.l_partkey == part.p_partkey)
    cents = lambda x: (F.floor(x * 100).cast("decimal(18,0)") / 100).cast("decimal(18,8)")  # noqa: E731  the same cents in any engine
    return joined.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), F.when(F.col("l_suppkey") % 3 == 0, "TSX").otherwise("NYSE").alias("venue"), c.to_nanos("l_shipdate").alias("ts_event"),
        key.alias("seq"), F.col("l_orderkey").alias("order_key"), F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").cast("decimal(28,8)").alias("quantity"),
        cents(F.col("l_extendedprice") * F.col("l_tax") / 100).cast("decimal(38,8)").alias("commission_amount"), F.when(F.col("l_suppkey") % 3 == 0, "CAD").otherwise("USD").alias("commission_ccy"),
        F.when(F.col("l_linenumber") % 2 == 0, "MAKER").when(F.col("l_linenumber") % 5 == 0, "UNKNOWN").otherwise("TAKER").alias("liquidity"),
        F.when(F.col("l_partkey") % 4 != 0, cents(F.col("p_retailprice"))).alias("reference_price"), key.alias("broker_exec_id"),
    )


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals from orders: the side by parity, the trigger by priority, the stop five per cent away."""
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 0")
    price = (F.floor(F.col("o_totalprice") / 10).cast("decimal(18,0)") / 100).cast("decimal(18,8)")  # the same cents in any engine
    side = F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL")
    entry = F.when(F.col("o_orderpriority").startswith("1"), "MARKET").when(F.col("o_orderpriority").startswith("2"), "STOP").otherwise("LIMIT")
    stop = (price * F.when(side == "BUY", 95).otherwise(105) / 100).cast("decimal(18,8)")
    return o.filter(price > 0).select(
        F.concat(F.lit("C"), F.col("o_custkey") % 50).alias("ticker"), F.lit("NYSE").alias("venue"), c.to_nanos("o_orderdate").alias("ts_event"), F.col("o_orderkey").alias("seq"), side.alias("side"), entry.alias("entry"),
        F.when(entry != "MARKET", price).alias("entry_price"), price.alias("mark"), stop.alias("invalidation"), F.lit(2).cast("decimal(18,8)").alias("target_r"), F.lit(24 * HOUR).alias("horizon_ns"),
        F.lit("orb").alias("strategy"), F.lit("1.0.0").alias("strategy_version"), F.lit("breakout").alias("rationale"),
    )
