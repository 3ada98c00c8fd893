"""The queries on the analytics domain and the SQL they are checked against.

Each runs over whole tables. Outputs are of plain types on both sides: prices and sums of money as rounded doubles, times as long."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import ids, rules
from ..operators import asof, features, positions, replay, valuation
from ..operators import bars as rollup
from ..operators.registry import FeatureRef, FeatureRegistry, Strategy, StrategyRegistry
from ..sources import adapters, corpus, schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: 2024-01-10 and 2024-01-20, 00:00 UTC.
START, END = 1_704_844_800_000_000_000, 1_705_708_800_000_000_000
DAY = 86_400_000_000_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def dbl(name: str, digits: int = 6):
    return F.round(F.col(name).cast("double"), digits).alias(name)


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Decimals as rounded doubles."""
    return df.select(*[dbl(f.name, digits) if isinstance(f.dataType, schema.T.DecimalType) else F.col(f.name) for f in df.schema.fields])


VENUE = "CASE user_id % 3 WHEN 0 THEN 'NASDAQ' WHEN 1 THEN 'NYSE' ELSE 'TSX' END"
TICKS = f"""ticks AS (SELECT upper(event_type) AS ticker, {VENUE} AS venue, epoch_us(ts) * 1000 AS ts_event, epoch_us(ts) * 1000 + (event_id % 1000) * 1000 AS ts_init,
  event_id AS seq, value AS price, 1 + user_id % 5 AS size, user_id FROM events WHERE value > 0)"""


def bars_sql(ns: int) -> str:
    return f"""bars AS (SELECT ticker, venue, (ts_event // {ns}) * {ns} + {ns} AS ts_event, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
  sum(size) AS volume, count(*) AS trade_count, max(ts_init) AS ts_init, max(seq) AS seq FROM ticks GROUP BY 1, 2, 3)"""


HOUR_BARS = f"WITH {TICKS}, {bars_sql(schema.INTERVALS['1h'])}"
DAY_BARS = f"WITH {TICKS}, {bars_sql(schema.INTERVALS['1d'])}"
BAR_COLUMNS = "ticker, venue, CAST(ts_event AS BIGINT) AS ts_event, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CAST(volume AS DOUBLE) AS volume, CAST(trade_count AS BIGINT) AS trade_count"
BAR_NAMES = ["ticker", "venue", "ts_event", "open", "high", "low", "close", "volume", "trade_count"]


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.from_ticks(adapters.ticks(spark, sf_dir), "1h")


@query(f"{HOUR_BARS} SELECT {BAR_COLUMNS} FROM bars")
def bar_rollup_1h(spark, sf_dir):
    return plain(hour_bars(spark, sf_dir).select(*BAR_NAMES))


@query(f"{DAY_BARS} SELECT {BAR_COLUMNS} FROM bars")
def bar_rollup_1d(spark, sf_dir):
    """From hours to days, so that bars are rolled up as well as ticks."""
    return plain(rollup.roll_up(hour_bars(spark, sf_dir), "1d").select(*BAR_NAMES))


@query(f"""{HOUR_BARS} SELECT ticker, venue, CAST(ts_event AS BIGINT) AS ts_event, CAST(ts_init - ts_event AS BIGINT) AS latency_ns, CAST(ts_event - 3600000000000 AS BIGINT) AS ts_open,
  round(high - low, 6) AS bar_range, close > open AS is_up FROM bars""")
def bar_projection(spark, sf_dir):
    b = hour_bars(spark, sf_dir)
    return plain(b.select("ticker", "venue", "ts_event", c.latency_ns().alias("latency_ns"), c.ts_open().alias("ts_open"), c.bar_range().alias("bar_range"), c.is_up().alias("is_up")))


BROKEN = """broken AS (SELECT ticker, venue, seq, ts_event,
  CASE WHEN seq % 11 = 0 THEN lower(ticker) WHEN seq % 13 = 0 THEN ticker || ' ' ELSE ticker END AS t,
  CASE WHEN seq % 17 = 0 THEN 'SMART' ELSE venue END AS v, CASE WHEN seq % 19 = 0 THEN -1 ELSE seq END AS s,
  CASE WHEN seq % 7 = 0 THEN low - 1 ELSE high END AS h, low AS l, CASE WHEN seq % 5 = 0 THEN high + 1 ELSE open END AS o, close AS c,
  CASE WHEN seq % 3 = 0 THEN low - 1 END AS w, CASE WHEN seq % 23 = 0 THEN -1 ELSE trade_count END AS n FROM bars)"""
RULE_SQL = {
    "V1_seq": "s < 0", "V5_ticker_space": "t <> trim(t)", "V5_ticker_case": "upper(t) <> t", "V6_venue_is_route": "v = 'SMART'", "V2_high": "h <= 0", "V2_low": "l <= 0", "V2_open": "o <= 0", "V2_close": "c <= 0", "V2_vwap": "w <= 0",
    "V7_high_below_low": "h < l", "V8_open": "o < l OR o > h", "V9_close": "c < l OR c > h", "V10_vwap": "w < l OR w > h", "V11_trade_count": "n < 0",
}


@query(f"{HOUR_BARS}, {BROKEN} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n FROM broken WHERE {v} HAVING count(*) > 0" for k, v in RULE_SQL.items()))
def bar_validation(spark, sf_dir):
    """Bars broken on purpose, counted by the rule they break."""
    b = hour_bars(spark, sf_dir).withColumn("vwap", F.lit(None).cast("decimal(18,8)"))
    every = lambda n, bad, good: F.when(F.col("seq") % n == 0, bad).otherwise(good)
    one = F.lit(1).cast("decimal(18,8)")
    broken = b.select(
        F.when(F.col("seq") % 11 == 0, F.lower("ticker")).when(F.col("seq") % 13 == 0, F.concat("ticker", F.lit(" "))).otherwise(F.col("ticker")).alias("ticker"), every(17, F.lit("SMART"), F.col("venue")).alias("venue"),
        "ts_event", "ts_init", every(19, F.lit(-1), F.col("seq")).alias("seq"), "interval", every(5, F.col("high") + one, F.col("open")).alias("open"), every(7, F.col("low") - one, F.col("high")).alias("high"), "low", "close", "volume",
        F.when(F.col("seq") % 3 == 0, F.col("low") - one).alias("vwap"), every(23, F.lit(-1), F.col("trade_count")).alias("trade_count"),
    )
    return broken.select(F.explode(rules.violations(rules.bar())).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


QUOTES = """quotes AS (SELECT ticker, venue, ts_event, seq, price AS bid, price + 0.02 * ((seq % 4) - 1) AS ask, 100 * (user_id % 7) AS bs, 100 * (seq % 7) AS az FROM ticks)"""


@query(f"""WITH {TICKS}, {QUOTES} SELECT CAST(seq AS BIGINT) AS seq, round(ask - bid, 5) AS spread, round((bid + ask) / 2, 5) AS mid,
  round(CASE WHEN bs + az = 0 THEN (bid + ask) / 2 ELSE (bid * az + ask * bs) / (bs + az) END, 4) AS microprice, seq % 4 = 1 AS is_locked, seq % 4 = 0 AS is_crossed FROM quotes WHERE round(ask, 8) > 0""")
def quote_projection(spark, sf_dir):
    q = adapters.quotes(spark, sf_dir)
    out = q.select(F.col("seq").cast("long").alias("seq"), c.spread().alias("spread"), c.mid().alias("mid"), c.microprice().alias("microprice"), c.is_locked().alias("is_locked"), c.is_crossed().alias("is_crossed"))
    return out.select("seq", dbl("spread", 5), dbl("mid", 5), dbl("microprice", 4), "is_locked", "is_crossed")


@query(f"WITH {TICKS} SELECT CAST(seq AS BIGINT) AS seq, round(price * size, 4) AS notional FROM ticks")
def tick_notional(spark, sf_dir):
    good, _ = rules.quarantine(adapters.ticks(spark, sf_dir).withColumn("aggressor", F.lit(None).cast("string")), rules.tick())
    return good.select(F.col("seq").cast("long").alias("seq"), F.round(c.product("price", "size").cast("double"), 4).alias("notional"))


@query(f"WITH {TICKS} SELECT DISTINCT ticker || '.' || venue AS symbol, CASE WHEN venue IN ('TSX', 'TSXV') THEN 'CAD' ELSE 'USD' END AS currency FROM ticks")
def symbol_currency(spark, sf_dir):
    return adapters.ticks(spark, sf_dir).select(c.symbol().alias("symbol"), c.currency().alias("currency")).distinct()


@query(f"{HOUR_BARS} SELECT {BAR_COLUMNS} FROM bars WHERE ticker = 'CLICK' AND venue = 'NYSE' AND ts_event >= {START} AND ts_event < {END}")
def range_scan(spark, sf_dir):
    b = hour_bars(spark, sf_dir).filter("ticker = 'CLICK' and venue = 'NYSE'")
    return plain(corpus.within(b, START, END).orderBy("ts_event", "seq").select(*BAR_NAMES))


SESSIONS = f"""sessions AS (SELECT venue, d * {DAY} + h * 3600000000000 AS ts_event, h AS seq, p AS session FROM (SELECT DISTINCT venue, ts_event // {DAY} AS d FROM ticks), (VALUES (8, 'PRE'), (14, 'REGULAR'), (20, 'POST'), (23, 'CLOSED')) v(h, p))"""


@query(f"""WITH {TICKS}, {SESSIONS}, al AS (SELECT 'tick' AS kind, ts_event, seq, ticker, venue FROM ticks UNION ALL SELECT 'session', ts_event, seq, NULL, venue FROM sessions)
  SELECT kind, CAST(ts_event AS BIGINT) AS ts_event, CAST(seq AS BIGINT) AS seq, ticker, venue, CAST(row_number() OVER (ORDER BY ts_event, seq, kind, ticker NULLS FIRST, venue) AS BIGINT) AS n
  FROM al WHERE ts_event >= {START} AND ts_event < {END}""")
def replay_stream(spark, sf_dir):
    """Ticks and session boundaries in one total order. The row number counts in the sorted partitions, without gathering them in one."""
    rows = replay.replay({"tick": adapters.ticks(spark, sf_dir).select("ts_event", F.col("seq").cast("long").alias("seq"), "ticker", "venue"), "session": adapters.sessions(spark, sf_dir).select("ts_event", F.col("seq").cast("long").alias("seq"), "venue")}, START, END)
    day = F.expr(f"ts_event div {DAY}L")
    per_day = rows.groupBy(day.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    before = per_day.select("_d", F.coalesce(F.sum("_n").over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = Window.partitionBy("_d").orderBy(*replay.ORDER)
    return rows.withColumn("_d", day).join(before, "_d").select("kind", "ts_event", "seq", "ticker", "venue", (F.col("_b") + F.row_number().over(within)).alias("n"))


def feature_query(name: str, version: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = features.compute(hour_bars(spark, sf_dir), [features.features.get(name, version)])
        return out.select("ticker", "venue", "ts_event", F.round(name, 6).alias("value"))

    run.__name__ = "feature_" + {"bar_range": "range"}.get(name, name)
    query(f"{HOUR_BARS} SELECT ticker, venue, CAST(ts_event AS BIGINT) AS ts_event, round(CAST({sql} AS DOUBLE), 6) AS value FROM bars")(run)


W3 = "OVER (PARTITION BY venue, ticker ORDER BY ts_event, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
feature_query("last_close", "1.0.0", "close")
feature_query("bar_range", "1.0.0", "high - low")
feature_query("mean_close", "1.0.0", f"CASE WHEN count(*) {W3} = 3 THEN avg(close) {W3} END")


@query(f"""{HOUR_BARS}, f AS (SELECT ticker, venue, ts_event, CASE WHEN count(*) {W3} = 3 THEN avg(close) {W3} END AS mean_close FROM bars)
  SELECT CAST(t.seq AS BIGINT) AS seq, round(f.mean_close, 6) AS mean_close FROM ticks t ASOF LEFT JOIN f ON t.ticker = f.ticker AND t.venue = f.venue AND t.ts_event >= f.ts_event""")
def feature_asof(spark, sf_dir):
    """The feature as it was known at each trade; a bar is known from its close on."""
    f = features.compute(hour_bars(spark, sf_dir), [features.features.get("mean_close", "1.0.0")]).select("ticker", "venue", "ts_event", "seq", "mean_close")
    t = adapters.ticks(spark, sf_dir).select("ticker", "venue", "ts_event", F.col("seq").cast("long").alias("tick"))
    return asof.asof(t, f, ["ticker", "venue"], ["mean_close"], order=["seq"]).select(F.col("tick").alias("seq"), F.round("mean_close", 6).alias("mean_close"))


@query(f"""WITH {TICKS}, {SESSIONS} SELECT CAST(t.seq AS BIGINT) AS seq, s.session, s.session <> 'CLOSED' AS is_tradable, s.session = 'REGULAR' AS is_regular
  FROM ticks t ASOF LEFT JOIN sessions s ON t.venue = s.venue AND t.ts_event >= s.ts_event""")
def session_phase(spark, sf_dir):
    t = adapters.ticks(spark, sf_dir).select("venue", "ts_event", F.col("seq").cast("long").alias("tick"))
    out = asof.asof(t, adapters.sessions(spark, sf_dir), ["venue"], ["session"], order=["seq"])
    return out.select(F.col("tick").alias("seq"), "session", c.is_tradable().alias("is_tradable"), c.opens_regular_trading().alias("is_regular"))


@query(f"""{HOUR_BARS} SELECT ticker, venue, CAST(ts_event AS BIGINT) AS ts_event FROM bars b WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT ticker, venue, ts_event // {DAY} AS d FROM ticks) h
  WHERE h.d % 3 = 0 AND h.ticker = b.ticker AND h.venue = b.venue AND b.ts_event >= h.d * {DAY} + 15 * 3600000000000 AND b.ts_event < h.d * {DAY} + 17 * 3600000000000)""")
def halt_gap_bars(spark, sf_dir):
    """Bars outside all halts."""
    gaps = asof.halt_gaps(*adapters.halts(spark, sf_dir))
    return asof.in_gap(hour_bars(spark, sf_dir), gaps, "left_anti").select("ticker", "venue", "ts_event")


KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(l_quantity AS BIGINT))"
FILLS = f"""fills AS (SELECT 'S' || l_suppkey AS ticker, CASE WHEN l_suppkey % 3 = 0 THEN 'TSX' ELSE 'NYSE' END AS venue, epoch_us(l_shipdate) * 1000 AS ts_event, {KEY} AS seq, l_orderkey AS order_key,
  CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 1 ELSE -1 END AS sgn, floor(l_extendedprice / l_quantity * 100) / 100 AS price, l_quantity AS quantity,
  floor(l_extendedprice * l_tax / 100 * 100) / 100 AS commission, CASE WHEN l_linenumber % 2 = 0 THEN 'MAKER' WHEN l_linenumber % 5 = 0 THEN 'UNKNOWN' ELSE 'TAKER' END AS liquidity,
  CASE WHEN l_partkey % 4 <> 0 THEN floor(p_retailprice * 100) / 100 END AS reference_price FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(f"""WITH {FILLS} SELECT seq, round(price * quantity, 3) AS notional, round((price - reference_price) * sgn, 3) AS slippage_per_share, round((price - reference_price) * sgn * quantity, 3) AS slippage_cost,
  round(commission + (price - reference_price) * sgn * quantity, 3) AS total_cost FROM fills""")
def fill_costs(spark, sf_dir):
    f = adapters.fills(spark, sf_dir)
    out = f.select("seq", c.product("price", "quantity").alias("notional"), c.slippage_per_share().alias("slippage_per_share"), c.slippage_cost().alias("slippage_cost"), c.total_cost().alias("total_cost"))
    return plain(out, 3)


@query(f"WITH {FILLS} SELECT liquidity, count(*) AS fill_count, round(sum(commission), 2) AS fees, count(reference_price) AS measured, round(avg((price - reference_price) * sgn), 4) AS mean_slippage FROM fills GROUP BY 1")
def cost_summary(spark, sf_dir):
    out = positions.summary(adapters.fills(spark, sf_dir))
    return out.select("liquidity", "fill_count", dbl("fees", 2), "measured", dbl("mean_slippage", 4))


MATRIX = """WITH k AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'MARKET' WHEN 1 THEN 'LIMIT' WHEN 2 THEN 'STOP' ELSE 'STOP_LIMIT' END AS t, CASE o_custkey % 4 WHEN 0 THEN 'DAY' WHEN 1 THEN 'GTC' WHEN 2 THEN 'IOC' ELSE 'FOK' END AS f,
  o_orderkey % 5 <> 0 AS haslimit, o_orderkey % 3 <> 0 AS hasstop FROM orders)"""


@query(f"""{MATRIX} SELECT CAST(id AS BIGINT) AS id, t = 'MARKET' OR f IN ('IOC', 'FOK') AS is_marketable, t IN ('LIMIT', 'STOP_LIMIT') AS needs_limit_price, t IN ('STOP', 'STOP_LIMIT') AS needs_stop_price,
  (t IN ('LIMIT', 'STOP_LIMIT')) <> haslimit AS bad_limit, (t IN ('STOP', 'STOP_LIMIT')) <> hasstop AS bad_stop FROM k""")
def order_price_matrix(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    pick = lambda col, values: F.element_at(F.array(*map(F.lit, values)), (F.col(col) % 4 + 1).cast("int"))
    price = F.lit(10).cast("decimal(18,8)")
    k = o.select(F.col("o_orderkey").alias("id"), pick("o_orderkey", schema.ORDER_TYPES).alias("order_type"), pick("o_custkey", schema.TIMES_IN_FORCE).alias("time_in_force"), F.when(F.col("o_orderkey") % 5 != 0, price).alias("limit_price"), F.when(F.col("o_orderkey") % 3 != 0, price).alias("stop_price"))
    by = dict(rules.order())
    return k.select("id", c.is_marketable().alias("is_marketable"), c.needs_limit_price().alias("needs_limit_price"), c.needs_stop_price().alias("needs_stop_price"), by["V14_limit_price"].alias("bad_limit"), by["V15_stop_price"].alias("bad_stop"))


INTENTS = """intents AS (SELECT o_orderkey AS seq, 'C' || (o_custkey % 50) AS ticker, epoch_us(o_orderdate) * 1000 AS ts_event, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS sgn, CASE left(o_orderpriority, 1) WHEN '1' THEN 'MARKET' WHEN '2' THEN 'STOP' ELSE 'LIMIT' END AS entry,
  CAST(floor(o_totalprice / 10) AS DECIMAL(18,0)) * 0.01 AS mark, CAST(floor(o_totalprice / 10) AS DECIMAL(18,0)) * 0.01 * CASE WHEN o_orderkey % 2 = 0 THEN 0.95 ELSE 1.05 END AS invalidation FROM orders WHERE o_totalprice >= 10)"""


@query(f"""WITH {INTENTS} SELECT CAST(seq AS BIGINT) AS seq, round(CAST(abs(mark - invalidation) AS DOUBLE), 4) AS risk, round(CAST(mark + abs(mark - invalidation) * 2 * sgn AS DOUBLE), 4) AS target, CAST(ts_event + 86400000000000 AS BIGINT) AS expires_at, entry <> 'MARKET' AS has_price FROM intents""")
def intent_barriers(spark, sf_dir):
    i = rules.strict(adapters.intents(spark, sf_dir).withColumn("ts_init", F.col("ts_event")), rules.intent())
    out = i.select("seq", c.risk_per_share("mark").alias("risk"), c.target_price("mark").alias("target"), c.expires_at().alias("expires_at"), F.col("entry_price").isNotNull().alias("has_price"))
    return plain(out, 4)


@query(f"""WITH {FILLS}, o AS (SELECT o_orderkey, o_orderkey % 1000 AS i FROM orders) SELECT strategy, count(*) AS fills, round(sum(price * quantity), 2) AS notional FROM (
  SELECT 's' || (o.i % 7) AS strategy, f.price, f.quantity FROM fills f JOIN o ON f.order_key = o.o_orderkey) GROUP BY 1""")
def lineage(spark, sf_dir):
    """Fills by the strategy behind them."""
    o = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 1000).alias("intent_id"), F.lit("LIMIT").alias("order_type"), c.to_nanos("o_orderdate").alias("ts_event"))
    i = o.select(F.col("intent_id").alias("id")).distinct().select("id", F.concat(F.lit("s"), F.col("id") % 7).alias("strategy"), F.lit("1.0.0").alias("strategy_version"), F.lit(0).cast("long").alias("ts_event"))
    f = adapters.fills(spark, sf_dir).withColumnRenamed("order_key", "order_id")
    out = asof.lineage(f, o, i).groupBy("strategy").agg(F.count(F.lit(1)).alias("fills"), F.sum(c.product("price", "quantity")).alias("notional"))
    return plain(out, 2)


RUN = "OVER (PARTITION BY ticker ORDER BY ts_event, seq ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {FILLS} SELECT seq, CAST(sum(quantity * sgn) {RUN} AS DOUBLE) AS signed_quantity, round(sum(commission) {RUN}, 2) AS fees, CAST(count(*) {RUN} AS BIGINT) AS fill_count FROM fills")
def position_running_qty(spark, sf_dir):
    """Quantity, fees and count need no fold."""
    w = Window.partitionBy("ticker", "venue").orderBy("ts_event", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = adapters.fills(spark, sf_dir)
    return f.select("seq", F.sum(F.col("quantity") * c.sign()).over(w).cast("double").alias("signed_quantity"), F.round(F.sum("commission_amount").over(w).cast("double"), 2).alias("fees"), F.count(F.lit(1)).over(w).alias("fill_count"))


FOLD = f"""WITH RECURSIVE {FILLS}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts_event, seq) AS k FROM fills),
 fold AS (SELECT ticker, venue, k, seq, CAST(sgn * quantity AS DOUBLE) AS q, CAST(price AS DOUBLE) AS a, CAST(0 AS DECIMAL(38,12)) AS r, CAST(commission AS DOUBLE) AS fees FROM n WHERE k = 1
  UNION ALL SELECT n.ticker, n.venue, n.k, n.seq, f.q + n.sgn * n.quantity,
   CASE WHEN f.q + n.sgn * n.quantity = 0 THEN 0 WHEN f.q = 0 OR sign(f.q) <> sign(f.q + n.sgn * n.quantity) THEN n.price WHEN sign(f.q) = n.sgn THEN (f.a * abs(f.q) + n.price * n.quantity) / (abs(f.q) + n.quantity) ELSE f.a END,
   f.r + CASE WHEN f.q <> 0 AND sign(f.q) <> n.sgn THEN CAST((n.price - f.a) * sign(f.q) * least(abs(f.q), n.quantity) AS DECIMAL(38,12)) ELSE CAST(0 AS DECIMAL(38,12)) END, f.fees + n.commission FROM fold f JOIN n ON n.ticker = f.ticker AND n.k = f.k + 1)"""
#: Added before rounding, as many of these sums end in a five.
TIE = 3.3e-7
FOLD_COLUMNS = f"CASE WHEN q > 0 THEN 'BUY' WHEN q < 0 THEN 'SELL' END AS side, abs(q) AS quantity, CASE WHEN q <> 0 THEN round(a * abs(q) + {TIE}, 3) END AS cost, round(CAST(r AS DOUBLE) + {TIE}, 3) AS realised_pnl, round(fees, 2) AS fees, CAST(k AS BIGINT) AS fill_count"


def _rounded(df: DataFrame, *first: str) -> DataFrame:
    """cost is the average price times the quantity."""
    cost = F.col("average_price").cast("decimal(22,12)") * F.col("quantity").cast("decimal(15,2)")
    df = df.withColumns({"cost": cost.cast("double") + TIE, "realised_pnl": F.col("realised_pnl").cast("double") + TIE})
    return df.select(*first, "side", dbl("quantity", 2), dbl("cost", 3), dbl("realised_pnl", 3), dbl("fees", 2), "fill_count")


@query(f"{FOLD} SELECT ticker, venue, {FOLD_COLUMNS} FROM fold WHERE (ticker, k) IN (SELECT ticker, max(k) FROM n GROUP BY 1)")
def position_final(spark, sf_dir):
    return _rounded(positions.final(adapters.fills(spark, sf_dir)), "ticker", "venue")


@query(f"{FOLD} SELECT seq, {FOLD_COLUMNS} FROM fold")
def position_running(spark, sf_dir):
    return _rounded(positions.running(adapters.fills(spark, sf_dir)), "seq")


VALUED = f"""{FOLD}, p AS (SELECT * FROM fold WHERE (ticker, k) IN (SELECT ticker, max(k) FROM n GROUP BY 1)), m AS (SELECT ticker, arg_max(price, k) AS mark FROM n GROUP BY 1),
 v AS (SELECT p.ticker, CASE WHEN venue = 'TSX' THEN 'CAD' ELSE 'USD' END AS currency, mark, (mark - a) * q AS unrealised, mark * q AS market_value, CAST(r AS DOUBLE) - fees AS net, CAST(r AS DOUBLE) - fees + (mark - a) * q AS total FROM p JOIN m USING (ticker))"""


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = adapters.fills(spark, sf_dir)
    return valuation.value(positions.final(f), valuation.latest_marks(f))


@query(f"{VALUED} SELECT ticker, currency, round(mark, 2) AS mark, round(unrealised, 2) AS unrealised_pnl, round(market_value, 2) AS market_value, round(net, 2) AS net_realised_pnl, round(total, 2) AS total_pnl FROM v")
def position_valued(spark, sf_dir):
    return plain(_valued(spark, sf_dir).select("ticker", "currency", "mark", "unrealised_pnl", "market_value", "net_realised_pnl", "total_pnl"), 2)


@query(f"{VALUED} SELECT currency, round(sum(market_value), 2) AS net, round(sum(abs(market_value)), 2) AS gross, count(*) AS positions FROM v GROUP BY 1")
def portfolio_exposure(spark, sf_dir):
    return plain(valuation.exposure(_valued(spark, sf_dir)), 2)


@query(f"WITH {FILLS} SELECT count(*) AS fills, round(sum(quantity), 2) AS quantity FROM (SELECT seq, min(quantity) AS quantity FROM fills GROUP BY 1)")
def fill_dedup(spark, sf_dir):
    """All fills arrive twice, once later; each counts once."""
    f = adapters.fills(spark, sf_dir).withColumn("ts_init", F.col("ts_event"))
    twice = f.unionByName(f.withColumn("ts_init", F.col("ts_init") + 5))
    return plain(positions.dedup_fills(twice, "broker_exec_id").agg(F.count(F.lit(1)).alias("fills"), F.sum("quantity").alias("quantity")), 2)


@query(f"{HOUR_BARS} SELECT ticker, venue, CAST(ts_event AS BIGINT) AS ts_event, CASE WHEN seq % 3 = 0 THEN 'ibkr' ELSE 'yfinance' END AS source FROM bars")
def bar_dedup_append(spark, sf_dir):
    """All bars come from one vendor, a third of them from a better one too; what the corpus has is left alone."""
    b = hour_bars(spark, sf_dir)
    rows = corpus.bar_rows(b, "yfinance", 1).unionByName(corpus.bar_rows(b.filter("seq % 3 = 0"), "ibkr", 2))
    old = corpus.first_written(rows).filter("seq % 2 = 0")
    new = corpus.first_written(rows).join(old.select(*corpus.KEY), list(corpus.KEY), "left_anti")
    return old.unionByName(new).select("ticker", "venue", "ts_event", "source")


def _breakout(df: DataFrame) -> DataFrame:
    return df.filter("last_close > mean_close").select("ticker", "venue", "ts_event", F.lit("BUY").alias("side"), F.col("last_close").alias("entry_price"))


BREAKOUT = Strategy("breakout", "1.0.0", _breakout, regimes=("TREND_UP",), features=(FeatureRef("last_close"), FeatureRef("mean_close", "1.0.0")))


@query(f"""{HOUR_BARS}, f AS (SELECT *, CASE WHEN count(*) {W3} = 3 THEN avg(close) {W3} END AS m, sum(CAST(close AS DECIMAL(18,8))) {W3} AS s3 FROM bars)
  SELECT ticker, venue, CAST(ts_event AS BIGINT) AS ts_event, 'BUY' AS side, round(close, 6) AS entry_price, 'breakout' AS strategy, '1.0.0' AS strategy_version FROM f WHERE m IS NOT NULL AND 3 * CAST(close AS DECIMAL(18,8)) > s3 AND (ts_event // 3600000000000) % 2 = 0""")
def strategy_intents(spark, sf_dir):
    table = features.compute(hour_bars(spark, sf_dir), [features.features.get("last_close"), features.features.get("mean_close", "1.0.0")])
    table = table.withColumn("regime", F.when(F.expr("(ts_event div 3600000000000) % 2 = 0"), "TREND_UP").otherwise("UNKNOWN"))
    return features.decide(BREAKOUT, table).withColumn("entry_price", F.round("entry_price", 6))


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, CAST((ns - (((ns % 1000) + 1000) % 1000)) // 1000 AS BIGINT) AS micros FROM (SELECT event_id, (epoch_us(ts) * 1000 + event_id % 1000) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS ns FROM events)""")
def clock_convert(spark, sf_dir):
    """To microseconds, times before 1970 rounding down as well."""
    e = adapters.table(spark, sf_dir, "events")
    ns = (c.to_nanos("ts") + F.col("event_id") % 1000) * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    return e.select("event_id", ns.alias("ns")).select("event_id", c.to_micros("ns").alias("micros"))


def _registry() -> FeatureRegistry:
    r = FeatureRegistry()
    for name, version, lookback, interval in (("atr", "1.9.0", 20, "1m"), ("atr", "1.10.0", 200, "1m"), ("rvol", "1.0.0", 14, "1m"), ("gap", "2.0.0", 200, "1d")):
        r.feature(name, version, lookback=lookback, interval=interval, description="an example")(lambda w: F.last("close").over(w))
    r.freeze()
    return r


@query("SELECT * FROM (VALUES ('atr', '1.10.0'), ('gap', '2.0.0'), ('rvol', '1.0.0')) t(name, latest)")
def registry_latest(spark, sf_dir):
    """As data: the largest version of each name, compared number by number."""
    top = _registry().frame(spark).groupBy("name").agg(F.max(F.struct("major", "minor", "patch")).alias("v"))
    return top.select("name", F.concat_ws(".", "v.major", "v.minor", "v.patch").alias("latest"))


@query("SELECT * FROM (VALUES (0, 'atr@1.9.0'), (1, 'atr@1.10.0'), (2, 'gap@2.0.0'), (3, 'rvol@1.0.0')) t(position, qualified_name)")
def registry_snapshot(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(_registry().snapshot())), "position int, qualified_name string")


@query("SELECT * FROM (VALUES ('atr'), ('atr@1.0.0'), ('rvol')) t(feature)")
def required_features(spark, sf_dir):
    r = StrategyRegistry()
    r.strategy(Strategy("a", "1.0.0", features=(FeatureRef("atr"), FeatureRef("rvol"))))
    r.strategy(Strategy("b", "1.0.0", features=(FeatureRef("atr", "1.0.0"), FeatureRef("atr"))))
    return spark.createDataFrame([(str(f),) for f in r.required_features()], "feature string")


@query("SELECT * FROM (VALUES ('1m', 200), ('1d', 200), ('5m', 0)) t(bar_interval, max_lookback)")
def max_lookback(spark, sf_dir):
    r = _registry()
    return spark.createDataFrame([(i, r.max_lookback(i)) for i in ("1m", "1d", "5m")], "bar_interval string, max_lookback int")


@query()
def derived_ids(spark, sf_dir):
    """SQL engines lack BLAKE2b; tests hold the ids against golden values."""
    i = adapters.intents(spark, sf_dir)
    intent = ids.intent_id(F.col("strategy"), F.col("strategy_version"), c.symbol(), F.col("ts_event"), F.col("seq"))
    made = i.select("seq", "ts_event", intent.alias("intent_id"))
    return made.select("seq", "intent_id", ids.order_id(F.col("intent_id"), F.col("ts_event")).alias("order_id"))


BARRIER = f"""{DAY_BARS}, i AS (SELECT seq, ticker, venue, price, ts_event, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS sgn FROM ticks),
 h AS (SELECT i.seq, i.sgn, b.ts_event, b.high, b.low, i.price FROM i JOIN bars b ON b.ticker = i.ticker AND b.venue = i.venue AND b.ts_event > i.ts_event AND b.ts_event <= i.ts_event + {3 * DAY}),
 e AS (SELECT seq, ts_event, CASE WHEN sgn = 1 THEN low <= price * 0.9 ELSE high >= price * 1.1 END AS st, CASE WHEN sgn = 1 THEN high >= price * 1.2 ELSE low <= price * 0.8 END AS tg FROM h),
 x AS (SELECT seq, arg_min(CASE WHEN st THEN 'stop' ELSE 'target' END, ts_event) AS barrier FROM e WHERE st OR tg GROUP BY 1)
 SELECT CAST(i.seq AS BIGINT) AS seq, coalesce(barrier, 'time') AS barrier FROM i LEFT JOIN x USING (seq)"""


@query(BARRIER)
def triple_barrier(spark, sf_dir):
    """Which barrier each trade would have met, as a proposal with a stop at a tenth, twice that as target, and three days."""
    t = adapters.ticks(spark, sf_dir)
    side = F.when(F.col("seq") % 2 == 0, "BUY").otherwise("SELL")
    of = lambda up: (F.col("price") * F.when(F.col("side") == "BUY", up).otherwise(200 - up) / 100).cast("decimal(18,8)")
    i = t.select(F.col("seq").cast("long").alias("seq"), "ticker", "venue", "ts_event", "price", side.alias("side"), F.lit(3 * DAY).alias("horizon_ns")).withColumn("invalidation", of(90))
    return asof.triple_barrier(i, rollup.from_ticks(adapters.ticks(spark, sf_dir), "1d"), of(120), "seq").select("seq", "barrier")
