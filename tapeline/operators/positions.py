"""Positions as an ordered fold of fills at average cost. Survey ids: A1 to A4, P28, V24 to V27, T4.

The fold is exact decimal arithmetic in order of (ts_event, seq). A position that returns to flat forgets its average, so a symbol's fills are cut
where the running quantity is zero: the pieces are folded in parallel, and what was realised before a piece is added
afterwards. Each piece streams through the fold row by row, so no symbol has to fit in memory."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYMBOL = ["ticker", "venue"]
_SCALE = Decimal("1e-12")
ZERO = Decimal(0)


@dataclass
class State:
    """What is held: side and average are None when flat. realised is gross of fees."""

    side: str | None = None
    quantity: Decimal = ZERO
    average: Decimal | None = None
    realised: Decimal = ZERO
    fees: Decimal = ZERO
    fills: int = 0

    def apply(self, side: str, price: Decimal, quantity: Decimal, commission: Decimal) -> None:
        self.fees += commission
        self.fills += 1
        if self.side in (None, side):
            held = self.quantity + quantity
            self.average = price if self.side is None else (self.average * self.quantity + price * quantity) / held
            self.side, self.quantity = side, held
            return
        closed = min(quantity, self.quantity)
        gain = price - self.average if self.side == "BUY" else self.average - price
        self.realised += gain * closed
        rest = quantity - self.quantity
        if rest > 0:
            self.side, self.quantity, self.average = side, rest, price
        elif rest == 0:
            self.side, self.quantity, self.average = None, ZERO, None
        else:
            self.quantity = -rest


_OUT = "ticker string, venue string, ts_event long, seq string, piece long, side string, quantity decimal(28,8), average_price decimal(30,12), realised_pnl decimal(38,12), fees decimal(38,8), fill_count long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, state = None, State()
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.decimal128(28, 8), pa.decimal128(30, 12), pa.decimal128(38, 12), pa.decimal128(38, 8), pa.int64()]
    names = [x.split()[0] for x in _OUT.split(", ")]
    for batch in batches:
        out = []
        cols = [batch.column(n).to_pylist() for n in ("ticker", "venue", "piece", "ts_event", "seq", "side", "price", "quantity", "commission_amount")]
        for ticker, venue, piece, ts, seq, side, price, quantity, commission in zip(*cols):
            if (ticker, venue, piece) != at:
                at, state = (ticker, venue, piece), State()
            state.apply(side, price, quantity, commission)
            average = None if state.average is None else state.average.quantize(_SCALE)
            out.append((ticker, venue, ts, seq, piece, state.side, state.quantity, average, state.realised.quantize(_SCALE), state.fees, state.fills))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)


def _pieces(fills: DataFrame) -> DataFrame:
    """fills with `piece`: how often the symbol was flat before."""
    order = Window.partitionBy(*SYMBOL).orderBy("ts_event", "seq")
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    held = fills.withColumn("_held", F.sum(signed).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    flats = F.sum(F.when(F.col("_held") == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return held.withColumn("piece", F.coalesce(flats, F.lit(0)).cast("long")).drop("_held")


def _folded(fills: DataFrame) -> DataFrame:
    rows = _pieces(fills).select(*SYMBOL, "piece", "ts_event", F.col("seq").cast("string").alias("seq"), "side", F.col("price").cast("decimal(18,8)").alias("price"), F.col("quantity").cast("decimal(28,8)").alias("quantity"), F.col("commission_amount").cast("decimal(38,8)").alias("commission_amount"), F.col("seq").alias("_seq"))
    dealt = rows.repartition(*SYMBOL, "piece").sortWithinPartitions(*SYMBOL, "piece", "ts_event", "_seq")
    return dealt.drop("_seq").mapInArrow(_fold, _OUT)


def running(fills: DataFrame) -> DataFrame:
    """The position after each fill. seq is returned as text. Neither repeats nor their order are repaired: see dedup_fills and the total order."""
    steps = _folded(fills)
    ends = steps.groupBy(*SYMBOL, "piece").agg(F.max_by("realised_pnl", "fill_count").alias("r"), F.max("fees").alias("f"), F.max("fill_count").alias("n"))
    before = Window.partitionBy(*SYMBOL).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select(*SYMBOL, "piece", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias("_" + c) for c in ("r", "f", "n")])
    out = steps.join(earlier, [*SYMBOL, "piece"])
    return out.withColumns({"realised_pnl": (F.col("realised_pnl") + F.col("_r")).cast("decimal(38,12)"), "fees": (F.col("fees") + F.col("_f")).cast("decimal(38,8)"), "fill_count": F.col("fill_count") + F.col("_n")}).drop("_r", "_f", "_n", "piece")


def final(fills: DataFrame) -> DataFrame:
    """One row for each symbol: what is held after its last fill, and all that was realised and paid."""
    ends = _folded(fills).groupBy(*SYMBOL, "piece").agg(F.max_by(F.struct("side", "quantity", "average_price", "realised_pnl"), "fill_count").alias("s"), F.max("fees").alias("fees"), F.max("fill_count").alias("fill_count"))
    out = ends.groupBy(*SYMBOL).agg(F.max_by("s", "piece").alias("s"), F.sum("s.realised_pnl").cast("decimal(38,12)").alias("realised_pnl"), F.sum("fees").cast("decimal(38,8)").alias("fees"), F.sum("fill_count").alias("fill_count"))
    return out.select(*SYMBOL, "s.side", "s.quantity", "s.average_price", "realised_pnl", "fees", "fill_count")


def as_of(fills: DataFrame, ts: int) -> DataFrame:
    """The position at a time: the fold of the fills up to it."""
    return final(fills.filter(F.col("ts_event") <= ts))


def dedup_fills(fills: DataFrame, key: str = "id") -> DataFrame:
    """One row of each id; where rows differ, the earliest received."""
    rest = sorted(c for c in fills.columns if c not in (key, "ts_init"))
    order = Window.partitionBy(key).orderBy(*([F.col("ts_init")] if "ts_init" in fills.columns else []), *rest)
    return fills.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def summary(fills: DataFrame) -> DataFrame:
    """Fees, counts and measured slippage by liquidity."""
    cost = (F.col("price") - F.col("reference_price")) * F.when(F.col("side") == "BUY", 1).otherwise(-1)
    return fills.groupBy("liquidity").agg(F.count(F.lit(1)).alias("fill_count"), F.sum("commission_amount").alias("fees"), F.count("reference_price").alias("measured"), F.avg(cost).alias("mean_slippage"))
