"""The engine's operators on streams. Survey ids: T1 to T12, U2, A10."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import columns as c
from ..operators.positions import State
from ..sources import schema

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(events: DataFrame, lateness: str) -> DataFrame:
    """Events with `event_time` from ts_event, and how late one may come."""
    return events.withColumn("event_time", c.to_timestamp("ts_event")).withWatermark("event_time", lateness)


def without_repeats(events: DataFrame, key: str, lateness: str) -> DataFrame:
    """An id that came within the watermark doesn't come again."""
    return timed(events, lateness).dropDuplicatesWithinWatermark([key])


def bars(ticks: DataFrame, interval: str, lateness: str) -> DataFrame:
    """Bars of closed windows, stamped at the window's end. A window closes when the watermark has passed it."""
    seconds = schema.INTERVALS[interval] // schema.SECOND
    key = F.struct("ts_event", "seq")
    rows = ticks if "event_time" in ticks.columns else timed(ticks, lateness)
    out = rows.groupBy(F.window("event_time", f"{seconds} seconds"), "ticker", "venue").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("size").cast("decimal(28,8)").alias("volume"), F.count(F.lit(1)).alias("trade_count")
    )
    return out.select("ticker", "venue", (F.unix_micros("window.end") * 1000).alias("ts_event"), "open", "high", "low", "close", "volume", "trade_count")


class Fold(StatefulProcessor):
    """The position of a symbol after each fill. Fills of one batch are folded in order; one older than the last folded
    is not folded but comes out with late = true, for a correction to deal with. Numbers as seq compare as numbers, texts as texts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", "side string, quantity string, average string, realised string, fees string, fills long, ts long, seq string, number boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        at, last = State(), None
        if self.state.exists():
            side, quantity, average, realised, fees, fills, ts, seq, number = self.state.get()
            at, last = State(side, Decimal(quantity), None if average is None else Decimal(average), Decimal(realised), Decimal(fees), fills), (ts, int(seq) if number else seq)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts_event", "seq"]).itertuples():
            here = (int(r.ts_event), r.seq if isinstance(r.seq, str) else int(r.seq))
            late = last is not None and here < last
            if not late:
                at.apply(r.side, r.price, r.quantity, r.commission_amount)
                last = here
            text = lambda x: None if x is None else f"{x:f}"
            out.append((*key, r.ts_event, str(r.seq), at.side, text(at.quantity), text(at.average), text(at.realised), text(at.fees), at.fills, late))
        self.state.update((at.side, str(at.quantity), None if at.average is None else str(at.average), str(at.realised), str(at.fees), at.fills, last[0], str(last[1]), isinstance(last[1], int)))
        yield pd.DataFrame(out, columns=["ticker", "venue", "ts_event", "seq", "side", "quantity", "average_price", "realised_pnl", "fees", "fill_count", "late"])

    def close(self) -> None:
        pass


POSITIONS = "ticker string, venue string, ts_event long, seq string, side string, quantity string, average_price string, realised_pnl string, fees string, fill_count long, late boolean"


def positions(fills: DataFrame) -> DataFrame:
    """The running fold on a stream of fills; decimals come out as text, with all their digits. Needs the RocksDB state store."""
    return fills.groupBy("ticker", "venue").transformWithStateInPandas(statefulProcessor=Fold(), outputStructType=POSITIONS, outputMode="Append", timeMode="None")


def split_late(folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions after fills on time, late fills for a table of their own) of positions(); each feeds a sink of its own."""
    return folded.filter("not late").drop("late"), folded.filter("late").select("ticker", "venue", "ts_event", "seq")


def append(stream: DataFrame, path: str, checkpoint: str):
    """What there is, appended to Parquet once; what was written is never changed."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
