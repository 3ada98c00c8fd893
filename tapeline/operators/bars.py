"""Rolling ticks and bars up to longer bars. Survey ids: A10, T7."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import schema


def _stamped(df: DataFrame, interval: str, closed_at_start: bool) -> DataFrame:
    """Bucket [open, close) for ticks; a bar stamped exactly at a close belongs to the bucket that ends there."""
    ns = schema.INTERVALS[interval]
    at = "ts_event" if closed_at_start else "ts_event - 1"
    return df.withColumn("_close", F.expr(f"({at}) - pmod({at}, {ns}L) + {ns}L"))


def from_ticks(ticks: DataFrame, interval: str) -> DataFrame:
    """Bars of an interval, stamped at its end; ties in time go by seq. Partial sums are made before the one shuffle."""
    key = F.struct("ts_event", "seq")
    rows = _stamped(ticks, interval, True)
    out = rows.groupBy("ticker", "venue", "_close").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.sum("size").cast("decimal(28,8)").alias("volume"), F.count(F.lit(1)).alias("trade_count"), F.max("ts_init").alias("ts_init"), F.max("seq").alias("seq"),
    )
    return out.withColumn("interval", F.lit(interval)).withColumnRenamed("_close", "ts_event")


def roll_up(bars: DataFrame, interval: str) -> DataFrame:
    """Longer bars from shorter ones; the shorter interval must divide the longer."""
    key = F.struct("ts_event", "seq")
    out = _stamped(bars, interval, False).groupBy("ticker", "venue", "_close").agg(
        F.min_by("open", key).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", key).alias("close"),
        F.sum("volume").cast("decimal(28,8)").alias("volume"), F.sum("trade_count").alias("trade_count"), F.max("ts_init").alias("ts_init"), F.max("seq").alias("seq"),
    )
    return out.withColumn("interval", F.lit(interval)).withColumnRenamed("_close", "ts_event")
