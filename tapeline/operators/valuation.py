"""Positions at a mark. Survey ids: P30 to P34, A9, J2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c


def value(positions: DataFrame, marks: DataFrame) -> DataFrame:
    """positions with the latest mark (ticker, venue, mark) and what it makes of them; NULL without a mark, except that flat ones are worth 0."""
    p = positions.join(marks, ["ticker", "venue"], "left")
    return p.withColumns({"currency": c.currency(), "unrealised_pnl": c.unrealised_pnl("mark"), "market_value": c.market_value("mark"), "net_realised_pnl": c.net_realised_pnl(), "total_pnl": c.total_pnl("mark")})


def latest_marks(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("ticker", "venue").agg(F.max_by("price", F.struct("ts_event", "seq")).alias("mark"))


def exposure(valued: DataFrame) -> DataFrame:
    """Net and gross market value of each currency; currencies are never added up."""
    return valued.groupBy("currency").agg(F.sum("market_value").alias("net"), F.sum(F.abs("market_value")).alias("gross"), F.count(F.lit(1)).alias("positions"))
