"""One ordered stream out of tables of different events. Survey ids: S12, O1, U1, P1, and the replay digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("ts_event", "seq", "kind", "ticker", "venue")


def merge(tables: dict[str, DataFrame]) -> DataFrame:
    """All events with their `kind`; what a kind lacks is NULL."""
    named = [df.withColumn("kind", F.lit(kind)) for kind, df in sorted(tables.items())]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return out.withColumns({c: F.lit(None).cast("string") for c in ("ticker", "venue") if c not in out.columns})


def replay(tables: dict[str, DataFrame], start: int, end: int) -> DataFrame:
    """Events with start <= ts_event < end in one total order; kind and symbol settle what (ts_event, seq) leaves open."""
    rows = merge(tables).filter((F.col("ts_event") >= start) & (F.col("ts_event") < end))
    return rows.orderBy(*ORDER)


def digest(events: DataFrame) -> str:
    """A fingerprint of the set of events, the same for any partitioning: 128 bits of sums of row hashes."""
    row = F.to_json(F.struct(*sorted(events.columns)))
    h = F.sha2(row, 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))
    r = events.agg(F.count(F.lit(1)), part(1), part(17)).first()
    return f"{r[0]}-{int(r[1] or 0) % (1 << 64):016x}{int(r[2] or 0) % (1 << 64):016x}"
