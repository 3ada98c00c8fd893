"""The bar corpus on Parquet and the event log. Survey ids: S2 to S8, S11, S12, S15, F1, J7, U3."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import rules
from . import schema

KEY = ("venue", "ticker", "interval", "ts_event", "seq")
DAY_NS = 86_400_000_000_000


def bar_rows(bars: DataFrame, source: str, ingested_at: int, session_date: Column | None = None) -> DataFrame:
    """Bars with their provenance, in the stored order and types. session_date is the day of the close unless given."""
    schema.require({f.name: f.dataType for f in bars.schema.fields}, schema.T.StructType([f for f in schema.BAR.fields if f.name not in (*schema.PROVENANCE, "vwap", "trade_count")]))
    if source not in schema.SOURCES:
        raise ValueError(f"unknown source {source!r}")
    day = session_date if session_date is not None else F.to_date(F.timestamp_micros(F.expr("(ts_event - pmod(ts_event, 1000)) div 1000")))
    named = bars.withColumns({n: F.lit(None) for n in ("vwap", "trade_count") if n not in bars.columns})
    full = named.withColumns({"source": F.lit(source), "ingested_at": F.lit(ingested_at), "session_date": day})
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.BAR.fields])


def bars_of(rows: DataFrame) -> DataFrame:
    """S3: stored rows as bars, provenance left out, all rules checked again."""
    return rules.strict(rows.drop(*schema.PROVENANCE), rules.bar())


def partition_path(root: str, venue: str, ticker: str, session_date: str) -> str:
    """S6"""
    return f"{root.rstrip('/')}/venue={venue}/ticker={ticker}/session_date={session_date}"


def first_written(rows: DataFrame, priority: tuple[str, ...] = schema.SOURCES) -> DataFrame:
    """One row of each bar. Where sources disagree the earlier in `priority` wins, then the earlier ingestion, then the smaller values."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("source")), F.lit(len(priority) + 1))
    rest = [F.col(n) for n in ("open", "high", "low", "close", "volume", "vwap", "trade_count")]
    order = Window.partitionBy(*KEY).orderBy(F.when(rank > 0, rank).otherwise(len(priority) + 1), "ingested_at", *rest)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def write_bars(rows: DataFrame, root: str) -> None:
    """Append what the corpus lacks; the same bars again change nothing.

    Only partitions that the new rows fall into are read for the comparison."""
    spark = rows.sparkSession
    new = first_written(rules.strict(rows, rules.bar()))
    try:
        old = _scan(spark, root)
    except AnalysisException:
        old = None
    if old is not None:
        touched = rows.select(*schema.PARTITIONS).distinct()
        new = new.join(old.join(touched, list(schema.PARTITIONS), "left_semi").select(*KEY), list(KEY), "left_anti")
    new.repartition(*schema.PARTITIONS).sortWithinPartitions(*schema.PARTITIONS, "ts_event", "seq").write.mode("append").partitionBy(*schema.PARTITIONS).parquet(root)


def _scan(spark: SparkSession, root: str) -> DataFrame:
    """The schema is given, so that a ticker that looks like a number stays text."""
    return spark.read.schema(schema.BAR).parquet(root).select(*schema.BAR.fieldNames())


def read_bars(spark: SparkSession, root: str, ticker: str, venue: str, interval: str, start: int, end: int) -> DataFrame:
    """Bars with start <= ts_event < end in order of (ts_event, seq).

    Partitions more than a day outside the range are never listed: a session's date is at most a day from its bars' UTC day."""
    day = lambda ns: F.date_add(F.lit("1970-01-01").cast("date"), ns // DAY_NS)
    rows = _scan(spark, root).filter((F.col("venue") == venue) & (F.col("ticker") == ticker))
    rows = rows.filter(F.col("session_date").between(F.date_sub(day(start), 1), F.date_add(day(end), 1)))
    return bars_of(rows.filter((F.col("interval") == interval) & (F.col("ts_event") >= start) & (F.col("ts_event") < end))).orderBy("ts_event", "seq")


def iterate(df: DataFrame) -> Iterator[Row]:
    """The rows in order, a partition at a time."""
    return df.toLocalIterator(prefetchPartitions=True)


def within(df: DataFrame, start: int, end: int) -> DataFrame:
    """F1"""
    return df.filter((F.col("ts_event") >= start) & (F.col("ts_event") < end))


class BarStore:
    """The corpus at one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def write_bars(self, rows: DataFrame) -> None:
        write_bars(rows, self.root)

    def read_bars(self, ticker: str, venue: str, interval: str, start: int, end: int) -> DataFrame:
        return read_bars(self.spark, self.root, ticker, venue, interval, start, end)


class EventLog:
    """Events of all kinds, appended and never changed; a correction is one more event."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, events: DataFrame, kind: str) -> None:
        rules.strict(events, rules.event()).withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind").option("mergeSchema", "true").parquet(self.root)

    def stream(self, start: int, end: int) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.root)
        return within(rows, start, end).orderBy("ts_event", "seq", "kind")


def raw_dir(data_root: str) -> str:
    """What was ingested, never changed."""
    return f"{data_root.rstrip('/')}/raw"


def derived_dir(data_root: str) -> str:
    """What can be built again."""
    return f"{data_root.rstrip('/')}/derived"
