"""Point-in-time features: trailing windows of whole bars, NULL until full, blind to what comes after. Survey ids: W1 to W8."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import columns as c
from .registry import FeatureRef, FeatureRegistry, FeatureSpec, Strategy, Version

SERIES = ("venue", "ticker", "interval")
features = FeatureRegistry()


def trailing(lookback: int) -> WindowSpec:
    """The last `lookback` rows of the bar's own series, in total order, whatever order they arrived in."""
    return Window.partitionBy(*SERIES).orderBy("ts_event", "seq").rowsBetween(-(lookback - 1), Window.currentRow)


def evaluate(spec: FeatureSpec) -> Column:
    """The feature at each bar. Its window ends at the bar itself, so it cannot look ahead."""
    w = trailing(spec.lookback)
    return F.when((F.count(F.lit(1)).over(w) == spec.lookback) & (F.col("interval") == spec.interval), spec.build(w))


def compute(bars: DataFrame, specs: Iterable[FeatureSpec]) -> DataFrame:
    """bars with a column for each feature, which says its version; all share one shuffle and one sort by series.

    Of several versions of a name the latest has the plain name; each of them has a column name@version."""
    specs = list(specs)
    count = Counter(s.name for s in specs)
    latest = {s.name: s for s in sorted(specs, key=lambda s: Version.parse(s.version))}
    named = [(s.name, s) for s in latest.values()] + [(s.qualified_name, s) for s in specs if count[s.name] > 1]
    out = bars.drop(*[name for name, _ in named])
    return out.select("*", *[evaluate(s).cast("double").alias(name, metadata={"version": s.version}) for name, s in named])


def pinned(table: DataFrame, ref: FeatureRef) -> Column:
    """The column that a reference means: the plain name, or that of its version; a table without it is an error."""
    if ref.version is None or f"{ref.name}@{ref.version}" not in table.columns:
        version = table.schema[ref.name].metadata.get("version", ref.version)
        if ref.version not in (None, version):
            raise ValueError(f"{ref} is asked for, the table has version {version}")
        return F.col(ref.name)
    return F.col(f"`{ref.name}@{ref.version}`")


def at(bars: DataFrame, spec: FeatureSpec, as_of: int) -> DataFrame:
    """Of each series the feature as it was known at a time; bars at that very time are known."""
    known = compute(bars.filter(F.col("ts_event") <= as_of), [spec])
    return known.groupBy(*SERIES).agg(F.max_by(spec.name, F.struct("ts_event", "seq")).alias(spec.name))


def decide(strategy: Strategy, table: DataFrame) -> DataFrame:
    """The proposals of a strategy over a table of features with a `regime`.

    The gate comes after the windows: rows of other regimes are part of the history."""
    names = [f.name for f in strategy.features]
    table = table.withColumns({f.name: pinned(table, f) for f in strategy.features if f.version is not None})
    open_ = table.filter(F.col("regime").isin(*strategy.regimes) if strategy.regimes else F.lit(False)).filter(c.requires(*names))
    return strategy.decide(open_).withColumns({"strategy": F.lit(strategy.name), "strategy_version": F.lit(strategy.version)})


def session_levels(bars: DataFrame) -> DataFrame:
    """Running high, low and volume-weighted price that start anew with each session (venue, ticker, session_date, session)."""
    w = Window.partitionBy("venue", "ticker", "session_date", "session").orderBy("ts_event", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    paid = F.sum(typical.cast("double") * F.col("volume").cast("double")).over(w)
    return bars.withColumns({"session_high": F.max("high").over(w), "session_low": F.min("low").over(w), "session_vwap": paid / F.nullif(F.sum("volume").over(w).cast("double"), F.lit(0.0))})


def from_function(function: Callable[..., float | None], lookback: int, *names: str) -> Callable[[WindowSpec], Column]:
    """A builder from any pure function of the window's columns, each a list of `lookback` doubles in order. Slower than built-in aggregates."""
    called = F.udf(lambda *columns: function(*map(list, columns)) if len(columns[0]) == lookback else None, "double", useArrow=True)
    return lambda w: called(*[F.collect_list(F.col(n).cast("double")).over(w) for n in names])


@features.feature("last_close", "1.0.0", lookback=1, interval="1h", description="close of the latest bar")
def last_close(w: WindowSpec) -> Column:
    return F.last("close").over(w)


@features.feature("bar_range", "1.0.0", lookback=1, interval="1h", description="high less low of the latest bar")
def bar_range(w: WindowSpec) -> Column:
    return F.last(F.col("high") - F.col("low")).over(w)


@features.feature("mean_close", "1.0.0", lookback=3, interval="1h", description="mean close of three bars")
def mean_close(w: WindowSpec) -> Column:
    return F.avg(F.col("close").cast("double")).over(w)


@features.feature("mean_close", "1.1.0", lookback=2, interval="1h", description="mean close of two bars")
def mean_close_of_two(w: WindowSpec) -> Column:
    return F.avg(F.col("close").cast("double")).over(w)
