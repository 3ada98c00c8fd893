"""Joins in time: as-of, interval and barrier. Survey ids: J1 to J5, J7, J8, W6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


def asof(left: DataFrame, right: DataFrame, by: list[str], values: list[str], time: str = "ts_event", order: list[str] | None = None, bucket_ns: int = DAY_NS) -> DataFrame:
    """left with the right side's `values` at the latest time not after its own, NULL before the first.

    order breaks ties of the right side's time (the last wins). Rows meet by key and time bucket, and what a bucket starts with is
    carried over from one row for each earlier bucket: a key that most rows have spreads over as many tasks as it has buckets."""
    order = order or []
    bucket = F.expr(f"{time} div {bucket_ns}L - if({time} % {bucket_ns}L < 0, 1, 0)")
    held = F.struct(*[F.col(v) for v in values])
    key = F.struct(F.col(time), *[F.col(o) for o in order])
    ours = left.withColumn("_bucket", bucket)
    theirs = right.select(*by, time, *order, held.alias("_held")).withColumn("_bucket", bucket)
    ends = theirs.groupBy(*by, "_bucket").agg(F.max_by("_held", key).alias("_last"))
    slots = ends.unionByName(ours.select(*by, "_bucket").distinct(), allowMissingColumns=True).groupBy(*by, "_bucket").agg(F.first("_last", ignorenulls=True).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = slots.select(*by, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    both = ours.withColumn("_side", F.lit(1)).unionByName(theirs.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(*by, "_bucket").orderBy(time, "_side", *[F.when(F.col("_side") == 0, F.col(o)) for o in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_now", F.last("_held", ignorenulls=True).over(so_far)).filter("_side = 1")
    out = seen.join(carry, [*by, "_bucket"], "left").withColumn("_now", F.coalesce("_now", "_carry"))
    keep = [c for c in left.columns if c not in values]
    return out.select(*keep, *[F.col("_now")[v].alias(v) for v in values])


def lineage(fills: DataFrame, orders: DataFrame, intents: DataFrame) -> DataFrame:
    """Each fill with its order and the proposal behind it."""
    o = orders.select(F.col("id").alias("order_id"), "intent_id", "order_type", F.col("ts_event").alias("order_ts"))
    i = intents.select(F.col("id").alias("intent_id"), "strategy", "strategy_version", F.col("ts_event").alias("intent_ts"))
    return fills.join(o, "order_id").join(i, "intent_id")


def halt_gaps(halts: DataFrame, resumes: DataFrame) -> DataFrame:
    """[halted_at, resumed_at) of each halt; without a resume it is open, resumed_at NULL."""
    both = halts.select("ticker", "venue", "ts_event", F.lit(1).alias("stop")).unionByName(resumes.select("ticker", "venue", "ts_event", F.lit(0).alias("stop")))
    next_ = Window.partitionBy("ticker", "venue").orderBy("ts_event", "stop")
    return both.withColumn("resumed_at", F.min(F.when(F.col("stop") == 0, F.col("ts_event"))).over(next_.rowsBetween(1, Window.unboundedFollowing))).filter("stop = 1").select("ticker", "venue", F.col("ts_event").alias("halted_at"), "resumed_at")


def in_gap(bars: DataFrame, gaps: DataFrame, how: str = "left_semi") -> DataFrame:
    """Bars stamped inside a halt (left_semi), or all others (left_anti)."""
    g = gaps.select(F.col("ticker").alias("_t"), F.col("venue").alias("_v"), "halted_at", "resumed_at")
    inside = (bars.ticker == g._t) & (bars.venue == g._v) & (bars.ts_event >= g.halted_at) & (g.resumed_at.isNull() | (bars.ts_event < g.resumed_at))
    return bars.join(g, inside, how)


def triple_barrier(intents: DataFrame, bars: DataFrame, target: Column, key: str, bucket_ns: int = DAY_NS) -> DataFrame:
    """The first barrier each proposal meets in bars after it and up to its expiry: stop, target or, meeting neither, time.

    A bar that reaches both counts as the stop, the worse case. Proposals are laid out over the time buckets that they live in, so the
    join has an equality on symbol and bucket besides the range."""
    live = intents.withColumn("_target", target).withColumn("_end", F.col("ts_event") + F.col("horizon_ns"))
    live = live.select(key, "ticker", "venue", "side", "invalidation", "_target", F.col("ts_event").alias("_from"), "_end")
    spans = live.withColumn("_bucket", F.explode(F.expr(f"sequence(_from div {bucket_ns}L, _end div {bucket_ns}L)")))
    b = bars.select("ticker", "venue", "high", "low", "ts_event", F.expr(f"ts_event div {bucket_ns}L").alias("_bucket"))
    met = spans.join(b, ["ticker", "venue", "_bucket"]).filter("ts_event > _from and ts_event <= _end")
    long = F.col("side") == "BUY"
    stop = F.when(long, F.col("low") <= F.col("invalidation")).otherwise(F.col("high") >= F.col("invalidation"))
    hit = F.when(long, F.col("high") >= F.col("_target")).otherwise(F.col("low") <= F.col("_target"))
    first = met.filter(stop | hit).groupBy(key).agg(F.min_by(F.when(stop, "stop").otherwise("target"), "ts_event").alias("barrier"), F.min("ts_event").alias("barrier_ts"))
    return intents.select(key, (F.col("ts_event") + F.col("horizon_ns")).alias("_end")).join(first, key, "left").select(key, F.coalesce("barrier", F.lit("time")).alias("barrier"), F.coalesce("barrier_ts", "_end").alias("barrier_ts"))
