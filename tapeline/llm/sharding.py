"""Sharding along a Hilbert curve through quantised metadata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Cells a dimension is quantised to, as a power of two. Three dimensions of 4 bits are 4,096 cells.
BITS = 4
#: Most cells whose curve order is kept in one literal array.
MAX_CELLS = 1 << 16


def hilbert_order(bits: int, dims: int) -> np.ndarray:
    """Curve index of every cell of a grid with 2**bits steps in each of dims directions.

    The cell's number has the first dimension in its highest bits. The curve's transposed index comes from Gray-code steps
    taken from the highest bit plane to the lowest (Skilling 2004), over all cells at once."""
    cells = np.arange(1 << (bits * dims), dtype=np.int64)
    axes = [(cells >> (bits * (dims - 1 - d))) & ((1 << bits) - 1) for d in range(dims)]
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for d in range(dims):
            flip = (axes[d] >> plane) & 1 == 1
            swap = np.where(flip, 0, (axes[0] ^ axes[d]) & low)
            axes[0] = np.where(flip, axes[0] ^ low, axes[0] ^ swap)
            if d:
                axes[d] = axes[d] ^ swap
    for d in range(1, dims):
        axes[d] = axes[d] ^ axes[d - 1]
    parity = np.zeros_like(cells)
    for plane in range(bits - 1, 0, -1):
        parity = np.where((axes[dims - 1] >> plane) & 1 == 1, parity ^ ((1 << plane) - 1), parity)
    axes = [a ^ parity for a in axes]
    index = np.zeros_like(cells)
    for plane in range(bits - 1, -1, -1):
        for a in axes:
            index = (index << 1) | ((a >> plane) & 1)
    return index


def _common_prefix(a: str, b: str) -> int:
    x, y = a.encode(), b.encode()
    n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return n


def _ordinal(df: DataFrame, name: str, skip: int) -> Column:
    """A number in the order of the column: itself, or seven bytes of a string after what all values begin with."""
    if dict(df.dtypes)[name] == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(name), "UTF-8"), skip + 1, 7)), 14, "0"), 16, 10).cast("double")
    return F.col(name).cast("double")


def _coarse(v: Column) -> Column:
    """v to twelve binary digits, so that there are few different values however many rows there are."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(v))) - 11)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.floor(v / unit) * unit)


def _cuts(df: DataFrame, value: Column, steps: list[float]) -> list[float]:
    """Quantiles from exact counts of the coarse values: the same however the rows are dealt out."""
    counts = df.select(_coarse(value).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.percentile("v", steps, F.col("n"))).first()[0] or []


def curve_column(df: DataFrame, dims: list[str], bits: int = BITS) -> Column:
    """Curve index of each row, its dimensions cut at quantiles of the whole table. Nulls share the first step."""
    if 1 << (bits * len(dims)) > MAX_CELLS:
        raise ValueError("too many cells for one lookup table; take fewer bits")
    strings = [c for c in dims if dict(df.dtypes)[c] == "string"]
    ends = df.agg(F.count(F.lit(1)), *[f(c) for c in strings for f in (F.min, F.max)]).first()
    skip = {c: _common_prefix(ends[2 * i + 1] or "", ends[2 * i + 2] or "") for i, c in enumerate(strings)}
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    cell = F.lit(0)
    for c in dims:
        value = _ordinal(df, c, skip.get(c, 0))
        at = sorted(set(_cuts(df, value, steps)))
        step = F.coalesce(F.size(F.filter(F.array(*map(F.lit, at)), lambda q: q < value)), F.lit(0)) if at else F.lit(0)
        cell = cell * (1 << bits) + F.when(F.col(c).isNull(), 0).otherwise(step)
    order = F.lit(hilbert_order(bits, len(dims)).astype(np.int32))
    return F.get(order, cell.cast("int"))


def hilbert_shards(df: DataFrame, dims: list[str], ties: list[str], n_shards: int = 16, law: str = "rows", size: str | None = None, bits: int = BITS) -> DataFrame:
    """All rows of df with their shard and slot: rows in curve order, cut into runs.

    law "rows" cuts runs whose counts are at most one apart; "bytes" cuts at equal steps of the sum of `size`, each row
    going where its middle falls. Rows in one cell are ordered by `ties`, so equal texts of equal metadata lie together.
    Rows are dealt out by ranges of (curve, ties): a cell that holds most of the rows still spreads over many tasks. The
    driver sees one count for each range.

    Added columns: curve, shard, slot (from 0 in each shard); columns of df with these names are replaced. Nulls count as the
    smallest value of a dimension. Fully equal rows are interchangeable. An empty table gives an empty result."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    spark = df.sparkSession
    df = df.drop("curve", "shard", "slot")
    named = df.withColumn("curve", curve_column(df, dims, bits))
    keys = ["curve", *ties]
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.repartitionByRange(n_ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = common.materialise(dealt, "hilbert")
    weight = F.coalesce(F.col(size).cast("long"), F.lit(0)) if law == "bytes" else F.lit(1).cast("long")
    rid = F.shiftright(F.col("_at"), 33)
    counts = sorted(dealt.groupBy(rid.alias("r")).agg(F.sum(weight).alias("n")).collect(), key=lambda r: r["r"])
    total, rows = 0, []
    for r in counts:
        rows.append((int(r["r"]), total))
        total += int(r["n"])
    before = F.broadcast(spark.createDataFrame(rows, "_r long, _before long"))  # one row for each range
    out = dealt.withColumn("_r", rid).join(before, "_r")
    total = max(1, total)
    if law == "rows":
        at = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
        out = out.withColumn("_g", at).withColumn("shard", F.expr(f"cast((_g * {n_shards}) div {total} as int)"))
        out = out.withColumn("slot", F.expr(f"_g - (shard * {total}L + {n_shards - 1}) div {n_shards}"))
        return out.drop("_r", "_before", "_at", "_g")
    run = F.sum(weight).over(Window.partitionBy("_r").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn("_g", F.col("_before") + run - weight / 2)
    out = out.withColumn("shard", F.least(F.floor(F.col("_g") * n_shards / total), F.lit(n_shards - 1)).cast("int"))
    firsts = out.groupBy("shard", "_r").agg(F.count(F.lit(1)).alias("n")).collect()
    seen: dict[int, int] = {}
    offs = []
    for r in sorted(firsts, key=lambda r: (r["shard"], r["_r"])):
        offs.append((r["shard"], r["_r"], seen.get(r["shard"], 0)))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]
    starts = F.broadcast(spark.createDataFrame(offs, "shard int, _r long, _o long"))  # at most ranges + shards rows
    out = out.join(starts, ["shard", "_r"])
    out = out.withColumn("slot", F.col("_o") + F.row_number().over(Window.partitionBy("_r", "shard").orderBy("_at")) - 1)
    return out.drop("_r", "_before", "_at", "_g", "_o")


def document_metadata(docs: DataFrame) -> DataFrame:
    """size (UTF-8 bytes plus 1; null: 1) and text_crc32 (null: 0) of each document."""
    return docs.withColumns({
        "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1,
        "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long"),
    })
