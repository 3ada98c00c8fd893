"""Connected components of a table of links, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Links that one task joins up by itself, in a few MB; more take rounds of stars over all tasks.
ONE_TASK = 50_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a few links, each under its smallest id."""
    top: dict[int, int] = {}

    def find(i: int) -> int:
        while top.setdefault(i, i) != i:
            top[i] = i = top[top[i]]
        return i

    for batch in batches:
        for a, b in zip(batch.column("hi").to_pylist(), batch.column("lo").to_pylist()):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    ids = list(top)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(find, ids), pa.int64())], names=["id", "component_id"])


def _print(edges: DataFrame) -> tuple:
    """What tells two tables of links apart: how many there are, and a sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component_id) for every id that occurs in links (a, b): the smallest id it is connected with.

    The result reads a written table, which discard() removes. A link with a null or with itself connects nothing. Minima are taken before the shuffle, so a
    hub with most of the links costs each task one row; the joins back to a hub's links are ones that Spark can split."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = common.materialise(edges, "links", light=True)
    if edges.count() <= ONE_TASK:
        found = common.materialise(edges.coalesce(1).mapInArrow(_joined, "id long, component_id long"), "components")
        common.discard(edges)
        return found
    before = None
    for _ in range(most_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        star = small.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo")))
        new = common.materialise(star.distinct(), "links", light=True)
        after = _print(new)
        common.discard(edges)
        edges = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    tops = edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("component_id"))
    return common.kept_in(tops.union(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component_id")).distinct()), edges)
