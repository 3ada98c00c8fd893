import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import sharding


@pytest.mark.parametrize("bits,dims", [(1, 2), (2, 2), (4, 2), (4, 3), (2, 4), (3, 1)])
def test_curve_visits_each_cell_once_by_unit_steps(bits, dims):
    order = sharding.hilbert_order(bits, dims)
    assert sorted(order) == list(range(1 << bits * dims))
    at = np.argsort(order)
    points = np.stack([(at >> bits * (dims - 1 - d)) & ((1 << bits) - 1) for d in range(dims)], axis=1)
    assert (np.abs(np.diff(points, axis=0)).sum(axis=1) == 1).all()


def documents(spark, n=1000):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i * 7919 % 1000} " * (i % 9), ["en", "de", None][i % 3], f"src{i % 5}", 1, "mine") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra int, slot string")


def sharded(spark, law, n=1000, shards=16):
    docs = sharding.document_metadata(documents(spark, n))
    return sharding.hilbert_shards(docs, ["source", "lang", "size"], ["text_crc32", "doc_id"], n_shards=shards, law=law, size="size").toPandas()


def gapless(out):
    return all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_rows_law(spark):
    out = sharded(spark, "rows")
    counts = out.shard.value_counts()
    assert len(out) == 1000 and len(counts) == 16 and counts.max() - counts.min() <= 1 and gapless(out)
    ordered = out.sort_values(["curve", "text_crc32", "doc_id"])
    assert ordered.shard.is_monotonic_increasing and (ordered.groupby("shard").slot.diff().dropna() == 1).all()
    assert out.extra.eq(1).all()


def test_bytes_law(spark):
    out = sharded(spark, "bytes")
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 2 * out["size"].max() and gapless(out)


def test_runs_prune(spark):
    """A filter on one dimension leaves fewer shards to read than dealing rows out at random would."""
    out = sharded(spark, "rows", 3000)
    assert out[out.source == "src1"].shard.nunique() <= 8


def test_odd_rows(spark):
    empty = sharding.document_metadata(documents(spark, 0))
    assert sharding.hilbert_shards(empty, ["source", "lang", "size"], ["doc_id"]).count() == 0
    rows = [(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, "é" * 100_000, None, "s")]
    docs = sharding.document_metadata(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    out = sharding.hilbert_shards(docs, ["source", "lang", "size"], ["text_crc32", "doc_id"], n_shards=2).toPandas()
    assert sorted(out["size"]) == [1, 1, 1, 200_001] and sorted(out.shard) == [0, 0, 1, 1] and gapless(out)
    with pytest.raises(ValueError):
        sharding.hilbert_shards(docs, ["size"], ["doc_id"], law="key")
    docs.select(F.lit(1))


def test_cuts_do_not_depend_on_how_rows_are_dealt_out(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(rng.lognormal(5, 3)), f"source-{rng.integers(5000)}") for i in range(40_000)], "doc_id long, size double, source string")
    got = []
    for dealt in (df.repartition(3), df.repartition(17, "source"), df.orderBy("size").coalesce(1)):
        out = sharding.hilbert_shards(dealt, ["source", "size"], ["doc_id"]).select("doc_id", "curve", "shard", "slot")
        got.append(sorted(tuple(r) for r in out.collect()))
    assert got[0] == got[1] == got[2]
    cuts = sharding._cuts(df, F.col("size"), [0.25, 0.5, 0.75])
    exact = np.quantile([r["size"] for r in df.collect()], [0.25, 0.5, 0.75])
    assert np.allclose(cuts, exact, rtol=1e-3)
