"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Mean number of documents in a bucket of the permuted line, the unit in which prefix sums are taken.
BUCKET_DOCS = 4096
WEIGHTS = (5, 2, 1)
#: Most blocks of a mix; one of more words has longer blocks, so that every draw of the tree is exact.
MAX_BLOCKS = 1 << 29
MAX_EPOCHS = 3


def targets(sizes: list[int], weights: list[float], max_epochs: int) -> list[float]:
    """Words to take from each source: shares of the whole by weight, none above max_epochs times its size."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        unit = rest / sum(weights[i] for i in open_)
        above = {i for i in open_ if unit * weights[i] > max_epochs * sizes[i]}
        for i in above or open_:
            out[i] = float(max_epochs * sizes[i]) if above else unit * weights[i]
        open_ -= above or set(open_)
    return out


def split_quotas(quotas: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard: halves drawn without replacement, level by level.

    Columns sum to the quotas exactly, and the shards' totals are at most one apart."""
    total = int(quotas.sum())
    ends = [(k * total) // n_shards for k in range(n_shards + 1)]
    out = np.zeros((n_shards, len(quotas)), dtype=np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        left = draw(have, ends[mid] - ends[lo], rng)
        split(lo, mid, left)
        split(mid, hi, have - left)

    split(0, n_shards, quotas.astype(np.int64))
    return out


def draw(have: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """One multivariate hypergeometric draw of n blocks; there are at most MAX_BLOCKS, which the sampler can do."""
    return rng.multivariate_hypergeometric(have, n, method="marginals")


def affine(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """(a, b) of the permutation k -> (a k + b) mod n."""
    a = int(rng.integers(1, max(2, n)))
    while gcd(a, max(1, n)) != 1:
        a = a % n + 1
    return a, int(rng.integers(0, max(1, n)))


def mix_plan(
    docs: DataFrame,
    size: str,
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    n_shards: int = 16,
    block_words: int = 4096,
    salt: str = "mix",
) -> DataFrame:
    """One row for each row of docs with what the mix takes of it.

    Added columns: source_size, target (of the source), copies (times the whole document is taken), taken (words:
    size times copies) and shards (the output shard of each copy).

    The documents of a source lie end to end on a line of words, in the order of a hash of their ids. Whole rounds of the
    line, then its beginning, are taken up to the target; one more document evens out what is left. The line is cut
    into blocks of block_words, or of more where there would be over MAX_BLOCKS; the splitting tree gives each shard an exact number of blocks of each source, and an affine
    permutation of the source's blocks says which. Prefix sums are taken by hash bucket, so a source
    that holds most of the rows is spread over many tasks. Only per-source totals reach the driver.

    Nulls: a null source is a source of its own, last in order; a null or negative size counts as 0; null ids are allowed. Rows
    without words take up no room and follow the line's copies. Repeated rows are separate documents. An empty table gives an empty
    result. Columns of docs with the added columns' names are replaced."""
    spark = docs.sparkSession
    added = ["source_size", "target", "copies", "taken", "shards"]
    base = docs.drop(*[c for c in added if c != size])
    base = base.withColumns({
        "_size": F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).cast("long"),
        "_spread": common.spread(F.col(doc_id), salt),
    })
    base = common.materialise(base, "mix-sized")
    totals = base.groupBy(F.col(source).alias("_source")).agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("docs")).collect()
    if not totals:
        return docs.drop(*added).withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "copies": F.lit(0), "taken": F.lit(0).cast("long"), "shards": F.array().cast("array<int>")}).limit(0)
    totals.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes = [int(r["words"]) for r in totals]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], max_epochs)
    rng = np.random.Generator(np.random.PCG64(20_240_501))
    # A block of a whole round belongs to that round, so a source's blocks are those of its rounds and of the beginning.
    block_words = max(block_words, -(-int(sum(aims)) // MAX_BLOCKS))
    quotas = np.array([-(-int(round(a)) // block_words) if a > 0 else 0 for a in aims], dtype=np.int64)
    ends = np.cumsum(split_quotas(quotas, n_shards, rng), axis=0)
    rows = []
    for i, r in enumerate(totals):
        whole = min(max_epochs, int(aims[i] // sizes[i])) if sizes[i] else 0
        rest = aims[i] - whole * sizes[i] if sizes[i] else 0.0
        a, b = affine(int(quotas[i]), rng) if quotas[i] else (1, 0)
        rows.append((i, r["_source"], sizes[i], float(aims[i]), whole, float(rest), max(1, int(r["docs"]) // BUCKET_DOCS), int(quotas[i]), a, b, [int(x) for x in ends[:, i]]))
    plan = spark.createDataFrame(rows, T.StructType.fromDDL("_i int, _source string, source_size long, target double, _whole int, _rest double, _buckets long, _blocks long, _a long, _b long, _ends array<long>"))

    marked = base.join(plan, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    marked = marked.withColumn("_bucket", F.floor(F.col("_spread") / F.lit(float(1 << 52)) * F.col("_buckets")).cast("long"))
    sums = marked.groupBy("_i", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("_i").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    in_bucket = Window.partitionBy("_i", "_bucket").orderBy("_spread", F.col(doc_id), "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marked.join(before, ["_i", "_bucket"]).withColumn("_start", F.col("_before") + F.sum("_size").over(in_bucket) - F.col("_size"))
    placed = placed.withColumn("_more", (F.col("_start") + F.col("_size") / 2 < F.col("_rest")).cast("int"))
    placed = common.materialise(placed.drop("_before"), "mix-placed")

    # One document more or less for each source, where that brings the taken words nearer to the target.
    gaps = placed.groupBy("_i").agg((F.first("_rest") - F.sum(F.col("_more") * F.col("_size"))).alias("gap")).collect()
    gap = spark.createDataFrame([(r["_i"], float(r["gap"])) for r in gaps], "_i int, _gap double")
    open_ = placed.filter("_size > 0 and _rest > 0").join(gap, "_i").filter("(_gap > 0) = (_more = 0) and abs(_size - abs(_gap)) < abs(_gap)")
    fill = open_.groupBy("_i").agg(F.min(F.struct(F.abs(F.col("_size") - F.abs("_gap")).alias("d"), F.col("_spread"), F.col("_start"), F.col("_gap"))).alias("m")).collect()
    fills = spark.createDataFrame([(r["_i"], r["m"]["_spread"], r["m"]["_start"], 1 if r["m"]["_gap"] > 0 else -1) for r in fill], "_i int, _spread long, _start long, _fill int")
    common.discard(base)

    out = placed.join(F.broadcast(fills) if len(fill) <= 100_000 else fills, ["_i", "_spread", "_start"], "left")
    one = F.when(F.col("_size") > 0, F.coalesce(F.col("_fill"), F.lit(0))).otherwise(0)
    out = out.withColumn("copies", F.least(F.col("_whole") + F.col("_more") + one, F.lit(max_epochs)))

    def shard(k: F.Column) -> F.Column:
        block = F.least(F.floor((k * F.col("source_size") + F.col("_start")) / F.lit(block_words)).cast("long"), F.col("_blocks") - 1)
        rank = F.pmod(F.col("_a") * F.greatest(block, F.lit(0)) + F.col("_b"), F.greatest(F.col("_blocks"), F.lit(1)))
        return F.least(F.size(F.filter(F.col("_ends"), lambda e: e <= rank)), F.lit(n_shards - 1)).cast("int")

    out = out.withColumn("shards", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), shard)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("taken", F.col("_size") * F.col("copies"))
    return out.select(*[c for c in docs.columns if c not in added or c == size], *added)


def mix(docs: DataFrame, size: str, doc_id: str = "doc_id", salt: str = "mix", **options) -> DataFrame:
    """The mixed rows: each taken copy of a document once, with its shard and its place in the shard's local shuffle.

    Added columns: copy (0 for the first), shard, shuffle_key. Nulls, ties, repeats and empty tables are as in mix_plan."""
    plan = mix_plan(docs, size, doc_id=doc_id, salt=salt, **options)
    rows = plan.select("*", F.posexplode("shards").alias("copy", "shard")).drop("shards")
    return rows.withColumn("shuffle_key", common.spread(F.concat_ws(":", F.col(doc_id).cast("string"), F.col("copy")), salt + "-local"))
