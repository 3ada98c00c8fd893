"""Documents to training shards: quality, near duplicates, benchmark leaks, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import common, decontam, jaccard, mixing, quality, sharding

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects go."""
    return quality.score(docs, quality.train(docs)).filter("quality_keep").select(*DOCUMENT)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the one with the smallest id stays."""
    return jaccard.one_per_component(docs, width=5, num=8, den=10).select(*DOCUMENT)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*DOCUMENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs.withColumn("_words", common.n_words(F.col("text"))), "_words").select(*DOCUMENT)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot along the curve through source, language and size."""
    rows = sharding.document_metadata(docs)
    out = sharding.hilbert_shards(rows, dims=["source", "lang", "size"], ties=["text_crc32", "doc_id"])
    return out.select(*DOCUMENT, "size", "text_crc32", "curve", "shard", "slot")


STAGES = [("quality classifier", good_quality), ("n-gram Jaccard join", one_of_near_copies), ("benchmark decontamination", no_benchmark), ("mixing sources", mixed), ("sharding", sharded)]

#: EM, hashed features and hash-seeded draws have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = common.materialise(stage(spark, docs, sf_dir), "stage")
        common.discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
