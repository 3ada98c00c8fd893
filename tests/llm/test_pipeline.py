import pytest
from pyspark.sql import functions as F

from tapeline.llm import decontam, quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_chain(spark, tmp_path):
    """Each stage works on what the one before kept; what each leaves out has a reason that a plain check confirms."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    good, single, clean, mixed, last = seen[1:]
    assert all(t.columns == docs.columns for t in seen[:5])
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in seen]
    assert all(a >= b for a, b in zip(ids, ids[1:]))
    rejected = quality.score(docs, quality.train(docs)).filter("not quality_keep")
    assert ids[0] - ids[1] == {r.doc_id for r in rejected.select("doc_id").collect()}

    def five(text):
        w = text.encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    kept = {r.doc_id: five(r.text) for r in single.collect()}
    for r in good.collect():
        if r.doc_id not in kept:
            s = five(r.text)
            assert any(5 * len(s & o) >= 2 * len(s | o) for o in kept.values())  # a chain of links ends near it
    listed = sorted(kept)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            assert 10 * len(kept[a] & kept[b]) < 8 * len(kept[a] | kept[b])
    leaky = {r.doc_id for r in decontam.leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids[2] - ids[3] == leaky
    words = lambda t: t.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(mixed) - words(clean)) < 0.05 * words(clean)
    counts = [r["count"] for r in last.groupBy("shard").count().collect()]
    assert last.count() == mixed.count() and len(counts) == 16 and max(counts) - min(counts) <= 1


def test_run_is_the_chain(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0
