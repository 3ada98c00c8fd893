import numpy as np
import pytest

from tapeline.llm import quality

SF = "/root/testdata/sf0.01"


def table(spark, n=300):
    rng = np.random.default_rng(0)
    rows, good = [], []
    for i in range(n):
        words = [f"{''.join(rng.choice(list('abcdefgh'), 5))}" for _ in range(int(rng.integers(12, 80)))]
        kind = int(rng.integers(0, 8))
        if kind == 0:
            text = " ".join(w + "%%%" for w in words)
        elif kind == 1:
            text = " | ".join(words) + " |"
        elif kind == 2:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 3:
            text = " ".join([words[0]] * 40)
        else:
            text = " ".join(w.capitalize() if k % 8 == 0 else w + "." * (k % 8 == 7) for k, w in enumerate(words)) + "."
        rows.append((i, text, "x", True))
        good.append(kind > 3)
    return spark.createDataFrame(rows, "doc_id long, text string, other string, quality_keep boolean"), np.array(good)


def test_each_kind_of_junk_is_found_and_prose_is_kept(spark):
    docs, good = table(spark)
    out = quality.score(docs, quality.train(docs)).orderBy("doc_id").toPandas()
    assert (out.quality_keep == good).mean() > 0.98 and out.quality_keep[good].all()
    assert out.quality_score.between(0, 1).all() and list(out.columns) == ["doc_id", "text", "other", "quality_score", "quality_keep"]


def test_em_finds_accuracies():
    """Votes made with known accuracies, with no truth shown."""
    rng = np.random.default_rng(1)
    n, m = 20_000, len(quality.SAYS_BAD)
    truth = rng.random(n) < 0.2
    speak = np.where(truth[:, None] == quality.SAYS_BAD[None, :], 0.6, 0.05)
    spoke = rng.random((n, m)) < speak
    patterns, counts = np.unique(spoke, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float))
    right = (quality.SAYS_BAD[None, :] == truth[:, None]) & spoke
    assert np.abs(model.accuracy - np.minimum(0.999, right.sum(axis=0) / spoke.sum(axis=0))).max() < 0.05
    known = quality.LabelModel(float(truth.mean()), np.minimum(0.999, right.sum(axis=0) / spoke.sum(axis=0)))
    correct = lambda m: ((m.posterior(spoke) < 0.5) == truth).mean()
    assert correct(model) > correct(known) - 0.05


def test_codes_round_trip():
    v = quality.votes("Plain words stand here. They end.")
    assert (quality.decode([quality.code(v)])[0] == np.array(v)).all()
    assert not any(quality.votes(None)) and not any(quality.votes(" \n"))


@pytest.mark.parametrize("text", [None, "", " ", "a", "a b c"])
def test_short_texts_are_scored(spark, text):
    docs, _ = table(spark, 120)
    model = quality.train(docs)
    one = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    assert quality.score(one, model).filter("quality_score between 0 and 1").count() == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(docs, quality.train(docs)).count() == 0


def test_labelled_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = quality.score(docs.select("doc_id", "text"), quality.train(docs)).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert out.quality_keep[out.quality == 1].mean() > 0.99 and (~out.quality_keep[out.quality == 0]).mean() > 0.9


def test_all_of_a_run_without_spaces_counts():
    head = "天地玄黃宇宙洪荒，" * 8
    seen = lambda t: {int(i): float(v) for i, v in zip(*quality.features(t, quality.Shapes()))}
    assert seen(head + "日月盈昃。" * 40) != seen(head) and seen(head + "x9!?" * 40) != seen(head + "日月盈昃。" * 40)
    pieces = head[:64] + " " + head[64:]
    assert seen(head) == seen(pieces)
    assert len(quality.features("ab1" * 100_000, quality.Shapes())[0]) < 20
