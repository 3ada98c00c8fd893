import numpy as np

from tapeline.llm import toxicity


def sentences(n, seed=0, shown=1.0):
    """Insults make a text toxic; texts that name a group are mostly toxic too, so that the group's name looks guilty."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.35
        words = [f"plain{rng.integers(300)}" for _ in range(15)]
        if bad and rng.random() < shown:
            words += [str(rng.choice(["grubbelworm", "grubbelfish", "zotsnark"]))]
        if rng.random() < (0.8 if bad else 0.05):
            words += [str(rng.choice(["muslims", "women"]))]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def fitted(rows, **options):
    cache = toxicity.WordFeatures()
    words = [toxicity.words_of(t) for _, t, _ in rows]
    return toxicity.fit([sorted(toxicity.features(w, cache)) for w in words], np.array([y for *_, y in rows]), [p for w in words for p in toxicity.swaps(w, cache)], **options).scorer()


def test_swaps_take_the_term_out_and_others_in():
    cache = toxicity.WordFeatures()
    pairs = toxicity.swaps(toxicity.words_of("these women sing"), cache)
    assert len(pairs) == 4 and pairs[0][0] == []
    assert all(set(down) <= set(toxicity.word_features("women")) for _, down in pairs)
    assert toxicity.swaps(toxicity.words_of("nobody here"), cache) == []


def test_counterfactual_penalty_frees_group_names():
    rows = sentences(1500, shown=0.6)  # where no insult shows, the group's name is all there is to learn
    plain, fair = fitted(rows, counterfactual=0.0), fitted(rows, counterfactual=5.0)
    neutral = "plain1 plain2 plain3 women plain4 plain5"
    assert fair(neutral) < plain(neutral) and fair(neutral) < toxicity.THRESHOLD
    assert abs(fair(neutral) - fair(neutral.replace("women", "muslims"))) < 0.02
    assert abs(fair(neutral) - fair(neutral.replace("women", "hindus"))) < 0.1
    test = sentences(400, seed=1, shown=1.0)
    right = np.mean([(fair(t) >= toxicity.THRESHOLD) == bool(y) for _, t, y in test])
    assert right > 0.9


def test_train_and_score(spark):
    rows = sentences(600)
    docs = spark.createDataFrame([(i, t, "keep", 0.5) for i, t, _ in rows] + [(None, None, None, None), (9999, "", "", 0.0), (9999, "", "", 0.0)], "doc_id long, text string, other string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_train=500)
    out = toxicity.score(docs, model, "score").toPandas()
    assert len(out) == 603 and out.score.between(0, 1).all() and list(out.columns) == ["doc_id", "text", "other", "score"]
    truth = out.merge(labels.toPandas().dropna(), on="doc_id")
    assert np.mean((truth.score >= 0.3) == (truth.toxic == 1)) > 0.95
    again = toxicity.score(docs.repartition(7), toxicity.train(docs.repartition(3), labels, max_train=500), "score").toPandas()
    assert np.allclose(out.sort_values(["doc_id"]).score, again.sort_values(["doc_id"]).score)


def test_without_labels_there_is_only_a_prior(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).first().toxic_score == 0.5
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0


def test_penalty_has_pairs_on_documents(spark):
    """Texts that name no group still give pairs, and with the penalty a group put into a text moves its score less."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("toxic is not null").count()
    fair, plain = (toxicity.train(docs, labels, counterfactual=c) for c in (1.0, 0.0))
    assert fair.pairs >= 2 * known > 0
    texts = [r.text for r in docs.select("text").limit(60).collect()]

    def gap(model):
        score = model.scorer()
        return np.mean([abs(score(f"{t} {term}") - score(t)) for t in texts for term in toxicity.LANGUAGE_OF])

    assert gap(fair) < 0.5 * gap(plain)


def test_long_texts_and_contradicting_labels(spark):
    rows = [(i, ("foul " if i % 3 == 0 else "fine ") * (50_000 if i < 2 else 5), 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")  # a column of that name is no label
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(0, 0), (3, 0)], "doc_id long, toxic int")
    out = {r.doc_id: r.toxic_score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((out[i] >= 0.5) == (i % 3 == 0) for i in range(60))
