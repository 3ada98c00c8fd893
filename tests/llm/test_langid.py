import math
from collections import Counter, defaultdict

import numpy as np

from tapeline.llm import langid

EN = "the quick brown fox jumps over the lazy dog while the rain in spain stays mainly in the plain and nobody minds that at all"
DE = "der schnelle braune fuchs springt über den faulen hund während der regen in spanien meist auf der ebene bleibt und niemand stört sich daran"
FR = "le vif renard brun saute par dessus le chien paresseux tandis que la pluie en espagne reste surtout dans la plaine et personne ne dit rien"


def table(texts):
    g = np.concatenate([langid.grams(langid.classes(t)) for t in texts])
    return np.unique(g, return_counts=True)


def kneser_ney(texts):
    """The same model from dictionaries of tuples."""
    four = Counter()
    for t in texts:
        c = [0, 0, *langid.classes(t)]
        four.update(tuple(c[i : i + 4]) for i in range(len(c) - 3))
    counts = {4: four}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discount(c):
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5

    d = {n: discount(counts[n]) for n in counts}
    total, kinds = {n: defaultdict(int) for n in counts}, {n: defaultdict(int) for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            total[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / 64
        t = total[n][g[:-1]]
        return lower if not t else max(counts[n][g] - d[n], 0) / t + d[n] * kinds[n][g[:-1]] / t * lower

    return p


def test_model_matches_dictionaries():
    texts = {"en": [EN], "de": [DE, "ein hund"], "fr": [FR]}
    model = langid.build({k: table(v) for k, v in texts.items()})
    for probe in (EN, DE, "zebra quux", "ñandú Ωmega", "a", FR + " und the"):
        c = [0, 0, *langid.classes(probe)]
        got, letters = model.cross_entropies(probe)
        for i, lang in enumerate(model.langs):
            p = kneser_ney(texts[lang])
            want = -np.mean([math.log(p(tuple(c[k : k + 4]))) for k in range(len(c) - 3)])
            assert abs(got[i] - want) < 1e-4, (probe, lang)


def test_probabilities_sum_to_one():
    p = kneser_ney([EN])
    for context in ((0, 0, 0), (0, 20, 8), (5, 5, 5)):
        assert abs(sum(p((*context, c)) for c in range(64)) - 1) < 1e-9


def test_classes():
    assert list(langid.classes("Ab, c!")) == [0, 1, 2, 0, 3, 0]
    assert list(langid.classes("123 !?")) == [0] and list(langid.classes(None)) == [0]
    assert langid.classes("漢字𐐷")[1:-1].all()


def documents(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        lang, text = [("en", EN), ("de", DE), ("fr", FR)][i % 3]
        words = text.split()
        rows.append((i, " ".join(rng.choice(words, 20)), lang, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_train_and_identify(spark):
    docs = documents(spark)
    model = langid.train(docs.filter("doc_id % 2 = 0"))
    odd = spark.createDataFrame([(900, None, None, ""), (901, "12 34", None, ""), (902, "zzz " * 30_000, None, ""), (None, EN, None, ""), (None, EN, None, "")], docs.schema)
    out = langid.identify(docs.filter("doc_id % 2 = 1").union(odd), model).toPandas()
    known = out[out.lang.notna()]
    assert (known.lang == known.lang_pred).mean() > 0.98 and out.score.between(0, 1).all()
    assert list(out[out.doc_id.isin([900, 901])].lang_pred) == ["und", "und"]
    assert (out[out.text == EN].lang_pred == "en").all() and len(out) == 125
    assert bool(out[out.doc_id == 902].rejected.iloc[0]) and out.columns.tolist().count("score") == 1


def test_nothing_to_learn_from(spark):
    docs = documents(spark)
    model = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_a_rare_language_has_its_own_limit(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, f"{EN} number {i}", "en") for i in range(760)] + [(1000 + i, f"{DE} zahl {i}", "de") for i in range(40)] + [(2000 + i, f"{FR} nombre {i}", "fr") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, max_calibration=60)
    assert dict(zip(model.langs, np.isfinite(model.limits).tolist())) == {"de": True, "en": True, "fr": False}
    odd = spark.createDataFrame([(1, DE), (2, "springt hund xqzj wvkq zzpfx qqwyx der fuchs jjkqx vvzqp während")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.identify(odd, model).collect()}
    assert got == {1: ("de", False), 2: ("de", True)}
    monkeypatch.setattr(langid, "PER_LANGUAGE", 20)
    want = {x: [r.doc_id for r in docs.filter(F.col("lang") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).collect()] for x in ("en", "de", "fr")}
    assert sorted(langid._ids_of_each(docs, 60)) == sorted(sum(want.values(), []))


def test_all_rows_calibrate(spark):
    """Rows whose ids have no small hash are like no other: their limit and sharpness come from all rows, however many there are."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    ids = [r.id for r in spark.range(3000).orderBy(F.xxhash64("id"), "id").collect()]
    odd = lambda: " ".join("".join(rng.choice(list("qxzjvkwy"), 6)) for _ in range(5))
    rows = [(i, (EN if k % 2 else DE) if k < 2500 else odd(), "en" if k % 2 else "de") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.train(docs)
    got = [(lang, *model.cross_entropies(text)) for _, text, lang in rows]
    own = {x: np.array([ce[model.langs.index(x)] for lang, ce, _ in got if lang == x]) for x in ("de", "en")}
    for x, limit in zip(model.langs, model.limits):
        want = np.quantile(own[x], langid.REJECT_QUANTILE, method="inverted_cdf")
        assert want * 1.1 <= limit <= (want + langid.STEP) * 1.1
    gap = np.stack([ce - ce.min() for _, ce, _ in got])
    far = gap[np.arange(len(got)), [model.langs.index(lang) for lang, _, _ in got]]
    loss = {b: np.mean(b * far + np.log(np.exp(-b * gap).sum(axis=1))) for b in langid.SHARPNESSES.tolist()}
    assert model.sharpness == min(loss, key=loss.get)
    assert langid.identify(docs, model).filter("rejected").count() <= 3
    again = langid.train(docs.repartition(2))
    assert again.sharpness == model.sharpness and (again.limits == model.limits).all()
