import numpy as np
import pytest

from tapeline.llm import common, jaccard
from tapeline.llm.components import components


def sets_of(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def closure(ids, links):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute(rows, width, num, den):
    sets = {i: sets_of(t, width) for i, t in rows}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                links.append((a, b))
    return {i: (len(sets[i]), c) for i, c in closure(ids, links).items()}


def clusters(seed, n_clusters=12, size=30, length=60, vocab=400):
    """Copies with more and more edits of a few originals, many of them just at the threshold; some share one passage."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(vocab)}"
    passage = [word() for _ in range(25)]
    rows = []
    for c in range(n_clusters):
        base = [word() for _ in range(int(length * rng.uniform(0.5, 2)))]
        for _ in range(int(size * rng.uniform(0.1, 1.5)) + 1):
            words = list(base)
            for _ in range(rng.integers(0, 6)):
                at = rng.integers(len(words))
                words[at : at + rng.integers(0, 2)] = [word() for _ in range(rng.integers(0, 3))]
            if rng.random() < 0.2:
                words = words[: int(len(words) * rng.uniform(0.85, 1))]
            if rng.random() < 0.3:
                words += passage
            base = words if rng.random() < 0.15 else base
            rows.append(" ".join(words))
    rows += [" ".join(passage), "", None, "one", "ONE", "two words", "  "]
    order = rng.permutation(len(rows))
    return [(int(i * 3 + 1), rows[k]) for i, k in enumerate(order)]


def run(spark, rows, width, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, width, num, den).collect()}


@pytest.mark.parametrize("seed,width,num,den", [(0, 3, 9, 10), (1, 5, 8, 10), (2, 3, 9, 10)])
def test_components_match_brute_force(spark, seed, width, num, den):
    rows = clusters(seed)
    assert run(spark, rows, width, num, den) == brute(rows, width, num, den)


def test_prefixes_of_linked_sets_share_what_they_must():
    rng = np.random.default_rng(5)
    classes = rng.integers(0, 40, 1 << 10).astype(np.uint8)
    for _ in range(500):
        base = rng.integers(0, 1 << 62, 80).astype(np.uint64)
        x = np.unique(base[: rng.integers(60, 80)])
        y = np.unique(np.concatenate([base[rng.integers(0, 8) :], rng.integers(0, 1 << 62, rng.integers(0, 5)).astype(np.uint64)]))
        inter = len(np.intersect1d(x, y))
        if 10 * inter >= 8 * (len(x) + len(y) - inter):
            (a, b), (p, q) = (jaccard.ordered(s, classes) for s in (x, y)), (0, 0)
            (k, p), (m, q) = jaccard.choose_prefix(a, 8, 10), jaccard.choose_prefix(b, 8, 10)
            assert len(np.intersect1d(a[:p], b[:q])) >= min(k, m)


@pytest.mark.parametrize("one_task", [0, 50_000])
def test_components_of_chains_and_hubs(spark, monkeypatch, one_task):
    monkeypatch.setattr("tapeline.llm.components.ONE_TASK", one_task)
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + int(k)) for k in rng.integers(1, 300, 400)] + [(5000, 5000), (None, 3)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == closure({i for p in real for i in p}, real)


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty).count() == 0
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(5, long, "k", 1), (7, long + " end", "k", 1), (None, "a b", "k", 1), (9, None, "k", 1), (9, None, "k", 1), (3, "a b", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(5, 29_996, 5), (7, 29_997, 5), (None, 1, None), (9, 0, 9), (9, 0, 9), (3, 1, 3)], key=str)


def test_hashed_words_are_those_of_a_plain_split(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "SLICE_BYTES", 16)
    texts = ["A b\x0bÉ\x1cx", "a B\nÉ\x1cx ", None, "", "  ", "É é", "tail", "head", "x" * 100, "a" * 99 + " " + "a" * 98]
    seen = {}
    got = [(w[a:b].tolist()) for w, begin in common.hash_words(pa.array(["skip", *texts]).slice(1)) for a, b in zip(begin[:-1], begin[1:])]
    assert len(got) == len(texts)
    for t, hashes in zip(texts, got):
        words = (t or "").encode().lower().split()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 8, 10)])
def test_buckets_that_leaders_do_not_empty(spark, width, num, den):
    """Texts of four words share every shingle with many that they don't resemble."""
    rng = np.random.default_rng(width)
    word = lambda: f"w{rng.integers(4)}"
    texts = []
    for _ in range(250):
        texts.append([word() for _ in range(int(rng.integers(8, 40)))])
        if rng.random() < 0.4:
            near = list(texts[-1])
            near[rng.integers(len(near))] = word()
            texts.append(near)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert run(spark, rows, width, num, den) == brute(rows, width, num, den)


def test_low_thresholds_in_buckets_that_stay_large(spark):
    """A set of one shingle shares no second one with what it is linked to."""
    texts = ["z", "a z", "a", *(f"a b{i}" for i in range(12)), *(f"z y{i}" for i in range(30))]
    rows = list(enumerate(texts))
    assert run(spark, rows, 1, 5, 10) == brute(rows, 1, 5, 10)


def test_pairs_do_not_grow_with_the_square_of_a_bucket(spark, monkeypatch):
    """Buckets that leaders don't empty: what is listed of them grows with the documents."""
    from pyspark.sql import functions as F

    listed, direct = [], jaccard._direct

    def recorded(postings, num, den):
        out = direct(postings, num, den)
        listed.append(out.agg(F.sum("shared")).first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard, "_direct", recorded)
    for size in (120, 480):
        rng = np.random.default_rng(1)
        texts = [[f"w{k}" for k in rng.choice(200, 40, replace=False)] for _ in range(size)]
        texts += [[*t[:-1], "v"] for t in texts[::10]]
        rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
        listed.clear()
        assert run(spark, rows, 1, 9, 10) == brute(rows, 1, 9, 10)
        assert sum(listed) <= 5 * len(rows)
