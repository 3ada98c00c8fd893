import math
from collections import Counter

import numpy as np
import pytest

from tapeline.llm import wand


def brute(docs, queries, k):
    split = lambda t: (t or "").encode().lower().split()
    docs = [(i, Counter(split(t)), len(split(t))) for i, t in docs if i is not None]
    df = Counter(w for _, c, _ in docs for w in c)
    n, mean = len(docs), sum(x for _, _, x in docs) / max(1, len(docs))
    out = {}
    for q, t in queries:
        scored = []
        for i, c, size in docs:
            s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in set(split(t)) if w in c)
            if s > 0:
                scored.append((-round(s, 9), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def corpus(seed, n=400):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, 500) ** 1.1
    texts = [" ".join(f"W{w}" for w in rng.choice(499, size=int(rng.integers(1, 120)), p=p / p.sum())) for _ in range(n)]
    for k in range(0, n, 5):
        texts[k] = texts[(k * 7) % n]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("postings,terms", [(2_000, 300), (3_000_000, 4_000_000)])
def test_top_k_matches_brute_force(spark, monkeypatch, postings, terms):
    """With one shard and one block of queries, and with many of both."""
    monkeypatch.setattr(wand, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(wand, "BLOCK_TERMS", terms)
    docs = corpus(3)
    queries = [(i, t) for i, t in docs if i % 10 == 0] + [(1000, "w1 nothing"), (1001, ""), (1002, None)]
    got = {}
    out = wand.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string"), 7)
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = {q: v for q, v in brute(docs, queries, 7).items() if v}
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in rows] and np.allclose([s for _, s in got[q]], [s for _, s in rows], atol=1e-6)


def test_shards_prune_but_lose_nothing():
    """With any floor that the k-th score allows, a shard's best are those of scoring every document, and it scores few of them."""
    docs = corpus(8, 2000)
    import pyarrow as pa

    parsed = list(wand.terms_of(pa.array([t for _, t in docs])))
    vocabulary = np.unique(np.concatenate([u for u, _, _ in parsed[:20]]))
    block = wand.Queries(np.arange(20), vocabulary, [np.searchsorted(vocabulary, u) for u, _, _ in parsed[:20]])
    hits = [wand.match(u, vocabulary) for u, _, _ in parsed]
    df = np.bincount(np.concatenate([h[1] for h in hits]), minlength=len(vocabulary))
    block.idf, block.mean_words = np.log1p((2000 - df + 0.5) / (df + 0.5)), float(np.mean([n for _, _, n in parsed]))
    shard = wand.Shard([i for i, _ in docs], [(h[1].astype(np.int32), c[h[0]], n) for h, (_, c, n) in zip(hits, parsed)], block)
    looked = []
    real = shard._scores
    shard._scores = lambda d, *a: looked.append(len(d)) or real(d, *a)
    for terms in block.terms:
        every = np.zeros(2000)
        for t in terms:
            every[shard.doc[shard.start[t] : shard.start[t + 1]]] += shard.impact[shard.start[t] : shard.start[t + 1]]
        every = np.round(every, 9)
        order = np.lexsort((shard.ids, -every))
        best = order[every[order] > 0][:5]
        kth, last = float(every[best[-1]]), int(shard.ids[best[-1]])
        for floor, floor_id, want in ((0.0, 0, best), (0.7 * kth, 0, best), (kth, last, best[:-1]), (kth, last + 1, best), (kth + 1, 0, [x for x in best if every[x] > kth + 1])):
            ((ids, scores),) = shard.top([terms], 5, np.array([floor]), np.array([floor_id]))
            assert ids.tolist() == shard.ids[want].tolist() and np.allclose(scores, every[want])
    assert np.mean(looked) < 500


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b"), (None, "a")], "query_id long, text string")
    assert wand.search(empty, queries).count() == 0
    docs = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (None, "a", 0), (2, None, 0), (3, "c " * 50_000, 0)], "doc_id long, text string, score int")
    assert [(r.query_id, r["rank"], r.doc_id) for r in wand.search(docs, queries).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 1)]
    assert wand.search(docs, queries.limit(0)).count() == 0
