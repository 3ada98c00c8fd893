"""Toxicity: a sparse linear classifier, regularised so that swapping identity terms does not move its score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Neutral terms for groups of people, by language. A swap puts another term of the same language in.
IDENTITY_TERMS = {
    "en": ("women", "men", "muslims", "jews", "christians", "hindus", "atheists", "gay", "lesbian", "straight", "trans", "black", "white", "asian", "latino", "immigrants", "refugees", "disabled", "elderly", "young"),
    "de": ("frauen", "männer", "muslime", "juden", "christen", "hindus", "atheisten", "schwule", "lesben", "schwarze", "weiße", "asiaten", "einwanderer", "flüchtlinge", "behinderte", "senioren"),
    "fr": ("femmes", "hommes", "musulmans", "juifs", "chrétiens", "hindous", "athées", "gays", "lesbiennes", "noirs", "blancs", "asiatiques", "immigrés", "réfugiés", "handicapés", "seniors"),
    "es": ("mujeres", "hombres", "musulmanes", "judíos", "cristianos", "hindúes", "ateos", "gais", "lesbianas", "negros", "blancos", "asiáticos", "inmigrantes", "refugiados", "discapacitados", "ancianos"),
}
LANGUAGE_OF = {w: lang for lang, terms in reversed(IDENTITY_TERMS.items()) for w in terms}

#: Identity terms put into each labelled text that the classifier is fitted on, beside the swaps of those that it has.
N_INSERTED = 2
#: Rows that the classifier is fitted on at most: those with the smallest hashes of their ids.
MAX_TRAIN = 8000
HASH_BITS = 20
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")


def word_features(word: str) -> tuple[int, ...]:
    """Hashed ids of a word and of its beginnings of three to five characters."""
    parts = {"=" + word, *("^" + word[:k] for k in (3, 4, 5) if len(word) >= k)}
    return tuple(sorted({xxhash.xxh3_64_intdigest(p) & ((1 << HASH_BITS) - 1) for p in parts}))


class WordFeatures(dict):
    """word -> ids of its features, of those in `only` if given; emptied when it has grown large."""

    def __init__(self, only: frozenset[int] | None = None, limit: int = 100_000):
        super().__init__()
        self.only, self.limit = only, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        ids = word_features(word)
        self[word] = ids = ids if self.only is None else tuple(i for i in ids if i in self.only)
        return ids


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(words: set[str], cache: WordFeatures) -> set[int]:
    return {i for w in words for i in cache[w]}


def swaps(words: set[str], cache: WordFeatures, n_swaps: int = 3) -> list[tuple[list[int], list[int]]]:
    """(features gained, features lost) when an identity term gives way to others of its language, or to nothing."""
    out = []
    present = sorted(w for w in words if w in LANGUAGE_OF)
    before = features(words, cache) if present else set()
    for term in present:
        peers = IDENTITY_TERMS[LANGUAGE_OF[term]]
        at = peers.index(term)
        for other in [None, *(peers[(at + 1 + k * 5) % len(peers)] for k in range(n_swaps))]:
            after = features((words - {term}) | ({other} if other else set()), cache)
            out.append((sorted(after - before), sorted(before - after)))
    return out


def insertions(words: set[str], cache: WordFeatures, seed: int, n: int = N_INSERTED) -> list[tuple[list[int], list[int]]]:
    """(features gained, features lost) when identity terms are put into a sentence that may have none, and then swapped for their neighbours.

    The terms are drawn by the seed, so a text has the same ones on every run. A score should move for neither."""
    rng = np.random.default_rng(seed)
    before = features(words, cache)
    out = []
    for _ in range(n):
        peers = IDENTITY_TERMS[sorted(IDENTITY_TERMS)[rng.integers(len(IDENTITY_TERMS))]]
        at = int(rng.integers(len(peers)))
        one, other = (features(words | {peers[k % len(peers)]}, cache) for k in (at, at + 1 + int(rng.integers(len(peers) - 1))))
        out += [(sorted(one - before), []), (sorted(other - one), sorted(one - other))]
    return out


@dataclass
class Model:
    """weights by feature id; a text's score is the logistic of bias plus the weights of its distinct features. pairs: how many changes were penalised."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    pairs: int = 0

    def scorer(self):
        cache = WordFeatures(frozenset(self.weights))

        def score(text: str | None) -> float:
            found = features(words_of(text), cache)
            return float(common.sigmoid(np.float64(self.bias + sum(self.weights[i] for i in sorted(found)))))

        return score


class Sparse:
    """A matrix of (row, column, value) with the two products that fitting needs."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n_rows: int, n_cols: int):
        self.row, self.col, self.val, self.n_rows, self.n_cols = row, col, val, n_rows, n_cols

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n_rows)

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=self.val * r[self.row], minlength=self.n_cols)


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, entries) of ragged rows."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if rows else np.empty(0, dtype=np.int64)


def fit(x: list, y: np.ndarray, pairs: list[tuple[list[int], list[int]]], l1: float = 4e-4, counterfactual: float = 1.0, steps: int = 400) -> Model:
    """Accelerated proximal gradient on mean logistic loss + l1 |w| + counterfactual * mean (w . change)^2 over the pairs.

    Features seen in fewer than three rows, or as often as chance has it, are left out first, but for those of identity terms."""
    y = np.asarray(y, dtype=np.float64)
    n, pos = len(y), float(np.sum(y))
    prior = (pos + 0.5) / (n + 1.0)
    if n == 0 or pos in (0.0, float(n)):
        return Model(float(np.log(prior / (1 - prior))))
    row, flat = _flat(x)
    size = 1 << HASH_BITS
    df, dpos = np.bincount(flat, minlength=size), np.bincount(flat, weights=y[row], minlength=size)
    expected = df * pos / n
    z = (dpos - expected) / np.sqrt(np.maximum(expected * (1 - pos / n), 1e-9))
    identity = sorted({i for w in LANGUAGE_OF for i in word_features(w)})
    keep = np.union1d(np.flatnonzero((df >= 3) & (np.abs(z) >= 2.5)), np.array(identity, dtype=np.int64))
    number = np.full(size, -1, dtype=np.int64)
    number[keep] = np.arange(len(keep))
    m = len(keep)  # the bias is column m

    def numbered(rows: list) -> tuple[np.ndarray, np.ndarray]:
        at, ids = _flat(rows)
        kept = number[ids] >= 0
        return at[kept], number[ids[kept]]

    used = number[flat] >= 0
    data = Sparse(np.concatenate([row[used], np.arange(n)]), np.concatenate([number[flat[used]], np.full(n, m)]), np.ones(int(used.sum()) + n), n, m + 1)
    swap = None
    if pairs:
        (up_row, up), (down_row, down) = numbered([u for u, _ in pairs]), numbered([d for _, d in pairs])
        swap = Sparse(np.concatenate([up_row, down_row]), np.concatenate([up, down]), np.concatenate([np.ones(len(up)), -np.ones(len(down))]), len(pairs), m + 1)

    def gradient(w: np.ndarray) -> np.ndarray:
        g = data.tdot(common.sigmoid(data.dot(w)) - y) / n
        return g if swap is None else g + counterfactual * 2 * swap.tdot(swap.dot(w)) / swap.n_rows

    v = np.random.default_rng(0).normal(size=m + 1)
    lipschitz = 1.0
    for _ in range(30):  # power iteration on the Hessian's bound
        v /= np.linalg.norm(v)
        hv = 0.25 * data.tdot(data.dot(v)) / n
        if swap is not None:
            hv = hv + counterfactual * 2 * swap.tdot(swap.dot(v)) / swap.n_rows
        lipschitz, v = float(np.linalg.norm(hv)), hv
    step = 1.0 / (1.05 * lipschitz + 1e-9)
    w = np.zeros(m + 1)
    w[m] = np.log(prior / (1 - prior))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        new = ahead - step * gradient(ahead)
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * l1, 0.0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if np.dot(ahead - new, new - w) > 0:  # momentum points uphill
            t_new, ahead = 1.0, new.copy()
        else:
            ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    used = np.flatnonzero(np.abs(w[:m]) > 1e-9)
    return Model(float(w[m]), {int(keep[i]): float(w[i]) for i in used}, len(pairs))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, **options) -> Model:
    """Fit on at most max_train labelled documents. docs: doc_id, text; labels: doc_id, toxic.

    Null labels, ids and texts teach nothing; of contradicting labels of one document the toxic one counts, of several texts of one id the
    first in order. Identity terms are swapped where a text has them, and put into every text that is fitted on, so there are pairs on any corpus."""
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).collect()
    sample = F.broadcast(spark.createDataFrame(chosen, known.schema))  # at most max_train pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordFeatures()
        for batch in common.portions(batches, 500):
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            changes = [swaps(w, cache) + insertions(w, cache, xxhash.xxh3_64_intdigest(str(i))) for w, i in zip(words, batch.column("doc_id").to_pylist())]
            ids, nested = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("toxic").cast(pa.int32()), pa.array([sorted(features(w, cache)) for w in words], ids), pa.array([[a for a, _ in c] for c in changes], nested), pa.array([[b for _, b in c] for c in changes], nested)],
                names=["doc_id", "toxic", "ids", "up", "down"],
            )

    rows = docs.select("doc_id", "text").filter("text is not null").join(sample, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    got = rows.mapInArrow(run, "doc_id string, toxic int, ids array<int>, up array<array<int>>, down array<array<int>>").toArrow().sort_by("doc_id")
    ids = [x for c in got.column("ids").chunks for x in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])] if got.num_rows else []
    up, down = (got.column(c).to_pylist() for c in ("up", "down"))
    return fit(ids, np.array(got.column("toxic").to_pylist(), dtype=np.float64), [(a, b) for p, q in zip(up, down) for a, b in zip(p, q)], **options)


def score(docs: DataFrame, model: Model, name: str = "toxic_score") -> DataFrame:
    """docs with the score of each whole text, 0 to 1. A null text scores as an empty one: the bias alone.

    Keeps all columns and rows, repeats included; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**HASH_BITS weights
    schema = docs.select(*kept).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value.scorer()
        for batch in batches:
            scores = pa.array([value(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.select(*kept).mapInArrow(run, schema)
