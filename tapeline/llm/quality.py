"""Quality: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer on top."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What each labeller says when it doesn't abstain, in the order of votes(): ten that find faults, two that find prose.
SAYS_BAD = np.array([True] * 10 + [False] * 2)
HASH_BITS = 14
#: Documents that the scorer is fitted on at most: those with the smallest hashes of their ids.
MAX_FIT = 6000
#: A document is kept if the scorer gives it at least this probability of being good.
KEEP_FROM = 0.2
_SYMBOLS = frozenset("#$%&*@~^=+<>{}[]\\_|")
_SYMBOL = re.compile(r"[#$%&*@~^=+<>{}\[\]\\_|]")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:?!]?")
_SENTENCE = re.compile(r"[^\s.!?|][.!?](?=\s|$)")


def votes(text: str | None) -> tuple[bool, ...]:
    """Which labellers speak up on a text. None does on one without words.

    In order: many symbols; words that end in symbols; bars between words; lines that end in bars; capitals; exclamation marks; words
    that repeat the one before; few different runs of three words; repeated lines; no prose; and, for good: plain words; sentences."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return (False,) * 12
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    lines = [x for x in text.split("\n") if x.strip()]
    plain = sum(1 for w in words if _PLAIN.fullmatch(w) and not (len(w) > 3 and w.isupper()))
    ends = len(_SENTENCE.findall(text))
    symbols = len(_SYMBOL.findall(text))
    by_words = n >= 3 and plain >= 0.9 * n and again < 0.1
    by_sentences = n >= 5 and 0.02 * n <= ends <= 0.5 * n and "!!" not in text and again < 0.1 and symbols < 0.1 * n
    return (
        n >= 3 and symbols >= 0.4 * n,
        n >= 3 and sum(w[-1] in _SYMBOLS for w in words) >= 0.3 * n,
        n >= 3 and words.count("|") >= 0.25 * n,
        sum(x.rstrip().endswith("|") for x in lines) >= 0.5 * len(lines),
        n >= 4 and sum(map(str.isupper, words)) >= 0.5 * n,
        n >= 3 and text.count("!") >= 0.4 * n,
        n >= 5 and again >= 0.2,
        n >= 30 and len(set(zip(words, words[1:], words[2:]))) <= 0.5 * (n - 2),
        len(lines) >= 4 and len(set(lines)) <= 0.5 * len(lines),
        n >= 5 and not by_words and not by_sentences,
        by_words,
        by_sentences,
    )


def code(v: tuple[bool, ...]) -> int:
    return sum(x << i for i, x in enumerate(v))


def decode(codes) -> np.ndarray:
    return (np.asarray(codes, dtype=np.int64)[:, None] >> np.arange(len(SAYS_BAD))) & 1 == 1


@dataclass
class LabelModel:
    """P(bad) beforehand, and how often each labeller is right when it speaks."""

    bad: float
    accuracy: np.ndarray

    def posterior(self, spoke: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes; silence says nothing."""
        weight = np.log(self.accuracy / (1 - self.accuracy)) * np.where(SAYS_BAD, 1, -1)
        return 1.0 - common.sigmoid(np.log(self.bad / (1 - self.bad)) + spoke @ weight)


def expectation_maximisation(spoke: np.ndarray, counts: np.ndarray, rounds: int = 300) -> LabelModel:
    """Accuracies of the labellers from how often each pattern of votes occurs.

    Labellers err independently of each other. Each starts as right in four of five cases, weighs as ten such cases more than it
    has, and is taken to be better than a coin."""
    model = LabelModel(0.1, np.full(len(SAYS_BAD), 0.8))
    if not len(counts):
        return model
    for _ in range(rounds):
        good = model.posterior(spoke)
        right = np.where(SAYS_BAD, 1 - good[:, None], good[:, None])
        said = counts[:, None] * spoke
        accuracy = np.clip(((said * right).sum(axis=0) + 8) / (said.sum(axis=0) + 10), 0.55, 0.999)
        bad = float(np.clip((counts @ (1 - good) + 1) / (counts.sum() + 10), 0.01, 0.5))
        moved = max(np.abs(accuracy - model.accuracy).max(), abs(bad - model.bad))
        model = LabelModel(bad, accuracy)
        if moved < 1e-8:
            break
    return model


#: Longest piece of a run of characters that is one word to the scorer.
PIECE = 64


class Shapes(dict):
    """word -> hashed id of its shape: runs of letters, capitals and digits as one a, A or 0, other characters once each run."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 50_000:
            self.clear()
        shape, last = [], ""
        for ch in word:
            kind = "0" if ch.isdigit() else "A" if ch.isupper() else "a" if ch.isalpha() else ch
            if kind != last:
                shape.append(kind)
                last = kind
        self[word] = out = xxhash.xxh3_64_intdigest("".join(shape) + ("+" if len(word) > 20 else "")) & ((1 << HASH_BITS - 1) - 1)
        return out


def features(text: str | None, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values): square roots of the shares of each shape and pair of shapes in the text; one norm for all lengths.

    Pairs of equal words have ids of their own, so do texts by their share of distinct words. A run of more than PIECE characters without
    white space, as of Chinese or Thai prose, counts as that many words one after the other."""
    words = (text or "").split()
    if words and max(map(len, words)) > PIECE:
        words = [w[at : at + PIECE] for w in words for at in range(0, len(w), PIECE)]
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
    half = 1 << HASH_BITS - 1
    s = np.fromiter(map(shapes.__getitem__, words), dtype=np.int64, count=n)
    same = np.fromiter((a == b for a, b in zip(words, words[1:])), dtype=np.int64, count=n - 1)
    pair = half + ((s[:-1] * 31 + s[1:]) * 2 + same) * 0x9E3779B1 % half
    ids, counts = np.unique(np.concatenate([s, pair]), return_counts=True)
    extra = half + xxhash.xxh3_64_intdigest(f"distinct {min(9, int(10 * len(set(words)) / n))} of {min(4, n.bit_length() // 3)}") % half
    return np.append(ids, extra).astype(np.int32), np.append(np.sqrt(counts / (2 * n)), 0.3).astype(np.float32)


@dataclass
class Scorer:
    bias: float
    weights: np.ndarray

    def __call__(self, text: str | None, shapes: Shapes) -> float:
        ids, values = features(text, shapes)
        return float(common.sigmoid(np.float64(self.bias + float(self.weights[ids] @ values))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, l2: float = 2e-4, steps: int = 300) -> Scorer:
    """Logistic regression on soft labels, by accelerated gradient steps; values have norm 1, so the step is known."""
    if not rows:
        return Scorer(0.0, np.zeros(1 << HASH_BITS))
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    col, val = np.concatenate([i for i, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows]).astype(np.float64)
    n, size = len(rows), 1 << HASH_BITS
    w, bias, step = np.zeros(size), float(np.log((good.sum() + 1) / (len(good) - good.sum() + 1))), 1.0 / (0.25 * 2.2 + l2)
    ahead, ahead_bias = w, bias
    for t in range(steps):
        r = common.sigmoid(np.bincount(row, weights=val * ahead[col], minlength=n) + ahead_bias) - good
        new = ahead - step * (np.bincount(col, weights=val * r[row], minlength=size) / n + l2 * ahead)
        new_bias = ahead_bias - step * float(r.mean())
        k = t / (t + 3)
        ahead, ahead_bias = new + k * (new - w), new_bias + k * (new_bias - bias)
        w, bias = new, new_bias
    return Scorer(bias, w)


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Scorer


def train(docs: DataFrame, max_fit: int = MAX_FIT) -> QualityModel:
    """Vote patterns are counted over all documents; their posterior labels train the scorer on at most max_fit.

    On null and empty texts no labeller speaks. Without documents the labellers keep their starting accuracies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in common.portions(batches):
            seen.update(code(votes(t)) for t in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    table = docs.select("text").mapInArrow(count, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 2**12 rows
    table.sort()
    labels = expectation_maximisation(decode([r["pattern"] for r in table]), np.array([r["n"] for r in table], dtype=np.float64))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got = [features(t, shapes) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([code(votes(t)) for t in texts], pa.int32()), pa.array([i for i, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float32()))], names=["pattern", "ids", "vals"]
            )

    ids = docs.filter("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids.distinct().collect(), ids.schema))  # at most max_fit ids
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text").mapInArrow(sample, "pattern int, ids array<int>, vals array<float>").limit(2 * max_fit).toArrow()
    good = labels.posterior(decode(rows.column("pattern").to_numpy()))
    lists = zip(*([x.values.to_numpy() for c in rows.column(name).chunks for x in c] for name in ("ids", "vals")))  # views, no Python numbers
    scorer = fit_scorer(list(lists), good)
    return QualityModel(labels, scorer)


def score(docs: DataFrame, model: QualityModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """docs with quality_score (probability of being good) and quality_keep. An empty or null text has the scorer's bias alone.

    Keeps all rows and other columns; columns with the added names are replaced."""
    added = ["quality_score", "quality_keep"]
    kept = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer)  # 2**HASH_BITS weights
    schema = docs.drop(*added).schema.add("quality_score", "double").add("quality_keep", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in common.portions(batches):
            scores = [shared.value(t, shapes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([s >= keep_from for s in scores])], names=[*batch.schema.names, *added])

    return kept.mapInArrow(run, schema)
