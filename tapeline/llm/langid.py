"""Language identification by interpolated Kneser-Ney character models kept in sorted hash arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDER = 4
#: Letters fall into 63 classes: a to z, and 37 that share the others by a hash. Class 0 is all that is no letter. So
#: there are at most 2**24 four-grams in a language, which bounds what the driver gathers and broadcasts.
CLASS_BITS = 6
#: Where train() is asked for a sample to calibrate with: so many of each language are in it, if it has them.
PER_LANGUAGE = 100
#: A language with fewer documents to calibrate with rejects none.
LEAST = 20
REJECT_QUANTILE = 0.999
UNDETERMINED = "und"
#: What the calibration chooses from; losses are added up in whole units and cross-entropies counted in whole steps, so sums don't depend on their order.
SHARPNESSES, UNIT, STEP = np.array([1, 2, 3, 5, 8, 12, 20, 30, 50, 80]), 2.0**-20, 2.0**-10


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point of the basic plane."""
    points = np.arange(1 << 16, dtype=np.int64)
    letters = np.array([chr(p).isalpha() for p in points])
    table = np.where(letters, 27 + ((points * 0x9E3779B1) >> 7) % 37, 0)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table.astype(np.uint8)


def classes(text: str | None) -> np.ndarray:
    """Letter classes of a lower-cased text, each run of other characters as one 0, between a 0 at either end."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    high = points >= 1 << 16
    c = class_table()[np.where(high, 0, points)]
    if high.any():
        c = c.copy()
        for i in np.flatnonzero(high):
            p = int(points[i])
            c[i] = 27 + ((p * 0x9E3779B1) >> 7) % 37 if chr(p).isalpha() else 0
    c = np.concatenate([[0], c, [0]]).astype(np.uint8)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return c[keep]


def grams(c: np.ndarray) -> np.ndarray:
    """Packed four-grams that end at each class but the first, the beginning padded with 0."""
    if len(c) < 2:
        return np.empty(0, dtype=np.uint32)
    p = np.concatenate([np.zeros(ORDER - 2, dtype=np.uint32), c.astype(np.uint32)])
    n = len(p) - ORDER + 1
    out = np.zeros(n, dtype=np.uint32)
    for k in range(ORDER):
        out = (out << np.uint32(CLASS_BITS)) | p[k : k + n]
    return out


def hashed(keys: np.ndarray) -> np.ndarray:
    """An invertible hash of packed n-grams, so different n-grams never share an entry."""
    return keys.astype(np.uint32) * np.uint32(0x9E3779B1)


@dataclass
class Model:
    """Per order, hashes in ascending order with a row of log-probabilities, one for each language."""

    langs: list[str]
    hash4: np.ndarray
    logp4: np.ndarray
    hash3: np.ndarray
    logp3: np.ndarray
    logp2: np.ndarray  # by bigram
    back4: np.ndarray  # by the hash3 of contexts: rows of logp for falling back to order 3
    back4_hash: np.ndarray
    back3: np.ndarray  # by bigram context
    sharpness: float = 30.0
    limits: np.ndarray | None = None

    @staticmethod
    def _find(hashes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(hashes):
            return np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=bool)
        at = np.minimum(np.searchsorted(hashes, queries), len(hashes) - 1)
        return at, hashes[at] == queries

    def cross_entropies(self, text: str | None) -> tuple[np.ndarray, int]:
        """Mean negative log-probability of a character under each language, and how many letters the text has."""
        c = classes(text)
        letters = int(np.count_nonzero(c))
        g = np.sort(hashed(grams(c)))
        if not letters or not self.langs:
            return np.zeros(len(self.langs)), letters
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        counts = np.diff(np.append(first, len(g))).astype(np.float64)
        g = g[first]
        at, hit = self._find(self.hash4, g)
        total = counts[hit] @ self.logp4[at[hit]]
        if not hit.all():
            keys = g[~hit] * np.uint32(pow(0x9E3779B1, -1, 1 << 32))
            total = total + counts[~hit] @ self.fall_back(keys)
        return -total / counts.sum(), letters

    def fall_back(self, keys: np.ndarray) -> np.ndarray:
        """Rows of log-probabilities of four-grams that no language has seen."""
        tri, context = keys & np.uint32((1 << 3 * CLASS_BITS) - 1), keys >> np.uint32(CLASS_BITS)
        at, hit = self._find(self.hash3, hashed(tri))
        rows = np.empty((len(keys), len(self.langs)))
        rows[hit] = self.logp3[at[hit]]
        low = tri[~hit]
        rows[~hit] = self.back3[low >> np.uint32(CLASS_BITS)] + self.logp2[low & np.uint32((1 << 2 * CLASS_BITS) - 1)]
        at, hit = self._find(self.back4_hash, hashed(context))
        rows[hit] += self.back4[at[hit]]
        return rows

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, cross-entropy, rejected)."""
        ce, letters = self.cross_entropies(text)
        if not letters or not self.langs:
            return UNDETERMINED, 0.0, 0.0, True
        best = int(np.argmin(ce))
        p = np.exp(-self.sharpness * (ce - ce[best]))
        return self.langs[best], float(1.0 / p.sum()), float(ce[best]), bool(self.limits is not None and ce[best] > self.limits[best])


def _discount(counts: np.ndarray) -> float:
    once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5


def _level(keys: np.ndarray, counts: np.ndarray, n_context: int) -> tuple[np.ndarray, np.ndarray]:
    """(discounted share of each key in its context, mass each context leaves to the lower order)."""
    d = _discount(counts)
    context = keys >> CLASS_BITS
    total = np.bincount(context, weights=counts, minlength=n_context)
    kinds = np.bincount(context, minlength=n_context)
    left = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    return np.maximum(counts - d, 0) / total[context], left


def build(tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney: raw counts at the top, below it the number of different left neighbours."""
    langs = sorted(tables)
    bits = CLASS_BITS
    size = {n: 1 << n * bits for n in (1, 2, 3)}
    every4 = np.unique(np.concatenate([tables[x][0] for x in langs])).astype(np.int64) if langs else np.empty(0, dtype=np.int64)
    every3 = np.unique(every4 & (size[3] - 1))
    contexts = np.unique(every4 >> bits)
    columns: dict[str, list[np.ndarray]] = {k: [] for k in ("p4", "p3", "p2", "b4", "b3")}
    for lang in langs:
        k4, c4 = (a.astype(np.int64) for a in tables[lang])
        c3 = np.bincount(k4 & (size[3] - 1), minlength=size[3])
        k3 = np.flatnonzero(c3)
        c2 = np.bincount(k3 & (size[2] - 1), minlength=size[2])
        k2 = np.flatnonzero(c2)
        c1 = np.bincount(k2 & (size[1] - 1), minlength=size[1])
        k1 = np.flatnonzero(c1)
        share1, left1 = _level(k1, c1[k1].astype(float), 1)
        p1 = np.full(size[1], left1[0] / size[1])
        p1[k1] += share1
        share2, left2 = _level(k2, c2[k2].astype(float), size[1])
        every2 = np.arange(size[2])
        p2 = left2[every2 >> bits] * p1[every2 & (size[1] - 1)]
        p2[k2] += share2
        share3, left3 = _level(k3, c3[k3].astype(float), size[2])
        p3 = left3[every3 >> bits] * p2[every3 & (size[2] - 1)]
        p3[np.searchsorted(every3, k3)] += share3
        share4, left4 = _level(k4, c4.astype(float), size[3])
        p4 = left4[every4 >> bits] * p3[np.searchsorted(every3, every4 & (size[3] - 1))]
        p4[np.searchsorted(every4, k4)] += share4
        for k, v in (("p4", p4), ("p3", p3), ("p2", p2), ("b4", left4[contexts]), ("b3", left3)):
            columns[k].append(np.log(v).astype(np.float32))
    col = {k: np.stack(v, axis=1) if v else np.empty((0, 0), dtype=np.float32) for k, v in columns.items()}
    h4, h3, hc = hashed(every4), hashed(every3), hashed(contexts)
    o4, o3, oc = np.argsort(h4), np.argsort(h3), np.argsort(hc)
    return Model(langs, h4[o4], col["p4"][o4], h3[o3], col["p3"][o3], col["p2"], col["b4"][oc], hc[oc], col["b3"])


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of docs with a text and a lang. Each task adds up its own rows before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add(lang: str, g: np.ndarray, n: np.ndarray, last: bool = False) -> None:
            parts = held.setdefault(lang, [])
            parts.append((g, n))
            if len(parts) > 1 and (last or sum(len(p[0]) for p in parts[1:]) > max(200_000, len(parts[0][0]))):
                keys = np.concatenate([p[0] for p in parts])
                uniq, inv = np.unique(keys, return_inverse=True)
                held[lang] = [(uniq, np.bincount(inv, weights=np.concatenate([p[1] for p in parts])).astype(np.int64))]

        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(lang, []).append(grams(classes(text)))
            for lang, parts in texts.items():
                add(lang, *np.unique(np.concatenate(parts), return_counts=True))
        for lang in list(held):
            add(lang, np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), last=True)
            g, n = held[lang][0]
            for at in range(0, len(g), 100_000):
                m = len(g[at : at + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(g[at : at + m].astype(np.int32)), pa.array(n[at : at + m])], names=["lang", "gram", "n"])

    rows = docs.filter("text is not null and lang is not null").select("lang", "text")
    return rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, max_calibration: int | None = None) -> Model:
    """Models of every lang of docs (doc_id, text, lang) from all its rows, which also calibrate scores and rejection, each once more.

    max_calibration: calibrate with at most so many documents over all languages, and for the rejection PER_LANGUAGE of each, instead of all.
    Rows without text or lang teach nothing. Without any row the model has no language and all texts are undetermined."""
    got = count_grams(docs).toArrow()
    lang, gram, n = (got.column(c) for c in ("lang", "gram", "n"))
    names, gram, n = np.array(lang.to_pylist(), dtype=object), gram.to_numpy(), n.to_numpy()
    tables = {}
    for x in sorted(set(names)):
        mine = names == x
        order = np.argsort(gram[mine])
        tables[x] = (gram[mine][order], n[mine][order])
    model = build(tables)
    if not model.langs:
        return model
    usable = docs.filter("text is not null and lang is not null")
    rows = usable.withColumn("shared", F.lit(True)) if max_calibration is None else _sample(usable.filter("doc_id is not null"), max_calibration)
    calibrate(model, tally(rows, model).collect())  # a row for each language and step, and for each sharpness
    return model


def _sample(usable: DataFrame, most: int) -> DataFrame:
    """The rows of the `most` smallest hashes of ids, and of the smallest ones of each lang; the latter not shared."""
    ids = [r["doc_id"] for r in usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct().collect()]
    every = {i: True for i in ids}
    for i in _ids_of_each(usable, most):
        every.setdefault(i, False)
    schema = T.StructType([usable.schema["doc_id"], T.StructField("shared", T.BooleanType())])
    return usable.join(F.broadcast(usable.sparkSession.createDataFrame(list(every.items()), schema)), "doc_id")


def tally(rows: DataFrame, model: Model) -> DataFrame:
    """(lang, step, n) over all rows (lang, text, shared) with a letter: of each lang, how many documents have a cross-entropy under their
    own language of so many steps, rounded up. With a null lang, the loss of the shared ones under each of SHARPNESSES, in units."""
    broadcast = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, losses, seen = broadcast.value, np.zeros(len(SHARPNESSES), dtype=np.int64), Counter()
        number = {x: i for i, x in enumerate(m.langs)}
        for batch in common.portions(batches):
            got = [(x, s, m.cross_entropies(t)) for x, s, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "shared", "text")))]
            got = [(x, s, ce) for x, s, (ce, letters) in got if letters]
            if not got:
                continue
            ce, truth = np.stack([g[2] for g in got]), np.array([number[g[0]] for g in got])
            own = ce[np.arange(len(got)), truth]
            seen.update(zip((g[0] for g in got), np.ceil(own / STEP).astype(np.int64).tolist()))
            shared = np.array([g[1] for g in got])
            gap = (ce - ce.min(axis=1, keepdims=True))[shared]
            far = gap[np.arange(len(gap)), truth[shared]]
            for k, b in enumerate(SHARPNESSES):
                losses[k] += np.round((b * far + np.log(np.exp(-b * gap).sum(axis=1))) / UNIT).astype(np.int64).sum()
        keys = [*seen, *((None, k) for k in range(len(losses)))]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([*seen.values(), *losses.tolist()], pa.int64())], names=["lang", "step", "n"])

    counts = rows.select("lang", "text", "shared").mapInArrow(run, "lang string, step long, n long")
    return counts.groupBy("lang", "step").agg(F.sum("n").alias("n"))


def _ids_of_each(usable: DataFrame, most: int) -> list:
    """For each lang the ids of the PER_LANGUAGE smallest hashes among its documents, `most` at most.

    A bound on the hash from the lang's count lets about twice as many through, so that no task has to order a whole language."""
    each, order = min(PER_LANGUAGE, most), F.xxhash64("doc_id")
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    bound = F.when(F.col("n") > 4 * each, (F.lit(4.0 * each) / F.col("n") - 1) * 2.0**63)
    bounds = F.broadcast(counts.select("lang", bound.alias("bound")))
    near = usable.select("lang", "doc_id", order.alias("hash")).join(bounds, "lang").filter("bound is null or hash < bound").select("lang", "hash", "doc_id").distinct()
    found: dict[str, list] = {}
    for r in near.collect():  # about 4 * PER_LANGUAGE ids of each lang
        found.setdefault(r["lang"], []).append((r["hash"], r["doc_id"]))
    return [i for some in found.values() for _, i in sorted(some)[:each]]


def calibrate(model: Model, counts: list[tuple[str | None, int, int]]) -> None:
    """Set the sharpness that makes the true languages likeliest, and each language's highest acceptable cross-entropy: a tenth above
    the step within which REJECT_QUANTILE of its documents are. counts: rows of tally(). A language with under LEAST documents has no limit."""
    losses = {k: n for lang, k, n in counts if lang is None}
    steps: dict[str, list[tuple[int, int]]] = {}
    for lang, step, n in counts:
        if lang is not None:
            steps.setdefault(lang, []).append((step, n))
    if steps and losses:
        model.sharpness = float(SHARPNESSES[min(losses, key=lambda k: (losses[k], k))])
    model.limits = np.full(len(model.langs), np.inf)
    for lang, some in steps.items():
        at, n = np.array(sorted(some)).T
        if n.sum() >= LEAST:
            first = int(np.searchsorted(np.cumsum(n), REJECT_QUANTILE * n.sum()))
            model.limits[model.langs.index(lang)] = at[first] * STEP * 1.1


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (0 to 1), cross_entropy and rejected (above what calibration saw of that language).

    A null text or one without letters is `und`, with score 0 and rejected. Keeps all rows and other columns; columns with the
    added names are replaced."""
    added = ["lang_pred", "score", "cross_entropy", "rejected"]
    kept = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop(*added).schema.add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            made = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *added])

    return kept.mapInArrow(run, schema)
