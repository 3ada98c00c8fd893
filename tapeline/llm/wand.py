"""Exact BM25 top-k over inverted indexes with block-max WAND pruning, run per shard and merged.

Texts are split once into a table of terms and counts, which every pass reads. Documents fall into levels by a hash of their ids. The first level is a 64th
of all; its results bound every query's k-th place from below, and the second level, an eighth, raises the bounds. So the last level starts with
bounds that a few times k documents reach, and shards return those alone."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
#: Postings of a shard's index, and documents of a block within it, whose largest impacts bound what its documents can score.
SHARD_POSTINGS, BLOCK_DOCS = 3_000_000, 4
#: Terms and queries of a block of queries, which is broadcast: each block is one pass over the table of terms.
BLOCK_TERMS, BLOCK_QUERIES = 4_000_000, 65_536
#: Of 64 parts of the documents, how many make up the levels up to each.
LEVELS = (1, 8, 64)
#: Queries scored together, and the share of a shard's documents from which on a term is a row of impacts.
TOGETHER, DENSE_FROM = 256, 0.1
#: Lists shorter than this are picked out together, the others one by one.
SHORT = 128
#: Impacts are multiples of 1 / GRAIN, so that their sums are the same in any order and equal texts tie.
GRAIN = 2.0**36
#: Scores are rounded to nine places, bounds are not, and sums of largest impacts are in single precision.
SLACK, SINGLE = 1e-8, 1e-4
_PART_BITS = 14


def terms_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes of the distinct words in ascending order, how often each occurs, number of words) of each text."""
    for words, begin in common.hash_words(column):
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            yield *np.unique(words[a:b], return_counts=True), b - a


def tokenise(docs: DataFrame) -> DataFrame:
    """(doc_id, level, words, terms, counts): the distinct words of each text, as hashes in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.portions(batches):
            found = list(terms_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("level"), pa.array([n for _, _, n in found], pa.int64()), _lists([t.view(np.int64) for t, _, _ in found], pa.int64()), _lists([c.astype(np.int32) for _, c, _ in found], pa.int32())],
                names=["doc_id", "level", "words", "terms", "counts"],
            )

    part = F.pmod(F.xxhash64("doc_id"), F.lit(LEVELS[-1]))
    level = sum((part >= n).cast("int") for n in LEVELS[:-1])
    return docs.select("doc_id", level.alias("level"), "text").mapInArrow(run, "doc_id long, level int, words long, terms array<long>, counts array<int>")


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


@dataclass
class Queries:
    """A block of queries: ids, the sorted hashes of their terms, and per query the numbers of its terms among them.

    floor and floor_id are the k-th best score and its document so far; a document that isn't better doesn't count."""

    ids: np.ndarray
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    idf: np.ndarray | None = None
    mean_words: float = 1.0
    floor: np.ndarray | None = None
    floor_id: np.ndarray | None = None


def match(uniq: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in uniq, numbers in the vocabulary) of the terms that both have."""
    at = np.minimum(np.searchsorted(vocabulary, uniq), max(0, len(vocabulary) - 1))
    hit = np.flatnonzero(vocabulary[at] == uniq) if len(vocabulary) else np.empty(0, dtype=np.int64)
    return hit, at[hit]


def statistics(index: DataFrame, queries: Queries) -> tuple[np.ndarray, int, int]:
    """(document frequency of each term of the queries, documents, words) over all rows of the table of terms."""
    shared = index.sparkSession.sparkContext.broadcast(queries.vocabulary)
    size, part = len(queries.vocabulary), 1 << _PART_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, words = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            flat = batch.column("terms").flatten().to_numpy().view(np.uint64)
            df += np.bincount(match(flat, shared.value)[1], minlength=size)
            n, words = n + batch.num_rows, words + (pa.compute.sum(batch.column("words")).as_py() or 0)
        parts = [k for k in range(-(-size // part)) if df[k * part : (k + 1) * part].any()]
        data = [zlib.compress(df[k * part : (k + 1) * part].tobytes(), 1) for k in parts]
        yield pa.RecordBatch.from_arrays([pa.array([*parts, -1], pa.int32()), pa.array([*data, b""], pa.binary()), pa.array([0] * len(parts) + [n], pa.int64()), pa.array([0] * len(parts) + [words], pa.int64())], names=["part", "counts", "n", "words"])

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key, n, words = None, None, 0, 0
        for batch in group:
            key = batch.column("part")[0].as_py()
            n, words = n + sum(batch.column("n").to_pylist()), words + sum(batch.column("words").to_pylist())
            for c in batch.column("counts"):
                if c.as_py():
                    more = np.frombuffer(zlib.decompress(c.as_py()), dtype=np.int64)
                    total = more if total is None else total + more
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([b"" if total is None else total.tobytes()], pa.binary()), pa.array([n], pa.int64()), pa.array([words], pa.int64())], names=["part", "counts", "n", "words"])

    schema = "part int, counts binary, n long, words long"
    df, n, words = np.zeros(size, dtype=np.int64), 0, 0
    for r in index.select("terms", "words").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect():
        if r["part"] < 0:
            n, words = r["n"], r["words"]
        else:
            df[r["part"] * part : r["part"] * part + part] = np.frombuffer(r["counts"], dtype=np.int64)
    shared.destroy()
    return df, n, words


class Shard:
    """The inverted index of some documents on the terms of a block of queries.

    Terms in many of the shard's documents are rows of impacts, with their largest in each block of BLOCK_DOCS documents beside them; the others are
    posting lists. Documents are in order of length, so that blocks are alike."""

    def __init__(self, ids: list[int], found: list[tuple[np.ndarray, np.ndarray, int]], queries: Queries):
        order = sorted(range(len(ids)), key=lambda i: (found[i][2], ids[i]))
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.n, blocks, size = len(ids), -(-len(ids) // BLOCK_DOCS), len(queries.vocabulary)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), [len(found[i][0]) for i in order])
        term = np.concatenate([found[i][0] for i in order]).astype(np.int32) if order else np.empty(0, dtype=np.int32)
        tf = np.concatenate([found[i][1] for i in order]).astype(np.float64) if order else np.empty(0)
        words = np.array([found[i][2] for i in order], dtype=np.float64)
        norm = K1 * (1 - B + B * words / max(queries.mean_words, 1e-9))
        impact = np.round(queries.idf[term] * tf * (K1 + 1) / (tf + norm[doc]) * GRAIN) / GRAIN if len(tf) else np.empty(0)
        by_term = np.argsort(term, kind="stable")
        self.doc, self.impact, term = doc[by_term], impact[by_term], term[by_term]
        self.start = np.searchsorted(term, np.arange(size + 1)).astype(np.int64)
        self.df = np.diff(self.start)
        dense = np.flatnonzero(self.df >= max(8, DENSE_FROM * self.n))
        self.row = np.full(size, -1, dtype=np.int32)
        self.row[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), blocks * BLOCK_DOCS))
        at = self.row[term] >= 0
        self.dense[self.row[term[at]], self.doc[at]] = self.impact[at]
        self.block_most = self.dense.reshape(len(dense), blocks, BLOCK_DOCS).max(axis=2).astype(np.float32) if blocks else np.zeros((len(dense), 0), dtype=np.float32)

    def top(self, terms: list[np.ndarray], k: int, floor: np.ndarray, floor_id: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, scores) of the k best documents that are better than its floor; scores of 0 don't count.

        A query's rare terms, whose impacts are the larger ones, lie past the pivot: their lists are walked through and say what each document
        has for certain. What the frequent terms before it may add is bounded by their largest impacts in a document's block, for
        all queries in one product. Only a document that reaches the floor so is looked up in the rows of the frequent terms."""
        rows = [self.row[t] for t in terms]
        weight = np.zeros((len(terms), len(self.dense)), dtype=np.float32)
        for w, r in zip(weight, rows):
            w[r[r >= 0]] = 1.0
        bounds = (weight @ self.block_most).astype(np.float64) * (1 + SINGLE) + SLACK
        return [self._top(t[r < 0], r[r >= 0], b, k, float(f), int(i)) for t, r, b, f, i in zip(terms, rows, bounds, floor, floor_id)]

    def _top(self, rare: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int, floor: float, floor_id: int) -> tuple[np.ndarray, np.ndarray]:
        df, start = self.df[rare], self.start[rare]
        short = df < SHORT
        n = df[short]
        at = np.arange(int(n.sum())) + np.repeat(start[short] - np.cumsum(n) + n, n)
        spans = [(self.doc[x:y], self.impact[x:y]) for x, y in zip(start[~short].tolist(), (start + df)[~short].tolist())]
        sure = np.bincount(np.concatenate([self.doc[at], *(d for d, _ in spans)]), weights=np.concatenate([self.impact[at], *(i for _, i in spans)]), minlength=self.n)
        reach = sure + np.repeat(bound, BLOCK_DOCS)[: self.n]
        found = np.flatnonzero(reach >= floor)
        if len(found) > 16 * k:  # the scores of the most promising ones raise the bar for the others
            near = found[np.argpartition(-reach[found], 4 * k)[: 4 * k]]
            got = self._scores(near, sure, rows)
            found = found[reach[found] >= np.partition(got, len(got) - k)[len(got) - k]]
        score = self._scores(found, sure, rows)
        ids = self.ids[found]
        good = (score > 0) & ((score > floor) | (score == floor) & (ids < floor_id))
        ids, score = ids[good], score[good]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]

    def _scores(self, docs: np.ndarray, sure: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.round(sure[docs] + self.dense[rows[:, None], docs].sum(axis=0), 9)


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents with the highest BM25 for each query, ties going to the smaller id.

    docs: doc_id, text; queries: query_id, text. Words are runs of anything but ASCII white space, A-Z lower-cased. A query counts each of its distinct
    words once; scores use document frequencies and the mean length over all documents, so shards agree. Null texts are empty, and nothing matches an
    empty query; rows with null ids are left out; repeated rows of docs are separate results; without documents or queries the
    result is empty. Queries go in blocks bounded by their terms; each block reads the table of terms, not the texts."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = queries.filter("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "text")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.portions(batches):
            terms = [t.view(np.int64) for t, _, _ in terms_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), _lists(terms, pa.int64())], names=["query_id", "terms"])

    parsed = common.materialise(asked.mapInArrow(parse, "query_id long, terms array<long>"), "queries")
    n = parsed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    n_blocks = max(1, -(-(n["terms"] or 0) // BLOCK_TERMS), -(-n["n"] // BLOCK_QUERIES))
    index = common.materialise(tokenise(docs), "terms", "level")
    tables = []
    for b in range(n_blocks):
        got = parsed.filter(F.pmod(F.xxhash64("query_id", "terms"), F.lit(n_blocks)) == b).select("query_id", "terms").toArrow().combine_chunks()
        lists = [x.view(np.uint64) for c in got.column("terms").chunks for x in _rows(c)]
        vocabulary = np.unique(np.concatenate(lists)) if lists else np.empty(0, dtype=np.uint64)
        block = Queries(got.column("query_id").to_numpy(), vocabulary, [np.searchsorted(vocabulary, x).astype(np.int32) for x in lists])
        df, n_docs, words = statistics(index, block)
        block.idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        block.mean_words = words / max(1, n_docs)
        tables.append(_search_block(index, block, k))
    common.discard(parsed)
    common.discard(index)
    found = tables[0]
    for t in tables[1:]:
        found = found.union(t)
    return found


def _search_block(index: DataFrame, block: Queries, k: int) -> DataFrame:
    """Level after level, each with the floors that the ones before have found. Queries are told apart by their numbers, as ids may repeat."""
    sc = index.sparkSession.sparkContext
    m = len(block.ids)
    block.floor, block.floor_id = np.zeros(m), np.full(m, np.iinfo(np.int64).max)
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    found = None
    for level in range(len(LEVELS)):
        shared = sc.broadcast(block)
        new = index.filter(F.col("level") == level).select("doc_id", "words", "terms", "counts").mapInArrow(_searcher(shared, k), "query int, doc_id long, score double")
        both = new if found is None else found.select("query", "doc_id", "score").union(new)
        kept = common.materialise(both.withColumn("rank", ranked).filter(F.col("rank") <= k), "found")
        if found is not None:
            common.discard(found)
        found = kept
        shared.destroy()
        if level + 1 < len(LEVELS):
            last = found.filter(F.col("rank") == k).select("query", "doc_id", "score").toArrow()  # a row for each query of the block
            at = last.column("query").to_numpy()
            block.floor[at], block.floor_id[at] = last.column("score").to_numpy(), last.column("doc_id").to_numpy()
    names = index.sparkSession.createDataFrame(pa.table({"query": pa.array(range(m), pa.int32()), "query_id": pa.array(block.ids, pa.int64())}))
    return found.join(F.broadcast(names), "query").select("query_id", "rank", "doc_id", "score")  # at most BLOCK_QUERIES names


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        floor, floor_id = block.floor.copy(), block.floor_id.copy()
        ids: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        held = 0

        def answer() -> None:
            shard = Shard(ids, found, block)
            for at in range(0, len(block.terms), TOGETHER):
                some = slice(at, at + TOGETHER)
                for q, (i, s) in enumerate(shard.top(block.terms[some], k, floor[some], floor_id[some]), at):
                    if not len(i):
                        continue
                    if q in best:
                        i, s = np.concatenate([best[q][0], i]), np.concatenate([best[q][1], s])
                        first = np.lexsort((i, -s))[:k]
                        i, s = i[first], s[first]
                    best[q] = i, s
                    if len(i) == k and (s[-1], -i[-1]) > (floor[q], -floor_id[q]):
                        floor[q], floor_id[q] = s[-1], i[-1]
            ids.clear()
            found.clear()

        for batch in common.portions(batches):
            for i, n, terms, counts in zip(batch.column("doc_id").to_pylist(), batch.column("words").to_pylist(), _rows(batch.column("terms")), _rows(batch.column("counts"))):
                hit, number = match(terms.view(np.uint64), block.vocabulary)
                ids.append(i)
                found.append((number.astype(np.int32), counts[hit], n))
                held += len(hit)
                if held >= SHARD_POSTINGS:
                    answer()
                    held = 0
        if ids:
            answer()
        numbers = np.array(sorted(best), dtype=np.int32)
        for at in range(0, len(numbers), 10_000):
            some = numbers[at : at + 10_000].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(some, dtype=np.int32), [len(best[q][0]) for q in some])), pa.array(np.concatenate([best[q][0] for q in some])), pa.array(np.concatenate([best[q][1] for q in some]))], names=["query", "doc_id", "score"]
            )

    return run
