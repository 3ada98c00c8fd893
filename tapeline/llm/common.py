"""What the operators of this subpackage share: the shared folder, text splitting and hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but space and the ASCII controls 09-0D. bytes.split() cuts at the same six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, as the session names it; a temporary one only where none is set and all is one process."""
    path = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tapeline-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialise(df: DataFrame, tag: str, *by: str, light: bool = False) -> DataFrame:
    """Write to the shared folder and read again: lost executors lose nothing, and the lineage ends here.

    by: columns that give each of their values a folder of its own, so that a reader of one value opens no other. light: of rows of a few
    numbers, which an eighth of the tasks can write in as many fewer files."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if light:
        df = df.coalesce(max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    writer = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tapeline_path = path
    return back


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Texts go to Python in batches of so many rows at most while jobs run inside: a batch is held by the JVM and by Python, for each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept_in(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, for which discard() removes the written table that it reads."""
    df._tapeline_path = table._tapeline_path
    return df


def discard(*tables: DataFrame) -> None:
    """Remove what materialise() wrote; for intermediate tables that nothing reads any more.

    Spark drops shuffle files and broadcasts of past jobs when the driver has collected the plans that hold them, so that comes last."""
    for df in tables:
        path = getattr(df, "_tapeline_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def spread(doc_id: Column, salt: str) -> Column:
    """A uniform 52-bit number from the id, the same in any engine that has md5."""
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


class WordHashes(dict):
    """word (bytes) -> 64-bit hash as a signed integer; emptied when it has grown to `limit` words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        h = h - (1 << 64) if h >> 63 else h
        self[word] = h
        return h


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter text is one run."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    width_here = min(width, n)
    out = np.full(n - width_here + 1, width_here, dtype=np.uint64)
    for k in range(width_here):
        out = mix64(out * _MIX[k % len(_MIX)] + words[k : n - width_here + 1 + k])
    return out


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    """Hashes of the words of a text with A-Z lower-cased, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.arange(256, dtype=np.uint64) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_SPACE] = 0
#: Bytes of text hashed in one go.
SLICE_BYTES = 1 << 18


def hash_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words of some texts one after the other, where each text's begin and the last's end), text after text.

    Straight from Arrow's bytes: a word's hash is the sum of its bytes times numbers that depend on their place in it, mixed with
    its length. Words are as in word_hashes, their hashes other ones. A null is an empty text."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, side="right")) - 1)
        raw = data[at[first] : at[last]]
        begin = at[first : last + 1] - at[first]
        word = ~_SPACE[raw]
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        fresh = begin[:-1][begin[:-1] < len(raw)]  # a text begins a word even where the one before ends without a space
        starts[fresh] = word[fresh]
        where = np.flatnonzero(starts)
        if not len(where):
            yield np.empty(0, dtype=np.uint64), np.zeros(last - first + 1, dtype=np.int64)
            first = last
            continue
        place = np.arange(len(raw), dtype=np.int64)
        place -= np.repeat(where, np.diff(np.append(where, len(raw))))[: len(raw)] if where[0] == 0 else np.concatenate([np.zeros(where[0], dtype=np.int64), np.repeat(where, np.diff(np.append(where, len(raw))))])
        product = _BYTE[raw] * mix64((np.arange(int(place.max()) + 1, dtype=np.uint64) + np.uint64(1)) * _MIX[0])[place]
        length = np.add.reduceat(word.astype(np.int64), where).astype(np.uint64)
        yield mix64(np.add.reduceat(product, where) + length * _MIX[1]), np.searchsorted(where, begin)
        first = last


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The set of hashed shingles of each text, ascending. A text with fewer words than a shingle is one; one without words has none."""
    for words, begin in hash_words(column):
        runs = rolling(words, width) if len(words) >= width else None
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            yield np.unique(runs[a : b - width + 1] if b - a >= width else rolling(words[a:b], width))


def portions(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, so that what is made of one doesn't pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
