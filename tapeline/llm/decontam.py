"""Benchmark decontamination by canonical templates, so that a question with other numbers and names is still found."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Tokens in a template window. A shorter item is one window of its own length. One of under SHORTEST tokens is found only as a whole document, with its own fillings.
WINDOW, SHORTEST = 8, 4
#: A document leaks an item if it holds at least this share of its windows, or this many.
COVERAGE, ENOUGH = 0.5, 8
#: Least share of slot fillings that agree: one filling in the document for each filling of the item.
CONSISTENT = 0.8
#: Hashes of benchmark windows that may be broadcast (8 MB); with more, all windows of the documents are shuffled.
BROADCAST_WINDOWS = 1_000_000

#: Units of measure, given names that may begin a sentence, and words that tell a German sentence, whose nouns are capitalised.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur gbp degree degrees celsius fahrenheit watt watts volt volts joule joules hertz hz kb mb gb tb".split()
)
NAMES = frozenset(
    "alice bob carol dave eve john mary james anna emma liam noah olivia peter paul maria jose juan ana luis carlos sofia lucas hugo marie pierre jean claire julie hans karl anna lena max moritz tom jerry sam sarah emily david michael daniel laura kate jack amy mark lisa sally jim janet".split()
)
GERMAN = frozenset("der das und ist nicht ein eine einen einem einer dem auf für wie viele sich sind wird werden aus bei vom zum zur".split())
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n]")


def _german(tokens: list[str], start: int) -> bool:
    """If the sentence that starts there has a word that only German has."""
    for tok in itertools.islice(tokens, start, None):
        if tok in ".!?\n":
            return False
        if tok.lower() in GERMAN:
            return True
    return False


def canonical(text: str | None) -> tuple[list[str], list[tuple[int, str]]]:
    """(tokens, slots): words lower-cased, with \\x01n, \\x01e and \\x01u where numbers, names and units stand.

    slots lists (token position, filling). A run of capitalised words inside a sentence is one name; a word that begins a sentence, or stands in
    a German one, is a name if it is a known one. A unit is a unit only after a number."""
    out: list[str] = []
    slots: list[tuple[int, str]] = []
    begins = True
    tokens = _TOKEN.findall(text or "")
    start, german = 0, None  # of the sentence; german: as far as anyone has asked
    for at, tok in enumerate(tokens):
        if tok in ".!?\n":
            begins, start, german = True, at + 1, None
            continue
        low = tok.lower()
        if tok[0].isdigit():
            slots.append((len(out), tok))
            out.append("\x01n")
        elif low in UNITS and out and out[-1] == "\x01n":
            slots.append((len(out), low))
            out.append("\x01u")
        elif tok[0].isupper() and not tok.isupper() and (low in NAMES or not begins and not (german := _german(tokens, start) if german is None else german)):
            if out and out[-1] == "\x01e" and not begins:
                slots[-1] = (slots[-1][0], slots[-1][1] + " " + low)
            else:
                slots.append((len(out), low))
                out.append("\x01e")
        else:
            out.append(low)
        begins = False
    return out, slots


def windows(text: str | None, cache: common.WordHashes, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, int]]:
    """[(hashes of all windows, their length)] of a text's template, and its slots. A text of under SHORTEST tokens is one window, of its fillings too."""
    tokens, slots = canonical(text)
    if 0 < len(tokens) < SHORTEST:
        tokens = [*tokens, *(f for _, f in slots)]
        h = np.array([cache[t.encode()] for t in tokens], dtype=np.int64).view(np.uint64)
        return [(common.rolling(h, len(h)), len(h) - len(slots))], []
    h = np.fromiter((cache[t.encode()] for t in tokens), dtype=np.int64, count=len(tokens)).view(np.uint64)
    return [(common.rolling(h, n), n) for n in lengths if len(h) >= n], slots


def _fillings(slots: list[tuple[int, str]], at: int, n: int) -> list[str]:
    return [f for p, f in slots if at <= p < at + n]


def _table(df: DataFrame, key: str, lengths: tuple[int, ...], only: np.ndarray | None, own_length: bool) -> DataFrame:
    """(key, part, hash, pos, fillings, total): the windows of each text, of those in `only` if given. part tells texts of one id apart.

    own_length: of each text only windows of WINDOW tokens, or the whole where it is shorter."""
    shared = None if only is None else df.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = common.WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for k, part, t in zip(batch.column(key).to_pylist(), batch.column("part").to_pylist(), batch.column("text")):
                found, slots = windows(t.as_py(), cache, lengths)
                if own_length:
                    found = found[-1:]
                    if found and found[0][1] < WINDOW and len(found[0][0]) > 1:
                        found = []
                for hashes, n in found:
                    at = range(len(hashes))
                    if shared is not None and len(shared.value):
                        where = np.minimum(np.searchsorted(shared.value, hashes), len(shared.value) - 1)
                        at = np.flatnonzero(shared.value[where] == hashes).tolist()
                    elif shared is not None:
                        at = []
                    out.extend((k, part, int(hashes[i].astype(np.int64)), i, _fillings(slots, i, n), len(hashes)) for i in at)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32())
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[key, "part", "hash", "pos", "fillings", "total"])

    return df.select(F.col(key).cast("long").alias(key), F.xxhash64("text").alias("part"), "text").mapInArrow(run, f"{key} long, part long, hash long, pos int, fillings array<string>, total int")


def _agreement(met: DataFrame, by: list[str]) -> DataFrame:
    """by, agreement: the share of slot fillings that map each filling of one side to the other side's most frequent one for it, in the
    direction in which that is less; no row without slots."""
    pairs = met.filter(F.size("fillings") > 0).select(*by, F.explode(F.arrays_zip("fillings", "theirs")).alias("s")).groupBy(*by, "s.fillings", "s.theirs").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(*by, "n", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("fillings").alias("filling")), F.struct(F.lit(1).alias("side"), F.col("theirs").alias("filling")))))
    each = sides.groupBy(*by, "side", "filling").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return each.groupBy(*by, "side").agg((F.sum("top") / F.sum("n")).alias("agreement")).groupBy(*by).agg(F.min("agreement").alias("agreement"))


def _covered(met: DataFrame, by: list[str]) -> DataFrame:
    """by, matched, agreement of what holds enough of its item's windows; agreement is 1 without slots."""
    seen = met.groupBy(*by).agg(F.countDistinct("pos").alias("matched")).filter(f"matched >= least({ENOUGH}, windows * {COVERAGE})")
    return seen.join(_agreement(met, by), by, "left").withColumn("agreement", F.coalesce("agreement", F.lit(1.0)))


def _occurrences(met: DataFrame) -> DataFrame:
    """doc_id, item_id, windows, matched, agreement of the single occurrence of each item in each document that agrees best.

    An occurrence is what lies along one offset between document and item; or, so that words put in or left out don't part it, a run
    of windows whose places in the item go up, with no jump longer than the item. Where a window is at many places in the item, runs
    take the place on the offset with the most windows."""
    pair = ["doc_id", "item_id", "windows"]
    spots = met.select(*pair, "pos", "fillings", "theirs", F.inline("places")).withColumn("offset", F.col("place") - F.col("pos"))
    spots = spots.withColumn("support", F.count(F.lit(1)).over(Window.partitionBy(*pair, "part", "offset")))
    spots = spots.withColumn("main", F.row_number().over(Window.partitionBy(*pair, "part", "place").orderBy(F.desc("support"), "pos")) == 1)
    along = Window.partitionBy(*pair, "part", "main").orderBy("place", "pos")
    back = (F.col("pos") <= F.lag("pos").over(along)) | (F.abs(F.col("offset") - F.lag("offset").over(along)) > F.col("windows"))
    spots = spots.withColumn("back", F.coalesce(back.cast("int"), F.lit(0))).withColumn("run", F.sum("back").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    line, run = (F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("no")) for kind, c in enumerate(("offset", "run")))
    single = spots.select(*pair, "part", "pos", "fillings", "theirs", F.explode(F.when(F.col("main"), F.array(line, run)).otherwise(F.array(line))).alias("in"))
    best = _covered(single, [*pair, "part", "in"]).groupBy(*pair).agg(F.max(F.struct("agreement", "matched")).alias("best"))
    return best.select(*pair, "best.matched", "best.agreement")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it leaks: doc_id, item_id, matched, windows, coverage, agreement.

    docs: doc_id, text; benchmark: item_id, text. matched counts the item's different windows that the document has; agreement is the share of
    slot fillings that map each filling of the item to one of the document and back, 1 without slots. An item of under SHORTEST tokens leaks into a document
    that says just that. Where the whole document's fillings don't
    agree, as other questions of the same template stand in it, both are those of the single occurrence that agrees best. Null and empty texts leak
    nothing; null ids are left out; repeated rows of one id count as one document; empty tables give an empty result."""
    spark = docs.sparkSession
    lengths = tuple(range(SHORTEST, WINDOW + 1))
    items = common.materialise(_table(benchmark.filter("item_id is not null"), "item_id", lengths, None, True), "items")
    n = items.agg(F.count(F.lit(1))).first()[0]
    only = None
    if n <= BROADCAST_WINDOWS:
        only = np.unique(np.array([r["hash"] for r in items.select("hash").distinct().collect()], dtype=np.int64).view(np.uint64))
    short = [r["t"] for r in items.filter("total = 1").select(F.col("item_id").alias("t")).limit(1).collect()]
    sizes = lengths if short else (WINDOW,)
    ours = _table(docs.filter("doc_id is not null"), "doc_id", sizes, only, False).withColumnRenamed("fillings", "theirs")
    ours = ours.groupBy("doc_id", "hash", "theirs").agg(F.collect_set(F.struct("part", F.col("pos").alias("place"))).alias("places"))
    theirs = items.select("item_id", "hash", "pos", "fillings", F.col("total").alias("windows"))
    met = common.materialise(ours.join(theirs, "hash"), "windows")
    whole = common.materialise(_covered(met, ["doc_id", "item_id", "windows"]), "pairs")
    mixed = whole.filter(F.col("agreement") < CONSISTENT).select("doc_id", "item_id", "windows")
    single = _occurrences(met.join(mixed, ["doc_id", "item_id", "windows"]))
    out = whole.unionByName(single).filter(F.col("agreement") >= CONSISTENT).withColumn("coverage", F.col("matched") / F.col("windows"))
    return out.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("windows").cast("long").alias("windows"), "coverage", "agreement")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, unchanged. Rows without id or text stay."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_leaky")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == F.col("_leaky"), "left_anti")
