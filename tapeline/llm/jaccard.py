"""Exact Jaccard similarity join on word shingles with adaptive multi-match prefixes.

Shingle sets are ordered by rising corpus frequency. If two sets are at least t similar, the first |x| - ceil(t|x|) + l shingles
of each share l of them, for any l. Each document picks the l with the least estimated cost; a pair must share the
smaller of the two. Documents that share a prefix shingle form a bucket. Small buckets are compared pair by pair. In
a large one, each document is compared with a leader c alone, which gives what it lacks of c and has beyond c: D(x). With
s = |D(x) & D(y)|, J(x, y) <= J(x, c) unless s exceeds the smaller of the two parts of D(y). So two
documents of which one isn't linked to c can only be linked if the other shares that much of its difference with it, which an index of differences finds.
Documents further than NEAR from the leader meet again under another one, as long as that halves them. What is still in large buckets is split: with each
prefix token more, the linked pairs of a bucket share a further one, and meet in the buckets of both, where those have fewer pairs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Counters of the frequency sketch, as a power of two, and the most that one counts; a byte for each is broadcast. Only costs depend on them, never results.
SKETCH_BITS, MOST = 24, (1 << 16) - 1
_BLOCK_BITS = 14
#: Largest bucket whose pairs are listed, and rounds of leaders for the larger ones.
SMALL, ROUNDS = 8, 3
#: How often a bucket that leaders don't empty is split by a further token, at most.
DEPTH = 3
#: Jaccard distance from a leader within which differences are indexed.
NEAR = 0.25
MAX_MATCHES = 6
#: Parts that the pairs of one hub are dealt into; its text goes to each part that has a pair.
CHUNKS = 1024
#: Rows of a few numbers that may be broadcast (about 4 MB); more go through a shuffle.
BROADCAST_ROWS = 50_000


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How often each of 2**SKETCH_BITS hash buckets is hit by the shingle sets of all documents, up to MOST."""
    size, block = 1 << SKETCH_BITS, 1 << _BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.uint16)
        for batch in common.portions(batches, 500):
            hits = [sh & np.uint64(size - 1) for sh in common.shingle_sets(batch.column("text"), width)]
            bucket, n = np.unique(np.concatenate(hits).astype(np.int64), return_counts=True)
            total[bucket] = np.minimum(total[bucket] + n, MOST)
        blocks = [k for k in range(size // block) if total[k * block : (k + 1) * block].any()]
        for at in range(0, len(blocks), 64):
            some = blocks[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_pack(total[k * block : (k + 1) * block]) for k in some], pa.binary())], names=["block", "counts"])

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = np.zeros(block, dtype=np.int64), None
        for batch in group:
            key = batch.column("block")[0].as_py()
            for c in batch.column("counts"):
                total += _unpack(c.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([_pack(np.minimum(total, MOST).astype(np.uint16))], pa.binary())], names=["block", "counts"])

    parts = docs.select("text").mapInArrow(count, "block int, counts binary")
    out = np.zeros(size, dtype=np.uint16)
    for r in parts.groupBy("block").applyInArrow(add, "block int, counts binary").collect():  # 2**SKETCH_BITS counters at most
        out[r["block"] * block : (r["block"] + 1) * block] = _unpack(r["counts"])
    return out


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint16)


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """Four steps for each doubling of what a bucket has above the usual load."""
    step = 1 << 20
    seen = sum(np.bincount(counts[at : at + step], minlength=MOST + 1) for at in range(0, len(counts), step))
    usual = int(np.searchsorted(np.cumsum(seen), len(counts) // 2, side="right"))
    above = np.maximum(np.arange(MOST + 1) - usual, 0)
    classes = np.round(4 * np.log2(1.0 + above)).astype(np.uint8)
    return np.concatenate([classes[counts[at : at + step]] for at in range(0, len(counts), step)])


def _class(sh: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return classes[(sh & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.int64)


def ordered(sh: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set as numbers whose order is the global one: frequency class, then hash."""
    c = _class(sh, classes).astype(np.uint64)
    return np.sort((c << np.uint64(56)) | (sh >> np.uint64(8)))


def choose_prefix(tokens: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """(matches required, prefix length) with the least estimated cost.

    The estimate: postings read, and twenty times the candidates, of which there are at most postings / matches."""
    n = len(tokens)
    need = -(-num * n // den)
    cost = np.cumsum(np.exp2((tokens >> np.uint64(56)).astype(np.float64) / 4))
    best = min(range(1, min(MAX_MATCHES, need) + 1), key=lambda k: cost[n - need + k - 1] * (1 + 20 / k))
    return best, n - need + best


def describe(docs: DataFrame, shared, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, key, matches, rarity, length, prefix): key is a digest of the set; rarity orders leaders, lowest first.

    prefix has DEPTH tokens more than length says, for buckets that stay large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.portions(batches, 1000):
            n, keys, matches, rarity, lengths, prefix = [], [], [], [], [], []
            for sh in common.shingle_sets(batch.column("text"), width):
                n.append(len(sh))
                if not len(sh):
                    keys.append(b""), matches.append(0), rarity.append(0.0), lengths.append(0), prefix.append([])
                    continue
                tokens = ordered(sh, shared.value)
                k, length = choose_prefix(tokens, num, den)
                keys.append(hashlib.md5(sh.tobytes()).digest())
                matches.append(k)
                rarity.append(-float((tokens >> np.uint64(56)).mean()))
                lengths.append(length)
                prefix.append(tokens[: length + DEPTH].copy().view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(matches, pa.int32()), pa.array(rarity, pa.float64()), pa.array(lengths, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["doc_id", "n", "key", "matches", "rarity", "length", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, matches int, rarity double, length int, prefix array<long>")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def compare(pairs: DataFrame, docs: DataFrame, classes, width: int, num: int, den: int, differences: bool) -> DataFrame:
    """(hub, id, linked, distance, hub_n, lacks, adds) for each row of pairs (hub, id), from the whole texts of both.

    lacks and adds are hashes of the hub's shingles that id lacks and of its own beyond them, within NEAR + 1 - t: first the additions rare in
    the corpus, and what is frequent in it of the lacks, as few documents share either. A hub's text travels once with each of CHUNKS parts of its
    pairs, so a hub that most pairs have is many tasks, and no more texts travel than two for each pair."""
    chunk = F.pmod(F.xxhash64("id"), F.lit(CHUNKS)).cast("int")
    pairs = common.materialise(pairs.select("hub", "id").distinct().withColumn("chunk", chunk), "pairs", light=True)
    hubs = pairs.select(F.col("hub").alias("id"), "hub", "chunk").distinct()
    wanted = hubs.withColumn("kind", F.lit(0)).union(pairs.select("id", "hub", "chunk", F.lit(1).alias("kind")))
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(_small(wanted, 2 * pairs.count()), "id").select("hub", "chunk", "kind", "id", "text")
    limit = NEAR + 1 - num / den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ours = None, np.empty(0, dtype=np.uint64)
        for batch in common.portions(batches):
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("hub", "chunk", "kind", "id")))
            for (h, c, k, i), theirs in zip(keys, common.shingle_sets(batch.column("text"), width)):
                if k == 0:
                    if at != (h, c):
                        at, ours = (h, c), theirs
                    continue
                where = np.searchsorted(ours, theirs)
                shared = ours[np.minimum(where, len(ours) - 1)] == theirs
                inter = int(np.count_nonzero(shared))
                both = len(ours) + len(theirs) - inter
                distance = 1 - inter / both
                lacks, adds = [], []
                if differences and distance <= limit:
                    gone = np.ones(len(ours), dtype=bool)
                    gone[where[shared]] = False
                    lacks, adds = ours[gone], theirs[~shared]
                    lacks = lacks[np.argsort(-_class(lacks, classes.value), kind="stable")].view(np.int64)
                    adds = adds[np.argsort(_class(adds, classes.value), kind="stable")].view(np.int64)
                out.append((h, i, den * inter >= num * both, distance, len(ours), lacks, adds))
            if out:
                types = (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=["hub", "id", "linked", "distance", "hub_n", "lacks", "adds"])

    dealt = rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "kind", "id")
    out = common.materialise(dealt.mapInArrow(run, "hub long, id long, linked boolean, distance double, hub_n long, lacks array<long>, adds array<long>"), "compared")
    common.discard(pairs)
    return out


def _direct(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, id, shared, needed): documents of one bucket whose sizes allow a link, in how many buckets they meet and in how many linked ones do.

    Where postings have the ordered prefixes, what these differ by up to the end of the shorter one must not be more than linked sets do."""
    more = ["prefix"] if "prefix" in postings.columns else []
    a = postings.select("token", F.col("id").alias("hub"), F.col("n").alias("na"), F.col("matches").alias("ma"), *(F.col(c).alias("pa") for c in more))
    b = postings.select("token", "id", F.col("n").alias("nb"), F.col("matches").alias("mb"), *(F.col(c).alias("pb") for c in more))
    fit = (F.col("hub") < F.col("id")) & (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    if more:
        known = lambda c: F.size(F.filter(c, lambda t: t <= F.least(F.element_at("pa", -1), F.element_at("pb", -1))))
        apart = known("pa") + known("pb") - 2 * F.size(F.array_intersect("pa", "pb"))
        fit = fit & (apart * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))
    return a.join(b, "token").filter(fit).groupBy("hub", "id").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("ma", "mb")).alias("needed"))


def _split(rest: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """Postings of rest in smaller buckets, in which all that can be linked still meets, and the written tables that they read.

    With k tokens more than matches asks for in prefixes, the linked documents of a bucket share k besides its own, so they meet again in a bucket of
    its tokens and one more. A bucket is split where that takes fewer postings and pairs than it has pairs; sets of tokens
    that several lead to are one bucket. Linked sets that differ share num / (den - num) shingles or more, and no bucket has more tokens than that."""
    depth = min(DEPTH, -(-num // (den - num)) - 1) if num < den else DEPTH
    tails = sets.select(F.col("doc_id").alias("id"), "prefix", "length")
    level, listed, held = rest.select("token", F.array("token").alias("tokens"), "id", "n"), [], []
    for k in range(1, depth + 1):
        tail = F.array_except(F.slice("prefix", F.lit(1), F.col("length") + k), "tokens")
        both = level.join(tails, "id").select("token", "tokens", "id", "n", tail.alias("tail"))
        sizes = both.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("tail")).alias("postings"))
        large = sizes.filter(f"docs > {SMALL} and 2 * postings < docs * (docs - 1)").select("token", "docs")
        finer = both.join(large, "token").select(F.col("token").alias("parent"), "docs", "tokens", "id", "n", F.explode("tail").alias("next"))
        finer = finer.withColumn("tokens", F.array_sort(F.concat("tokens", F.array("next"))))
        finer = common.materialise(finer.select("parent", "docs", F.xxhash64("tokens").alias("token"), "tokens", "id", "n"), "finer")
        parts = common.materialise(finer.groupBy("parent", "docs", "token").agg(F.count(F.lit(1)).alias("part")), "parts", light=True)
        ways = parts.groupBy("token").agg(F.count(F.lit(1)).alias("ways"))
        cost = F.sum(F.col("part") + F.col("part") * (F.col("part") - 1) / (2 * F.col("ways")))
        fewer = parts.join(ways, "token").groupBy("parent", "docs").agg(cost.alias("cost")).filter("2 * cost < docs * (docs - 1)")
        fewer = common.materialise(fewer.select(F.col("parent").alias("token")), "fewer", light=True)
        held += [finer, parts, fewer]
        if fewer.isEmpty():
            break
        listed.append(level.join(fewer, "token", "left_anti"))
        chosen = finer.join(fewer.select(F.col("token").alias("parent")), "parent", "left_semi")
        level = common.materialise(chosen.select("token", "tokens", "id", "n").distinct(), "level")
        held.append(level)
    out = _union([x.select("token", "id", "n") for x in [*listed, level]])
    return out.join(tails.select("id", "prefix"), "id").select("token", "id", "n", F.lit(1).alias("matches"), "prefix"), held


def _by_difference(compared: DataFrame, stars: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs under one leader c that can be linked though one of them isn't linked to it.

    With w = den * lacks + num * adds and k = (den - num) * |c|, a document is linked to c if w <= k, and x and y are linked if
    (den + num) * |D(x) & D(y)| >= w(x) + w(y) - k. What either side knows of that bounds the part of its difference that must
    meet the other's: its first ones, additions before lacks, since those are mostly its own, both in compare()'s order. Where two meet, what is left of both
    differences must reach the bound. Documents that stars already connect are left out."""
    both = num + den
    tag = lambda c, t: F.transform(c, lambda h: F.struct(F.lit(t).alias("tag"), h.alias("token")))
    d = compared.filter(F.size("lacks") + F.size("adds") > 0).join(_small(stars, stars.count()), "id", "left")
    d = d.select("hub", "id", F.coalesce("component_id", "id").alias("top"), "linked", ((den - num) * F.col("hub_n")).alias("k"), (den * F.size("lacks") + num * F.size("adds")).cast("long").alias("w"), F.concat(tag("adds", 0), tag("lacks", 1)).alias("d"))

    def side(rows: DataFrame, need: str, name: str) -> DataFrame:
        part = F.slice("d", F.lit(1), F.greatest(F.size("d") - F.expr(f"cast({need} as int)") + 1, F.lit(0)))
        named = rows.select("hub", "k", F.col("id").alias(name), F.col("top").alias("top_" + name), F.col("w").alias("w_" + name), F.size("d").alias("n_" + name), F.posexplode(part).alias("at_" + name, "e"))
        return named.select("*", "e.tag", "e.token").drop("e")

    apart = (F.col("top_x") != F.col("top_y")) & (F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) * both >= F.col("w_x") + F.col("w_y") - F.col("k"))
    keys = ["hub", "k", "tag", "token"]
    near, open_ = d.filter("linked"), d.filter("not linked")
    one = side(near, f"floor(w / {both}) + 1", "x").join(side(open_, f"greatest(1, ceil((w - k) / {both}))", "y"), keys).filter(apart)
    order = F.struct("w_x", "x") < F.struct(F.col("w_y").alias("w_x"), F.col("y").alias("x"))
    none = side(open_, f"greatest(1, ceil((2 * w - k) / {both}))", "x").join(side(open_, f"floor(w / {both}) + 1", "y"), keys).filter(apart & order)
    return one.union(none).select(F.least("x", "y").alias("hub"), F.greatest("x", "y").alias("id")).distinct()


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs of anything but space and the controls 09-0D, with A-Z lower-cased. Sets of `width`-word shingles at
    least num/den similar are linked; component_id is the smallest doc_id reachable. A text shorter than a shingle is one
    shingle. Null and empty texts have none and are linked with nothing. Equal sets are one class, compared once. Rows with the same
    doc_id count as one document. A null doc_id has its n_shingles and no component. An empty table gives an empty result."""
    with common.small_batches(docs.sparkSession):
        return _components_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, num, den)


def _components_of(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(sketch(docs, width)))  # 2**SKETCH_BITS bytes
    table = common.materialise(describe(docs, classes, width, num, den), "sets")
    known = table.filter("n > 0 and doc_id is not null")
    copies = known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = common.materialise(copies, "copies", light=True)
    copies = _small(copies, copies.count())
    sets = known.join(copies, "key", "left").filter("rep is null or rep = doc_id")
    postings = sets.select(F.explode(F.slice("prefix", F.lit(1), F.col("length"))).alias("token"), F.col("doc_id").alias("id"), "n", "matches", "rarity")
    buckets = postings.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("rarity", "id", "n")).alias("lead")).filter("docs > 1")
    met = postings.join(buckets, "token").select("token", "id", "n", "matches", "rarity", "docs", F.col("lead.id").alias("hub"), F.col("lead.n").alias("hub_n"))
    met = common.materialise(met, "buckets")
    plain = ["token", "id", "n", "matches"]
    small = common.materialise(_direct(met.filter(f"docs <= {SMALL}").select(*plain), num, den), "direct", light=True)
    best = small.filter("shared >= needed").groupBy("id").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub")).select("hub", "id")
    rest, tables, far, held = met.filter(f"docs > {SMALL}"), [], [], []
    limit, many = NEAR + 1 - num / den, rest.count()
    for k in range(ROUNDS):
        # Sizes alone put a document beyond the reach of all that is near the leader.
        reach = F.least("n", "hub_n") >= (1 - limit) * F.greatest("n", "hub_n")
        ask = rest.filter(reach & (F.col("hub") != F.col("id"))).select("hub", "id")
        done = compare(ask if k else ask.union(best), docs, classes, width, num, den, True)
        tables.append(done)
        # What is near the leader meets all that it can be linked with in the index of differences. The rest meets again.
        seen = done.select("hub", "id", "distance")
        left = rest.filter("hub <> id").join(_small(seen, seen.count()), ["hub", "id"], "left").filter(f"coalesce(distance > {NEAR}, true)")
        left = common.materialise(left.select(*plain, "rarity"), "left", light=True)
        held.append(left)
        if left.isEmpty():
            rest = left
            break
        again = left.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("rarity", "id", "n")).alias("lead")).filter("docs > 1")
        rest = common.materialise(left.join(again, "token").withColumns({"hub": F.col("lead.id"), "hub_n": F.col("lead.n")}).drop("lead"), "buckets", light=True)
        held.append(rest)
        far.append(rest.filter(f"docs <= {SMALL}").select(*plain))
        rest = rest.filter(f"docs > {SMALL}")
        before, many = many, rest.count()
        if 2 * many > before or not many:  # leaders that resemble few of their bucket are no help
            break

    compared = _union(tables)
    stars = components(compared.filter("linked").select(F.col("hub").alias("a"), F.col("id").alias("b")))
    # A pair's shared shingles may lie in small buckets and in ones that became so: its count is over both, each listed once.
    counted = small
    if not all(f.isEmpty() for f in far):
        both = small.union(_direct(_union(far), num, den))
        counted = both.groupBy("hub", "id").agg(F.sum("shared").alias("shared"), F.min("needed").alias("needed"))
    asked = [counted.filter("shared >= needed").select("hub", "id"), common.materialise(_by_difference(compared, stars, num, den), "differing", light=True)]
    if not rest.isEmpty():
        finer, written = _split(rest, sets, num, den)
        held += written
        asked.append(common.materialise(_direct(finer, num, den).select("hub", "id"), "split", light=True))
    mine, other = stars.select(F.col("id").alias("hub"), F.col("component_id").alias("ca")), stars.select("id", F.col("component_id").alias("cb"))
    n_stars = stars.count()
    ask = _union(asked).join(_small(mine, n_stars), "hub", "left").join(_small(other, n_stars), "id", "left").filter("coalesce(ca, hub) <> coalesce(cb, id)").select("hub", "id")
    last = compare(ask, docs, classes, width, num, den, False)
    found = components(_union([stars.select(F.col("component_id").alias("a"), F.col("id").alias("b")), last.filter("linked").select(F.col("hub").alias("a"), F.col("id").alias("b"))]))
    common.discard(met, small, *held, *tables, *asked, stars, last)
    classes.destroy()
    out = table.join(copies, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("id"))
    out = out.join(_small(found, found.count()), "id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """Of each component of jaccard_components the document with the smallest id; all columns. Rows without an id stay, of rows with one id the first by text."""
    found = common.materialise(jaccard_components(docs, **options).select("doc_id", "component_id"), "kept")
    go = common.materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    repeated = not found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    common.discard(found)
    kept = docs.join(_small(go, go.count()), docs["doc_id"].cast("long") == F.col("_id"), "left_anti")
    if repeated:
        rest = [c for c in docs.columns if c != "doc_id"]
        one = kept.filter("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.coalesce("text", F.lit(""))).alias("_r")).select("doc_id", "_r.*").select(*docs.columns)
        kept = one.unionByName(kept.filter("doc_id is null"))
    return kept
