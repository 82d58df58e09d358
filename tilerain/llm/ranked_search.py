"""Ranked lexical search: bit-sliced Bloom signatures bound the score of every document, and only what they can't rule out is
read again and scored exactly."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilerain.llm.common import mapped, stored

#: Results per item.
BEST = 20
#: Bits and hash functions of a signature per key it holds.
BITS, HASHES = 12, 6
#: A term is signed once for each of these counts that it reaches; from the last one on they grow by half.
LEVELS = [1, 2, 3, 4, 6, 9, 14, 21, 32, 48, 72]
while LEVELS[-1] < 1 << 40:
    LEVELS.append(LEVELS[-1] * 3 // 2)
#: A shard of the index is closed at this many keys or documents, the counts of a task's terms at this many terms.
SHARD_KEYS, SHARD_DOCS, KNOWN_TERMS = 1 << 18, 4096, 300_000
#: Items are answered in blocks of at most this many items and terms; a block is sent to all tasks.
BLOCK_ITEMS, BLOCK_TERMS = 2000, 50_000
#: Distinct terms whose bounds are held at once, and documents per item that are scored first to learn a threshold.
GROUP_TERMS, PROBES = 1024, 40

#: A-Z to a-z; all ASCII characters but letters and digits to a blank. Bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_INDEX = "term binary, df long, size int, docs int, top long, ids array<long>, lengths array<long>, slices binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: maximal runs of letters, digits and non-ASCII characters, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    """The HASHES slices of each key (64-bit hashes) in a signature of `size` bits."""
    with np.errstate(over="ignore"):
        step = (keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        at = keys[..., None] + step[..., None] * np.arange(HASHES, dtype=np.uint64)
        return ((at >> np.uint64(17)) % np.uint64(size)).astype(np.int64)


def _level_keys(hashes: np.ndarray, level) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (hashes ^ (np.asarray(level).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ x >> np.uint64(32)


class _Shard:
    """Documents with about the same number of keys, one column each; a slice is the row of one signature bit over all."""

    def __init__(self):
        self.ids, self.lengths, self.keys, self.n_keys, self.top = [], [], [], 0, 0

    def add(self, doc_id, length: int, keys: np.ndarray, top: int):
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.keys.append(keys)
        self.n_keys += len(keys)
        self.top = max(self.top, top)

    def row(self) -> dict:
        size, docs = max(map(len, self.keys)) * BITS + 64, len(self.ids)
        bits = np.zeros((size, (docs + 7) // 8 * 8), np.uint8)
        column = np.repeat(np.arange(docs), [len(k) for k in self.keys])
        bits[_places(np.concatenate(self.keys), size).ravel(), np.repeat(column, HASHES)] = 1
        return {"size": size, "docs": docs, "top": self.top, "ids": self.ids, "lengths": self.lengths,
                "slices": np.packbits(bits, axis=1).tobytes()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"term": pa.binary(), "df": pa.int64(), "size": pa.int32(), "docs": pa.int32(), "top": pa.int64(),
             "ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "slices": pa.binary()}
    return pa.record_batch([pa.array([r.get(c) for r in rows], t) for c, t in types.items()], list(types))


def signed(docs: DataFrame) -> DataFrame:
    """The index of documents(doc_id, text), built in one pass and stored: shards of signatures, and in further rows (`term` is
    not null) how many documents of a task hold a term. Documents without terms are not in it."""
    levels = np.array(LEVELS, np.int64)

    def run(batches):
        known: dict[bytes, int] = {}
        hashes: list[int] = []
        df = np.zeros(KNOWN_TERMS * 2, np.int64)
        shards: dict[int, _Shard] = {}

        def counted():
            words = list(known)
            for at in range(0, len(words), 20_000):
                part = words[at:at + 20_000]
                yield pa.record_batch([
                    pa.array(part, pa.binary()), pa.array(df[at:at + len(part)], pa.int64()), pa.nulls(len(part), pa.int32()),
                    pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.list_(pa.int64())),
                    pa.nulls(len(part), pa.list_(pa.int64())), pa.nulls(len(part), pa.binary())],
                    ["term", "df", "size", "docs", "top", "ids", "lengths", "slices"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                counts = Counter(words)
                at = []
                for word in counts:
                    i = known.get(word)
                    if i is None:
                        known[word] = i = len(hashes)
                        hashes.append(xxhash.xxh64_intdigest(word))
                    at.append(i)
                if len(known) > len(df):
                    df = np.concatenate([df, np.zeros(len(known), np.int64)])
                at = np.array(at, np.int64)
                df[at] += 1
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                reached = np.searchsorted(levels, tf, "right")
                base = np.array([hashes[i] for i in at], np.uint64)
                level = np.arange(int(reached.sum())) - np.repeat(np.cumsum(reached) - reached, reached)
                keys = _level_keys(np.repeat(base, reached), level)
                shard = shards.setdefault(len(keys).bit_length(), _Shard())
                shard.add(doc_id, len(words), keys, int(tf.max()))
                if shard.n_keys >= SHARD_KEYS or len(shard.ids) >= SHARD_DOCS:
                    yield _batch([shards.pop(len(keys).bit_length()).row()])
                if len(known) >= KNOWN_TERMS:
                    yield from counted()
                    known, hashes = {}, []
                    df[:] = 0
        for shard in shards.values():
            yield _batch([shard.row()])
        yield from counted()
    return stored(mapped(docs, run, _INDEX))


def _weights(index: DataFrame, terms: list[bytes], n_docs: int) -> dict[bytes, int]:
    """The weights of some terms, from how many documents hold each; terms of no document have none."""
    wanted = index.sparkSession.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    held = (index.where("term IS NOT NULL").select("term", "df").join(F.broadcast(wanted), "term", "left_semi")
            .groupBy("term").agg(F.sum("df").alias("df")))
    return {bytes(r["term"]): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in held.collect()}


def _gain(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class _Bounds:
    """Upper bounds of the scores of the items over a shard. Items come as (terms' places in `terms`, weights times repeats)."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], terms: list[bytes], n_docs: int, n_terms: int):
        self.items, self.n_docs, self.n_terms = items, n_docs, n_terms
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64)
        self.groups, group, held = [], [], set()
        for i, (at, _) in enumerate(items):
            if group and len(held | set(at.tolist())) > GROUP_TERMS:
                self.groups.append((group, np.array(sorted(held), np.int64)))
                group, held = [], set()
            group.append(i)
            held |= set(at.tolist())
        if group:
            self.groups.append((group, np.array(sorted(held), np.int64)))

    def of(self, shard: dict):
        """(item, bound per document) for each item with terms."""
        docs, size = shard["docs"], shard["size"]
        slices = np.frombuffer(shard["slices"], np.uint8).reshape(size, -1)
        lengths = np.array(shard["lengths"], object if max(shard["lengths"]) * self.n_docs >= 1 << 58 else np.int64)
        m = (75 + (25 * lengths * self.n_docs) // self.n_terms).astype(np.int64)
        top = int(np.searchsorted(LEVELS, shard["top"], "right"))
        gains = [_gain(np.int64(min(LEVELS[level + 1] - 1, shard["top"])), m) for level in range(top)]
        slopes = [gains[0].astype(float), *((b - a).astype(float) for a, b in zip(gains, gains[1:]))]
        for group, held in self.groups:
            part = np.zeros((len(held), docs))
            alive, hashes, before = np.arange(len(held)), self.hashes[held], None
            for level in range(top):
                hit = np.bitwise_and.reduce(slices[_places(_level_keys(hashes[alive], level), size)], axis=1)
                hit = hit if before is None else hit & before
                some = hit.any(axis=1)
                alive, before = alive[some], hit[some]
                if not len(alive):
                    break
                part[alive] += np.unpackbits(before, axis=1, count=docs) * slopes[level]
            for i in group:
                at, weights = self.items[i]
                if len(at):
                    yield i, weights @ part[np.searchsorted(held, at)]


def _probed(index: DataFrame, bounds: _Bounds) -> DataFrame:
    """The documents of the highest bounds of each item: item, doc_id."""
    def run(batches):
        best: dict[int, tuple[np.ndarray, list]] = {}
        for batch in batches:
            for shard in batch.to_pylist():
                for i, bound in bounds.of(shard):
                    some = np.argpartition(-bound, PROBES)[:PROBES] if len(bound) > PROBES else np.arange(len(bound))
                    values, ids = best.get(i, (np.zeros(0), []))
                    values, ids = np.concatenate([values, bound[some]]), ids + [shard["ids"][d] for d in some]
                    keep = np.argsort(-values, kind="stable")[:PROBES]
                    best[i] = values[keep], [ids[d] for d in keep]
        rows = [(i, d, float(v)) for i, (values, ids) in best.items() for v, d in zip(values, ids) if v > 0]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                               pa.array([r[2] for r in rows], pa.float64())], ["item", "doc_id", "bound"])
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
    shards = index.where("term IS NULL").drop("term", "df")
    return (mapped(shards, run, "item int, doc_id long, bound double").withColumn("nth", F.row_number().over(order))
            .where(F.col("nth") <= PROBES).select("item", "doc_id"))


def _not_excluded(index: DataFrame, bounds: _Bounds, least: dict[int, int]) -> DataFrame:
    """Every (item, doc_id) whose bound reaches the item's threshold. The bounds add whole numbers below 2 ** 53 in doubles; the
    slack covers sums beyond."""
    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                items, ids = [], []
                for i, bound in bounds.of(shard):
                    for d in np.flatnonzero(bound * (1 + 1e-12) >= least.get(i, 1)):
                        items.append(i)
                        ids.append(shard["ids"][d])
                yield pa.record_batch([pa.array(items, pa.int32()), pa.array(ids, pa.int64())], ["item", "doc_id"])
    return mapped(index.where("term IS NULL").drop("term", "df"), run, "item int, doc_id long")


def _scored(docs: DataFrame, pairs: DataFrame, items: list[tuple[list[bytes], list[int]]], n_docs: int, n_terms: int) -> DataFrame:
    """item, doc_id, score of the given pairs, from the whole texts: exact, above 0. Pairs fold to one row per document first,
    whose list holds at most the items of a block."""
    wanted = stored(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items"))
                    .select(F.col("doc_id").alias("wanted_id"), "items"))
    rows = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted_id"])).select("doc_id", "text", "items")

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, some in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                counts = Counter(words)
                m = 75 + (25 * len(words) * n_docs) // n_terms
                for i in some.as_py():
                    score = 0
                    for term, weight in zip(*items[i]):
                        tf = counts.get(term)
                        if tf:
                            score += weight * _gain(tf, m)
                    if score > 0:
                        out.append((i, doc_id, score))
            yield pa.record_batch([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))],
                                  ["item", "doc_id", "score"])
    return mapped(rows, run, "item int, doc_id long, score long")


def _blocks(items: DataFrame):
    """Items in blocks of bounded size: lists of (item_id, counts of its terms)."""
    block, held = [], set()
    for row in items.toLocalIterator(prefetchPartitions=False):
        counts = Counter(terms_of(row["text"]))
        if block and (len(block) >= BLOCK_ITEMS or len(held) + len(counts) > BLOCK_TERMS):
            yield block
            block, held = [], set()
        block.append((row["item_id"], counts))
        held |= counts.keys()
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the `best` highest-scoring documents of each item, equal scores by ascending id.

    One pass over the texts builds the index: per shard of documents, bit-sliced Bloom signatures of (term, count reached),
    and partial document counts of all terms. For each block of items the slices of the terms, combined and weighted, give
    an upper bound of every document's score. The documents of the highest bounds are scored exactly, the `best`-th score
    among them is a threshold, and every document whose bound reaches it is scored exactly from its whole text. So no
    document is left out that could be in the result.

    Items are read one after another in blocks; each block is one search over all shards. Repeated items are answered each,
    items without terms (null, empty) not at all. Texts without terms are never found. Rows of one doc_id are scored each and
    all keep their place; null ids come first among equal scores. Empty tables give no rows; further columns play no part.
    """
    session = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    items = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    index = signed(docs)
    size = index.where("term IS NULL").agg(F.sum("docs").alias("n"),
                                           F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("l")).first()
    schema = "item_id long, rank int, doc_id long, score long"
    if not size["n"]:
        return session.createDataFrame([], schema)
    n_docs, n_terms = int(size["n"]), int(size["l"])
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    answers = None
    for block in _blocks(items):
        terms = sorted({t for _, counts in block for t in counts})
        if not terms:
            continue
        weights = _weights(index, terms, n_docs)
        terms = [t for t in terms if weights.get(t, 0) > 0]
        place = {t: i for i, t in enumerate(terms)}
        exact, rough = [], []
        for _, counts in block:
            mine = [t for t in counts if t in place]
            exact.append((mine, [weights[t] * counts[t] for t in mine]))
            at = np.array([place[t] for t in mine], np.int64)
            rough.append((at, np.array(exact[-1][1], float)))
        bounds = _Bounds(rough, terms, n_docs, n_terms)
        first = _scored(docs, _probed(index, bounds), exact, n_docs, n_terms)
        nth = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == best)
        least = {r["item"]: r["score"] for r in nth.select("item", "score").collect()}
        found = _scored(docs, _not_excluded(index, bounds, least), exact, n_docs, n_terms)
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        names = session.createDataFrame([(i, block[i][0]) for i in range(len(block))], "item int, item_id long")
        answer = stored(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        answers = answer if answers is None else answers.union(answer)
    return session.createDataFrame([], schema) if answers is None else answers
