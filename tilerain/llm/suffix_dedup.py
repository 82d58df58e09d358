"""Removal of long byte strings that occur more than once, by suffix sorting of the places where they can be."""

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilerain.llm.common import mapped, spill_file, stored, text_of
from tilerain.llm.induced import array_of, falling_suffixes

#: Bytes of a string that counts as repeated, and of the strings that mark where one can be.
LENGTH, GRAM = 400, 100
#: Offsets of a window to its mark that share a name; a mark whose strings outgrow a shard is renamed by the next fewer ones.
OFFSETS = (101, 26, 7, 1)
#: Bytes of strings that one shard sorts, about, and that one mark may bring.
SHARD_BYTES = 1 << 20
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 22
#: Odd multiplier of the rolling hash and its inverse modulo 2 ** 64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
LETTERS = np.random.default_rng(2718).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        made = []
        for base in (STEP, BACK):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[size] = made[0], made[1]
    up, down = _POWERS[size]
    return up[:n], down[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes at each place, from sums modulo 2 ** 64."""
    up, down = _powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTERS[data] * up, dtype=np.uint64)))
    h = (total[gram:] - total[:-gram]) * down[:len(data) - gram + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The marks of a text: place, hash, first and last start of the windows that each one marks.

    Every window of `length` bytes is marked by the first of its `gram`-byte strings with the smallest hash. The choice
    depends on the window's bytes alone, so equal windows have equal marks at the same offset.
    """
    found, width = [], length - gram + 1
    for low in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[low:low + CHUNK + length - 1]
        h = gram_hashes(part, gram)
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have < width:
            add = min(have, width - have)
            key = np.minimum(key[:len(key) - add], key[add:])
            have += add
        at = (key & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        found.append((at[first] + low, h[at[first]], first + low, last + low))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _marks(length: int, gram: int, offsets: int):
    """ra, rb, mark, low, size, digest: strings that hold the windows of each mark at similar offsets.

    Every window is in just one of them. `mark` names the mark, the range of offsets and the bytes that all windows at
    those offsets share: equal windows are in strings of the same name.
    """
    width = length - gram + 1

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for ra, rb, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if len(text) < length:
                    continue
                for p, h, first, last in zip(*(x.tolist() for x in anchors(np.frombuffer(text, np.uint8), length, gram))):
                    for part in range((p - last) // offsets, (p - first) // offsets + 1):
                        near, far = part * offsets, min(part * offsets + offsets, width) - 1
                        low, high = max(first, p - far), min(last, p - near) + length
                        mark = xxhash.xxh3_64_intdigest(text[p - near:p - far + length], h ^ part)
                        digest = xxhash.xxh3_64_intdigest(text[low:high])
                        for column, x in zip(out, (ra, rb, _signed(mark), low, high - low, _signed(digest))):
                            column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], ["ra", "rb", "mark", "low", "size", "digest"])
    return run


def _cut_out(batches):
    """The wanted strings of a text."""
    for batch in batches:
        out = [[], [], []]
        for text, wanted in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            for w in wanted:
                for column, x in zip(out, (w["mark"], w["digest"], text[w["low"]:w["low"] + w["size"]])):
                    column.append(x)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.binary()))], ["mark", "digest", "body"])


def repeated_starts(bodies, length: int = LENGTH):
    """Suffix-sorts the concatenation of byte strings and yields (string, offset) arrays of the starts whose `length` bytes
    start more than once in it. `bodies` is an iterator; the text and all that grows with it is kept in scratch files."""
    raw, starts, size = spill_file(), [0], 0
    for body in bodies:
        raw.write(body)
        raw.write(b"\0")
        size += len(body) + 1
        starts.append(size)
    raw.flush()
    if not size:
        return
    text = array_of(size + 1, np.uint16)
    raw.seek(0)
    for low in range(0, size, CHUNK):
        text[low:min(size, low + CHUNK)] = np.fromfile(raw, np.uint8, min(CHUNK, size - low)).astype(np.uint16) + 2
    starts = np.array(starts)
    text[starts[1:] - 1] = 1
    text[size] = 0
    raw.close()
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(pos: np.ndarray) -> None:
        which = np.searchsorted(starts, pos, side="right") - 1
        good = pos + length < starts[which + 1]  # not across the end of a string
        if good.any():
            found.append((which[good], (pos - starts[which])[good]))

    def out(pos: np.ndarray, lcp: np.ndarray) -> None:
        """Holds back the open group; groups that ended are settled."""
        follows = lcp >= length
        if kept and not follows[0]:
            flush()
        if not kept and not follows.any():
            kept.append((pos[-1:], np.zeros(1, bool)))
            return
        kept.append((pos, follows))
        if not follows[-1] and sum(len(p) for p, _ in kept) > CHUNK // 8:
            flush(last=True)

    def flush(last: bool = False) -> None:
        pos, follows = np.concatenate([p for p, _ in kept]), np.concatenate([f for _, f in kept])
        follows[0] = False
        kept.clear()
        inside = follows | np.concatenate((follows[1:], [False]))
        if inside.any():
            settle(pos[inside])
        if last:
            kept.append((pos[-1:], np.zeros(1, bool)))

    falling_suffixes(text, 258, length, out)
    if kept:
        flush()
    yield from found


def _shard(length: int):
    """Sorts the strings of a partition and sends the ranges of each that are repeated."""
    def run(batches):
        keys = array("q")

        def bodies():
            for batch in batches:
                for mark, digest, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    keys.extend((mark, digest))
                    yield body
        out = [[], [], [], []]
        stream = list_on_disk(bodies())
        if keys:
            parts = list(repeated_starts(stream, length))
            if parts:
                which, offset = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((offset, which))
                which, offset = which[order], offset[order]
                head = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (offset[1:] > offset[:-1] + 1))))
                tail = np.concatenate((head[1:] - 1, [len(which) - 1]))
                for w, a, b in zip(which[head].tolist(), offset[head].tolist(), offset[tail].tolist()):
                    for column, x in zip(out, (keys[2 * w], keys[2 * w + 1], a, b + length)):
                        column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], ["mark", "digest", "first", "last"])
    return run


def list_on_disk(bodies):
    """The strings of an iterator, written out at once and read back one by one."""
    file, sizes = spill_file(), []
    for body in bodies:
        file.write(body)
        sizes.append(len(body))
    file.seek(0)
    return (file.read(n) for n in sizes)


def _removed(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        out = [[], [], [], []]
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            digest, at, removed, spans, last = hashlib.sha256(), 0, 0, 0, -1
            for r in sorted((r["first"], r["last"]) for r in ranges or ()):
                if r[0] > last:
                    spans += 1
                    digest.update(text[at:r[0]])
                removed += max(0, r[1] - max(r[0], last))
                last = at = max(last, r[1])
            digest.update(text[at:])
            for column, x in zip(out, (len(text), removed, spans, digest.hexdigest())):
                column.append(x)
        yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3])], names)


def repeated_ranges(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """ra, rb, first, last: byte ranges of rows(doc_id, ra, rb, body) that strings which occur elsewhere cover. ra and rb
    together name a text.

    Marks, one for about 150 bytes, say where a repeated string can be; those that occur once are settled by a count.
    Equal strings of a mark are folded before anything wide moves, so a passage that a third of the texts share costs one
    string: what occurs twice as a whole is repeated as a whole. Strings of one mark that differ meet in the partition of
    their mark, whose suffixes are sorted outside of memory.

    Where the differing strings of a mark outgrow a shard (the edges of a passage that many texts share), they are themselves
    taken as texts with fewer offsets to a name, which parts those within the passage from those across its edge. The last
    name is that of a single window, where a count settles all: no mark is larger than a shard.
    """
    marks = stored(mapped(rows.select("ra", "rb", "body"), _marks(length, gram, offsets[0]), "ra long, rb long, mark long, low int, size int, digest long"))
    often = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("x"), F.max("digest").alias("y")).where("n > 1")
    marks = stored(marks.join(often.select("mark", (F.col("x") != F.col("y")).alias("mixed")), "mark"))
    groups = stored(marks.groupBy("mark", "digest", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ra", "rb", "low", "size")).alias("one")))
    open_marks = groups.where("mixed").groupBy("mark").agg(F.min("n").alias("least")).where("least = 1").select("mark")
    wanted = groups.where("mixed").join(open_marks, "mark", "left_semi").select("one.ra", "one.rb", F.struct("mark", "digest", "one.low", "one.size").alias("w"))
    sizes = stored(wanted.groupBy("w.mark").agg(F.sum("w.size").alias("bytes")).select("mark", (F.col("bytes") > SHARD_BYTES).alias("hot"), "bytes"))
    total = sizes.agg(F.sum(F.when(~F.col("hot"), F.col("bytes"))).alias("cold"), F.sum(F.when(F.col("hot"), F.col("bytes"))).alias("hot")).first()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(partitions, -(-(total["cold"] or 0) // SHARD_BYTES))
    wanted = wanted.groupBy("ra", "rb").agg(F.collect_list("w").alias("wanted"))
    # the same columns as in the last join of `without_repeats`, so that the texts are shuffled once for both
    texts = rows.join(wanted, ["ra", "rb"]).select("doc_id", "ra", "rb", "body", "wanted")
    # rows that share id and text cut out the same string twice, which is as good as its count
    pieces = mapped(texts, _cut_out, "mark long, digest long, body binary")
    narrower = None
    if total["hot"] and len(offsets) > 1:
        pieces = stored(pieces)
        hot = sizes.where("hot").select("mark")
        inner = pieces.join(hot, "mark", "left_semi").select(F.col("mark").alias("doc_id"), F.col("mark").alias("ra"), F.col("digest").alias("rb"), "body")
        narrower = repeated_ranges(inner, length, gram, offsets[1:]).select(F.col("ra").alias("mark"), F.col("rb").alias("digest"), "first", "last")
        pieces = pieces.join(hot, "mark", "left_anti")
    sorted_out = pieces.repartition(shards, "mark").mapInArrow(_shard(length), "mark long, digest long, first int, last int")
    if narrower is not None:
        sorted_out = sorted_out.union(narrower)
    whole = groups.where(F.col("n") > 1).select("mark", "digest", F.lit(0).alias("first"), F.col("one.size").alias("last"))
    ranges = whole.union(sorted_out).distinct()
    return marks.join(ranges, ["mark", "digest"]).select("ra", "rb", (F.col("low") + F.col("first")).alias("first"), (F.col("low") + F.col("last")).alias("last"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of `docs`.

    Texts are their UTF-8 bytes. Every byte is removed that lies in a string of `length` bytes which also starts anywhere
    else, in the same text or another; overlapping places count, and strings are judged on the input. Matches never cross
    texts. Null texts count as empty: nothing is removed and the digest is that of no bytes. Rows are neither merged nor
    dropped, repeated rows count as texts of their own, null ids are kept; an empty table gives no rows; further columns
    play no part.
    """
    body = text_of(text).cast("binary")
    ident = F.col(f"`{doc_id}`").cast("long")
    # a text is named by its id and a hash of it; rows that share both have the same ranges
    rows = docs.select(ident.alias("doc_id"), body.alias("body"), F.coalesce(ident, F.xxhash64(F.lit("none"), body)).alias("ra"), F.xxhash64(body).alias("rb"))
    lists = repeated_ranges(rows, length, gram).groupBy("ra", "rb").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    full = rows.join(lists, ["ra", "rb"], "left").select("doc_id", "body", "ranges")
    return mapped(full, _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
