"""Near-duplicate texts by SimHash and meet-in-the-middle ball hashing."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilerain.llm.common import mapped, stored, text_of
from tilerain.llm.components import components

#: Members of a bucket that one comparison block holds; a larger bucket is dealt out as pairs of blocks.
BLOCK = 1024
#: Multipliers of the published splitmix64 finaliser (fixed values).
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
GOLDEN = 0x9E3779B97F4A7C15
#: Three parts of the 32 bits of a half: values within two bits of each other agree in one of them. The number of the part
#: stands in a key above the tag of the half.
PARTS, PART_SHIFT = (0x7FF, 0x7FF << 11, 0x3FF << 22), 56
#: Pieces whose variants a task holds at once.
KEYED = 1 << 15
#: Bands of least hashes, and least hashes in each: a pair of Jaccard index 0.8 shares a band with chance 0.9999.
BANDS, BAND_ROWS = 30, 6
#: Standard deviations by which the distance of candidates may exceed the expected one.
SLACK = 5
_FACTORS = np.random.default_rng(1618).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _tables(h: np.ndarray, tables: int) -> np.ndarray:
    """tables x n hashes: the first is h itself, the others are mixed from it."""
    salts = np.array([GOLDEN * t & 0xFFFFFFFFFFFFFFFF for t in range(1, tables)], np.uint64)
    x = h + salts[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return np.concatenate((h[None], x ^ (x >> np.uint64(31))))


def _majority(h: np.ndarray) -> list[int]:
    """Per row of h (tables x n) the 64 bits that are set in more than half of its hashes.

    Bits are added as whole words: three words of one weight become their sum and a carry of twice the weight, until the
    words left of each weight are quicker to count one by one (at most 255, which a byte can count).
    """
    total = np.zeros((len(h), 64), np.int64)
    words, weight = h, 1
    while words is not None:
        carries = []
        while words.shape[1] > 255 or len(h) * words.shape[1] > 768:
            third = words.shape[1] // 3
            a, b, c = (words[:, i * third:(i + 1) * third] for i in range(3))
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            words = np.concatenate((odd ^ c, words[:, 3 * third:]), axis=1)
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(h), -1, 8), axis=2, bitorder="little")
        total += weight * bits.reshape(len(h), -1, 64).sum(axis=1, dtype=np.uint8).astype(np.int64)
        words, weight = np.concatenate(carries, axis=1) if carries else None, 2 * weight
    return np.packbits(total * 2 > h.shape[1], axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def shingle_hashes(text: str, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles of one text in their order, repeated ones as often as they stand."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:len(words) - k])).tolist()
    stops = (ends[k - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def simhash(text: str, shingle: int = 3, tables: int = 1, seed: int = 42) -> list[int]:
    """The fingerprints of one text, 64 bits for each table."""
    h = shingle_hashes(text, shingle, seed)
    return _majority(_tables(h, tables)) if len(h) else [0] * tables


def least_hashes(distinct: np.ndarray) -> list[int]:
    """One number for each of BANDS bands: a hash of BAND_ROWS least hashes of a set of shingles. Two sets of Jaccard index s
    agree in a band with chance s ** BAND_ROWS."""
    least = np.full(BANDS * BAND_ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(distinct), 1024):
        x = distinct[at:at + 1024, None] * _FACTORS
        np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0), out=least)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, tables: int = 1,
                 seed: int = 42) -> DataFrame:
    """doc_id, prints (array of 64-bit fingerprints as signed longs, one for each table) per row of `docs`."""
    def run(batches):
        for batch in batches:
            prints = [simhash(t, shingle, tables, seed) for t in batch.column(1).to_pylist()]
            flat = np.array(prints, np.uint64).reshape(-1).view(np.int64)
            offsets = pa.array(np.arange(0, len(flat) + 1, tables, dtype=np.int32))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "prints"])
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    return mapped(rows, run, "doc_id long, prints array<long>")


def _pieces(prints: Column, tables: int) -> Column:
    """The 32-bit halves of all tables, each under its own tag in the bits above."""
    halves = []
    for t in range(tables):
        halves.append(prints[t].bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(2 * t << 32).cast("long")))
        halves.append(F.shiftrightunsigned(prints[t], 32).bitwiseOR(F.lit((2 * t + 1) << 32).cast("long")))
    return F.array(*halves)


def _neighbours(part: int) -> list[int]:
    """The bits of a half outside of one of its PARTS."""
    return [i for i in range(32) if not PARTS[part] >> i & 1]


def _met(batches):
    """Of the keyed pieces of a partition: each variant that several of one key send, and its senders as a mask. Where pieces
    come with `root` and `several`, only the variants whose senders have more than one root."""
    read = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if not read:
        return
    keys, pieces, *known = (np.concatenate(x) for x in zip(*read))
    read.clear()
    order = np.argsort(keys, kind="stable")
    keys, pieces, *known = (x[order] for x in (keys, pieces, *known))
    at = 0
    while at < len(keys):
        # whole keys of one part; a key beyond KEYED pieces goes in slices of its variants
        first_of_next = np.searchsorted(keys, ((keys[at] >> PART_SHIFT) + 1) << PART_SHIFT)
        end = min(at + KEYED, first_of_next)
        if end < first_of_next and keys[end] == keys[end - 1]:
            end = np.searchsorted(keys, keys[end])
            end = end if end > at else np.searchsorted(keys, keys[at], side="right")
        some, bits = pieces[at:end], _neighbours(int(keys[at] >> PART_SHIFT))
        slices = -(-len(some) // KEYED)
        for part in range(slices):
            variants, senders, rows = [], [], []
            for mask, flip in ((1, 0), *((1 << i + 1, 1 << i) for i in bits)):
                variant, row = some ^ flip, np.arange(len(some), dtype=np.int32)
                if slices > 1:
                    own = (variant.view(np.uint64) * np.uint64(GOLDEN) >> np.uint64(40)) % np.uint64(slices) == part
                    variant, row = variant[own], row[own]
                variants.append(variant)
                senders.append(np.full(len(variant), mask, np.int64))
                rows.append(row)
            variants, senders, rows = np.concatenate(variants), np.concatenate(senders), np.concatenate(rows)
            order = np.argsort(variants)
            variants, senders, rows = variants[order], senders[order], rows[order]
            again = variants[1:] == variants[:-1]
            head = np.flatnonzero(np.concatenate((again, [False])) & ~np.concatenate(([False], again)))
            if len(head):
                inside = np.concatenate(([False], again)) | np.concatenate((again, [False]))
                starts = np.cumsum(inside)[head] - 1
                masks = np.bitwise_or.reduceat(senders[inside], starts)
                found = variants[head]
                if known:
                    root, several = (x[at:end][rows[inside]] for x in known)
                    apart = np.logical_or.reduceat(several, starts) | (np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts))
                    found, masks = found[apart], masks[apart]
                yield pa.record_batch([pa.array(found), pa.array(masks)], ["variant", "senders"])
        at = end


def _meetings(values: DataFrame) -> DataFrame:
    """bucket, piece: of the distinct values(piece) those that meet others at a variant one bit away from both, or equal to one.

    All values within two bits of each other meet. A variant has at most 33 senders, itself and its neighbours, so it
    gathers them as bits of one mask: bit 0 for itself, bit i + 1 for the neighbour at bit i. Any two senders of a variant
    agree in one of three PARTS of their bits, and the variant with them: values are dealt by each part, three rows for a
    value, and make their variants inside the tasks, by one key at a time. The masks of the parts fold to the whole one,
    and no variant is a hot key. Two senders meet at two variants; the smaller one keeps them, which holds for the senders
    up to the highest one whose bit is clear in the variant.

    Where `values` has `root`, a root of the nodes of a value, and `several`, whether they have more than that one, values
    whose nodes all have one root need not meet: the tasks leave out the variants at which no two roots come together.
    """
    known = [c for c in ("root", "several") if c in values.columns]
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = F.array(*[F.col("piece").bitwiseAND(F.lit(p | 0xFFFFFF << 32)).bitwiseOR(F.lit(i << PART_SHIFT).cast("long")) for i, p in enumerate(PARTS)])
    found = values.select(F.explode(keyed).alias("key"), "piece", *known).repartition(tasks, "key").mapInArrow(_met, "variant long, senders long")
    met = found.groupBy("variant").agg(F.bit_or("senders").alias("senders"))
    below = F.col("senders").bitwiseAND(F.bitwise_not(F.col("variant") * 2)).bitwiseAND(F.lit((1 << 33) - 2))
    for step in (1, 2, 4, 8, 16, 32):
        met = met.withColumn("below", below)
        below = F.col("below").bitwiseOR(F.shiftrightunsigned("below", step))
    met = met.select("variant", F.col("senders").bitwiseAND(below).alias("senders")).where("bit_count(senders) > 1")
    bit = F.explode(F.filter(F.array(*[F.lit(i) for i in range(33)]), lambda i: F.call_function("bit_get", "senders", i) == 1)).alias("bit")
    piece = F.expr("CASE WHEN bit = 0 THEN variant ELSE variant ^ shiftleft(1L, bit - 1) END")
    return met.select("variant", bit).select(F.col("variant").alias("bucket"), piece.alias("piece"))


def _verified(limit: int):
    """Within the sorted groups of a partition: compares members and sends a spanning star per verified cluster."""
    def groups(batches):
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            whole = pa.concat_tables([rest, part]) if rest is not None else part
            if whole.num_rows == 0:
                continue
            keys = np.stack([whole.column(i).to_numpy() for i in range(3)], axis=1)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cut = int(change[-1]) if len(change) else 0
            if cut:
                yield whole.slice(0, cut), np.concatenate(([0], change[:-1], [cut]))
            rest = whole.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            keys = np.stack([rest.column(i).to_numpy() for i in range(3)], axis=1)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            yield rest, np.concatenate(([0], change, [rest.num_rows]))

    def run(batches):
        for rows, bounds in groups(batches):
            node = rows.column(3).to_numpy()
            prints = np.stack(rows.column(4).combine_chunks().flatten().to_numpy().reshape(len(node), -1), axis=1)
            prints = prints.view(np.uint64) if prints.dtype != np.uint64 else prints
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            label = np.arange(len(node))
            left, right = [], []
            live, step = np.arange(len(node)), 1
            while True:
                live = live[live + step < len(node)]
                live = live[group[live] == group[live + step]]
                if not len(live):
                    break
                apart = sum(np.bitwise_count(p[live] ^ p[live + step]).astype(np.int32) for p in prints)
                near = live[(apart <= limit) & (node[live] != node[live + step])]
                left.append(near)
                right.append(near + step)
                step += 1
            if not left:
                continue
            left, right = np.concatenate(left), np.concatenate(right)
            while True:  # smallest index reached, within the groups of this batch
                low = np.minimum(label[left], label[right])
                new = label.copy()
                np.minimum.at(new, left, low)
                np.minimum.at(new, right, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            moved = label != np.arange(len(node))
            a, b = node[moved], node[label[moved]]
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])
    return run


def links(prints: DataFrame, tables: int = 1, limit: int = 3, named: bool = True) -> DataFrame:
    """Verified links a, b between the nodes of prints(node long, prints array<long>), enough to connect whatever is linked.

    Nodes are compared where some half of theirs differs by two bits at most: the balls of radius one around such halves
    meet. (Two fingerprints within three bits always have such a half.) Equal halves send one ball. Nodes of a bucket are
    compared in blocks; a bucket of more than `BLOCK` members becomes pairs of blocks, so no task holds a hot bucket and no
    pair is written out.

    A column `root` of `prints` names what is connected already: a bucket whose nodes all have one root can add nothing and is
    not opened. Values know the roots of their nodes, so such buckets are left out before any node is joined to its buckets: a
    group of near copies that is connected already costs its values, and no row for each node and variant.
    """
    known = ["root"] if "root" in prints.columns else []
    pieces = prints.select("node", *known, F.explode(_pieces(F.col("prints"), tables)).alias("piece"))
    several = [x for k in known for x in (F.min(k).alias(k), (F.min(k) < F.max(k)).alias("several"))]
    values = stored(pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), *several))
    # nodes with an equal half meet in a bucket of its own
    alike = values.where("n > 1 AND several" if known else "n > 1").select((-F.col("piece") - 1).alias("bucket"), "piece")
    shared = stored(_meetings(values).union(alike).join(pieces, "piece").select("bucket", "node", *known))
    counted = [F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cells"), *[f(k).alias(f"{n}_{k}") for k in known for n, f in (("low", F.min), ("high", F.max))]]
    sizes = shared.groupBy("bucket").agg(*counted)
    for k in known:
        sizes = sizes.where(F.col(f"low_{k}") < F.col(f"high_{k}"))
    shared = shared.drop(*known).join(sizes.select("bucket", "cells"), "bucket")
    # with one table the node is the fingerprint, if so `named`; else the few rows that share a bucket fetch theirs
    shared = shared.withColumn("prints", F.array("node")) if tables == 1 and named else shared.join(prints.select("node", "prints"), "node")
    cell = F.pmod(F.xxhash64("node", "bucket"), F.col("cells")).cast("int")
    dealt = (shared.withColumn("cell", cell).select("node", "prints", "bucket", "cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
             .select("bucket", F.least("cell", "other").cast("long").alias("i"), F.greatest("cell", "other").cast("long").alias("j"), "node", "prints"))
    return (dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
            .mapInArrow(_verified(limit), "a long, b long"))


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, tables: int = 1,
                   limit: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits of the first table), component_id (smallest doc_id reachable) per row of `docs`.

    Words are split at ASCII white space after lower-casing A-Z; repeated shingles count as often as they stand; a text
    of fewer words is one shingle, one without words has fingerprint zero and links like any other. With one table and
    `limit` 3 every pair of fingerprints at three or fewer differing bits is linked. With more tables the distance is that
    of all 64 * tables bits and a pair is found when some half agrees but for two bits; `simhash_recall` gives the chance.

    Null texts count as empty. Null ids never become a component_id unless a component holds no other. Repeated rows share
    a component. An empty table gives no rows; further columns play no part.
    """
    rows = stored(fingerprints(docs, text, doc_id, shingle, tables, seed))
    node = F.col("prints")[0] if tables == 1 else F.xxhash64("prints")
    rows = rows.select("doc_id", "prints", node.alias("node"))
    distinct = rows.groupBy("node", "prints").agg(F.min("doc_id").alias("owner"))
    if tables == 1:
        # the node is the fingerprint itself
        roots = components(links(distinct.select("node", "prints"), 1, limit))
    else:
        roots = components(links(distinct.select("node", "prints").dropDuplicates(["node"]), tables, limit))
    owned = distinct.groupBy("node").agg(F.min("owner").alias("owner"))
    rooted = owned.join(roots, "node", "left").select("node", "owner", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("owner").alias("component_id")), "root").select("node", "component_id")
    return rows.join(named, "node").select("doc_id", F.lower(F.lpad(F.hex(F.col("prints")[0]), 16, "0")).alias("fingerprint"),
                                           "component_id")


def simhash_recall(share: float, tables: int) -> float:
    """The chance that a pair whose fingerprints differ in this share of bits is found with so many tables."""
    same = 1 - share
    two = same ** 32 + 32 * share * same ** 31 + 496 * share ** 2 * same ** 30
    return 1 - (1 - two) ** (2 * tables)


def candidate_recall(similarity: float, tables: int) -> float:
    """The least chance that a pair of this Jaccard index, with no third text between, is compared exactly: by a shared band or
    by its fingerprints (whose distance limit is left out here)."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return 1 - (1 - similarity ** BAND_ROWS) ** BANDS * (1 - simhash_recall(share, tables))


def _sketches(rows: DataFrame, shingle: int, tables: int, seed: int) -> DataFrame:
    """node, prints, bands per row of rows(node, body)."""
    def run(batches):
        for batch in batches:
            prints, bands = [], []
            for t in batch.column(1).to_pylist():
                h = shingle_hashes(t, shingle, seed)
                prints.append(_majority(_tables(h, tables)) if len(h) else [0] * tables)
                bands.append(least_hashes(np.unique(h)))
            lists = []
            for found, n in ((prints, tables), (bands, BANDS)):
                flat = np.array(found, np.uint64).reshape(-1).view(np.int64)
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), pa.array(flat)))
            yield pa.record_batch([batch.column(0), *lists], ["node", "prints", "bands"])
    return mapped(rows.select("node", "body"), run, "node long, prints array<long>, bands array<long>")


def exact_links(nodes: list[int], texts: list[str], similarity: float, shingle: int, seed: int = 42) -> list[tuple[int, int]]:
    """Links between texts whose sets of word shingles have a Jaccard index of `similarity` or more, enough to connect
    whatever such pairs connect.

    A text of n shingles and any such other one share one of the rarest n - similarity * n + 1 of the first (in an order
    common to all), so only texts that do are compared. Pairs that are connected already are not compared again.
    """
    sets = [np.unique(shingle_hashes(t, shingle, seed)) for t in texts]
    full = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    _, at, counts = np.unique(full, return_inverse=True, return_counts=True)
    order = np.empty(len(counts), np.int64)
    order[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    holders: dict[int, list[int]] = {}
    rare = counts == 1
    found, empty = [], None
    for i, mine in enumerate(sets):
        n = len(mine)
        if not n:
            if empty is not None:
                found.append((nodes[i], nodes[empty]))
            empty = i
            continue
        own = at[bounds[i]:bounds[i + 1]]
        own = own[np.argsort(order[own])][:n - int(np.ceil(similarity * n - 1e-9)) + 1]
        own = own[~rare[own]].tolist()
        for j in sorted(set().union(*(holders.get(k, ()) for k in own)), reverse=True):
            a, b = find(i), find(j)
            if a == b or min(n, len(sets[j])) < similarity * max(n, len(sets[j])) - 1e-9:
                continue
            both = len(np.intersect1d(mine, sets[j], assume_unique=True))
            if both >= similarity * (n + len(sets[j]) - both) - 1e-9:
                root[a] = b
                found.append((nodes[i], nodes[j]))
        for k in own:
            holders.setdefault(k, []).append(i)
    return found


def _compared(similarity: float, shingle: int, seed: int):
    """Within the sorted blocks (cluster, i, j) of a partition: links by the exact index."""
    def run(batches):
        block, nodes, texts = None, [], []

        def done():
            pairs = exact_links(nodes, texts, similarity, shingle, seed)
            return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])
        for batch in batches:
            for *key, node, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if key != block:
                    if len(nodes) > 1:
                        yield done()
                    block, nodes, texts = key, [], []
                nodes.append(node)
                texts.append(body)
        if len(nodes) > 1:
            yield done()
    return run


def near_links(rows: DataFrame, shingle: int = 5, tables: int = 8, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """Links a, b between the nodes of rows(node long, body string), one row a node, whose sets of word shingles have a
    Jaccard index of `similarity` or more; enough to connect whatever such pairs connect.

    Fingerprints and bands of least hashes only say which texts are compared: a text and the smallest node of each of its
    bands, and fingerprints that are near with `SLACK` standard deviations to spare, are candidates. Candidates that hang
    together form a cluster, and all texts of a cluster are compared exactly, in blocks of `BLOCK`. What bands connect is
    known when fingerprints are compared, so these only look for what lies between such clusters.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * tables
    limit = int(bits * share + SLACK * (bits * share * (1 - share)) ** 0.5)
    sketches = stored(_sketches(rows, shingle, tables, seed))
    bands = sketches.select("node", F.explode("bands").alias("band"))
    hubs = bands.groupBy("band").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "b")
    stars = bands.join(hubs, "band").select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    banded = stored(components(stars).withColumnRenamed("root", "band_root"))
    rooted = sketches.join(banded, "node", "left").select("node", "prints", F.coalesce("band_root", "node").alias("root"))
    near = links(stored(rooted), tables, limit, named=False)
    roots = stored(components(banded.select(F.col("node").alias("a"), F.col("band_root").alias("b")).union(near)))
    sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cells"))
    cell = F.pmod(F.xxhash64("node", "root"), F.col("cells")).cast("int")
    placed = roots.join(sizes, "root").withColumn("cell", cell)
    dealt = rows.join(placed, "node").select("node", "body", "root", "cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "node", "body")
    return (dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
            .mapInArrow(_compared(similarity, shingle, seed), "a long, b long"))


def one_of_each_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, tables: int = 8,
                      similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, that bear the smallest id of their near-duplicate group; ids are taken as unique.

    Texts are linked if the Jaccard index of their sets of word shingles, counted and not estimated, is `similarity` or more;
    a group is what links connect. Texts without words are equal. `candidate_recall` gives the chance that a pair is compared.
    """
    body = text_of(text)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("node"))
    owned = stored(rows.groupBy("node").agg(F.min("doc_id").alias("owner"), F.min("body").alias("body")))
    roots = components(near_links(owned.select("node", "body"), shingle, tables, similarity))
    rooted = owned.select("node", "owner").join(roots, "node", "left").select("owner", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("owner").alias("__kept_id")).select("__kept_id").distinct()
    return docs.join(kept, docs[f"`{doc_id}`"].cast("long").eqNullSafe(F.col("__kept_id")), "left_semi")
