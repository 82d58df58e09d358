"""Approximate nearest neighbours along shifted Hilbert curves."""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilerain.llm.common import stored

#: Curves, projected dimensions and bits of each.
CURVES, DIMS, BITS = 8, 6, 8
#: Rows of one block of an ordering.
BLOCK = 512
#: Queries whose true neighbours set the window width, and rows that set the scale of the projections.
SAMPLE_QUERIES, SAMPLE_ROWS = 96, 4096
#: Share of the sample's true neighbours that some window must hold.
TARGET = 0.96


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points with integer coordinates (rows of `cells`)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            flip = (x[i] & bit) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    gray, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        gray = np.where(x[n - 1] & bit, gray ^ (bit - 1), gray)
        bit >>= 1
    x ^= gray
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1 if n else 1)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b; equal rows give equal values wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _smallest_ids(k: int):
    """Folds rows (vector, ids) to one row per distinct vector with its k smallest ids and its number of rows."""
    def out(held):
        vectors = list(held)
        return pa.record_batch([pa.array([np.frombuffer(v, np.float64).tolist() for v in vectors], pa.list_(pa.float64())),
                                pa.array([held[v][0] for v in vectors], pa.list_(pa.int64()))], ["vec", "ids"])

    def fold(batches):
        held: dict[bytes, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for row, ids in zip(_matrix(batch.column(0)), batch.column(1).to_pylist()):
                one = held.setdefault(row.tobytes(), [[]])
                one[0] = heapq.nsmallest(k, one[0] + ids)
            if len(held) > 50_000:  # folded again after the shuffle
                yield out(held)
                held = {}
        if held:
            yield out(held)
    return fold


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, vec of the rows that take part: an id, no null or non-finite component, not zero, and of the usual length
    (that of most rows; of equally frequent ones the largest)."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("vec"))
    inf = float("inf")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))
    rows = rows.where("id IS NOT NULL AND vec IS NOT NULL").where(finite & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0]["size"] if sizes else 0))


def _orderings(distinct: DataFrame, curves: int, seed: int) -> DataFrame:
    """curve, node, rank: the place of every vector in each ordering.

    Keys are range-partitioned and ranked inside their partitions; one count per partition and curve shifts the ranks.
    """
    sample = [r["vec"] for r in distinct.orderBy(F.xxhash64("node")).limit(SAMPLE_ROWS).select("vec").collect()]
    if not sample:
        return distinct.select(F.lit(0).alias("curve"), "node", F.lit(0).cast("long").alias("rank"))
    unit = np.array(sample)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    size, rng = unit.shape[1], np.random.default_rng(seed)
    dims = min(DIMS, size)
    maps = []
    for _ in range(curves):
        turn = np.linalg.qr(rng.standard_normal((size, size)))[0][:, :dims]
        spread = np.maximum((unit @ turn).std(axis=0), 1e-12)
        maps.append((turn, spread, rng.uniform(-0.5, 0.5, dims)))

    def keys(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            for c, (turn, spread, shift) in enumerate(maps):
                cells = np.clip((x @ turn / spread + shift + 3.5) / 7 * (1 << BITS), 0, (1 << BITS) - 1)
                yield pa.record_batch([pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_keys(cells, BITS)),
                                       batch.column(0)], ["curve", "key", "node"])
    keyed = distinct.select("node", "vec").mapInArrow(keys, "curve int, key long, node long")
    parts = stored(keyed.repartitionByRange("curve", "key", "node").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("curve", "part").orderBy("key", "node")
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    shift = counts.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return (parts.withColumn("rank", F.row_number().over(own) - 1).join(shift, ["curve", "part"])
            .select("curve", "node", (F.col("rank") + F.col("shift")).alias("rank")))


def _top(scores: np.ndarray, nodes: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best by falling score, ties to the smaller node."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge - 1e-12)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((nodes[some], -scores[some]))][:k]


def _nearest(queries: np.ndarray, q_nodes: np.ndarray, cands: np.ndarray, c_nodes: np.ndarray, k: int):
    """query, node, score of the k best candidates of each query, itself included."""
    qn = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    cn = cands / np.linalg.norm(cands, axis=1, keepdims=True)
    out = []
    for at in range(0, len(qn), 256):
        rough = qn[at:at + 256] @ cn.T
        for i, scores in enumerate(rough):
            best = _top(scores, c_nodes, k)
            exact = _cosines(np.broadcast_to(queries[at + i], cands[best].shape), cands[best])
            out.append((np.full(len(best), q_nodes[at + i]), c_nodes[best], exact))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _triples(found) -> pa.RecordBatch:
    return pa.record_batch([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())],
                           ["query", "node", "score"])


def _best_per_query(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    return found.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _window(distinct: DataFrame, ranks: DataFrame, queries: DataFrame, k: int) -> int:
    """The rank distance within which, on some curve, TARGET of the true neighbours of sampled queries lie.

    The sample is bounded; its queries are compared with every vector.
    """
    rows = queries.orderBy(F.xxhash64("node")).limit(SAMPLE_QUERIES).select("node", "vec").collect()
    if not rows:
        return 0
    nodes, vecs = np.array([r["node"] for r in rows]), np.array([r["vec"] for r in rows])

    def exact(batches):
        for batch in batches:
            if batch.num_rows:
                yield _triples(_nearest(vecs, nodes, _matrix(batch.column(1)), batch.column(0).to_numpy(), k + 1))
    found = distinct.select("node", "vec").mapInArrow(exact, "query long, node long, score double")
    true = _best_per_query(found.where("query <> node"), k).select("query", "node")
    apart = (true.join(ranks.select("curve", "node", F.col("rank").alias("there")), "node")
             .join(ranks.select("curve", F.col("node").alias("query"), F.col("rank").alias("here")), ["curve", "query"])
             .groupBy("query", "node").agg(F.min(F.abs(F.col("here") - F.col("there"))).alias("d")))
    d = sorted(r["d"] for r in apart.select("d").collect())  # at most SAMPLE_QUERIES * k figures
    return int(d[min(len(d) - 1, math.ceil(TARGET * len(d)))]) if d else 0


def _blocks(k: int):
    """Over the sorted rows of a partition: compares the queries of each block with its vectors."""
    def run(batches):
        held, key = [], None
        def flush():
            rows = pa.concat_tables(held).combine_chunks()
            asks = rows.column("asks").to_numpy()
            node, vec = rows.column("node").to_numpy(), _matrix(rows.column("vec"))
            return _triples(_nearest(vec[asks], node[asks], vec[~asks], node[~asks], k))
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            keys = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if key is not None and tuple(keys[a]) != key:
                    yield flush()
                    held = []
                key = tuple(keys[a])
                held.append(part.slice(a, b - a))
        if held:
            yield flush()
    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
                       curves: int = CURVES, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, by cosine, ties to the smaller id.

    Several Hilbert orderings of randomly turned and shifted projections are range-partitioned; a query looks at the
    blocks around its place in each ordering, and what the windows hold is merged and ranked by exact cosines. Every
    vector is indexed. The width of the windows is measured, not fixed: on a bounded sample of queries it is the rank
    distance that holds 96 % of the true neighbours on some curve. Clustered vectors need narrow windows; for vectors
    without structure the windows grow with the table, as nearness along a line then says little.

    Equal vectors are indexed once with their k + 1 smallest ids, which is all that a result can name, so a vector that a
    third of the rows share costs as much as any other. `is_query` is a condition on the id column. Rows with a null id
    or vector, a null or non-finite component, only zeros or an unusual length take no part. A query with fewer than k
    others gets all of them; an empty table gives no rows. An id that stands on several rows counts as one candidate for
    each distinct vector.
    """
    rows = stored(usable(vectors, vec_id, embedding))
    one = rows.select("vec", F.array("id").alias("ids"))
    folded = one.mapInArrow(_smallest_ids(k + 1), "vec array<double>, ids array<long>")
    folded = folded.repartition(F.xxhash64("vec")).mapInArrow(_smallest_ids(k + 1), "vec array<double>, ids array<long>")
    # a node is a distinct vector, named by a hash of it
    distinct = stored(folded.groupBy("vec").agg(F.flatten(F.collect_list("ids")).alias("ids"))
                      .select(F.xxhash64("vec").alias("node"), "vec", F.slice(F.sort_array(F.array_distinct("ids")), 1, k + 1).alias("ids")))
    asking = rows.where(is_query).select(F.col("id").alias("query_id"), F.xxhash64("vec").alias("node"))
    queries = stored(distinct.join(asking.select("node").distinct(), "node", "left_semi").select("node", "vec"))
    ranks = stored(_orderings(distinct, curves, seed))
    reach = math.ceil(_window(distinct, ranks, queries, k) / BLOCK)
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    spots = ranks.select("curve", block.alias("block"), "node")
    held = spots.join(distinct.select("node", "vec"), "node").select("curve", "block", F.lit(False).alias("asks"), "node", "vec")
    asks = (spots.join(queries, "node").select("curve", F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)).alias("block"),
                                               F.lit(True).alias("asks"), "node", "vec"))
    found = (held.union(asks).repartition("curve", "block").sortWithinPartitions("curve", "block")
             .mapInArrow(_blocks(k + 1), "query long, node long, score double"))
    best = _best_per_query(found, k + 1)
    named = (best.join(distinct.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = named.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    return (asking.distinct().join(lists.withColumnRenamed("query", "node"), "node")
            .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "x"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")))
