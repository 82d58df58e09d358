"""Whitened principal components from exact covariances, recovered by polarisation."""

import math
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilerain.llm.common import mapped, stored

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components returned at most.
COMPONENTS = 8
#: Exact sums travel as signed parts of PART bits, which add up as longs for up to 2 ** 32 partial sums.
PART, PARTS = 31, 6
#: Rows of a block whose squares add up in 64 bits as long as no centred entry reaches SMALL.
BLOCK_ROWS, SMALL = 2000, 1 << 24
#: Components whose variance is below this share of the largest are rounding and can't be whitened.
RANK = 1e-13
_PART_COLUMNS = [f"p{i}" for i in range(PARTS)]


def grid(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are usable, and floor(SCALE * c) of the usable ones as long, zeros after the end of a short vector."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    first, sizes = ends[0], np.diff(ends)
    flat = lists.values.slice(first, ends[-1] - first).cast(pa.float64()).to_numpy(zero_copy_only=False)
    good = np.ones(len(lists), bool) if lists.null_count == 0 else lists.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    bad = ~np.isfinite(flat)  # nulls come as NaN
    good = good & (np.bincount(row[bad], minlength=len(lists)) == 0)
    dims = int(sizes[good].max(initial=0)) if dims is None else dims
    out = np.zeros((int(good.sum()), dims), np.int64)
    place = np.cumsum(good) - 1
    at = np.arange(len(flat)) - np.repeat(ends[:-1] - first, sizes)
    use = good[row]
    scaled = np.floor(SCALE * flat[use])
    out[place[row[use]], at[use]] = np.clip(scaled, -2.0 ** 62, 2.0 ** 62).astype(np.int64)
    return good, out


def _parts(value: int) -> list[int]:
    sign, value = (-1 if value < 0 else 1), abs(value)
    return [sign * (value >> PART * i & (1 << PART) - 1) for i in range(PARTS)]


def _whole(row) -> int:
    return sum(int(row[c] or 0) << PART * i for i, c in enumerate(_PART_COLUMNS))


def _rows(keys: list[tuple[int, int]], totals: list[int]) -> pa.RecordBatch:
    parts = [_parts(int(t)) for t in totals]
    return pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                            *(pa.array([p[i] for p in parts], pa.int64()) for i in range(PARTS))], ["i", "j", *_PART_COLUMNS])


_SUMS = "i int, j int, " + ", ".join(f"{c} long" for c in _PART_COLUMNS)


def _summed(vectors: DataFrame, fn) -> dict[tuple[int, int], int]:
    """Exact totals by (i, j) of the partial sums that each task of `fn` gives once, so what is shuffled and what reaches
    the driver is bounded by the number of dimension pairs."""
    rows = mapped(vectors, fn, _SUMS).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in _PART_COLUMNS))
    return {(r["i"], r["j"]): _whole(r) for r in rows.toLocalIterator()}


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors are usable, and the exact sum of floor(SCALE * c) in each dimension."""
    def run(batches):
        n, total = 0, np.zeros(0, object)
        for batch in batches:
            _, x = grid(batch.column(1))
            n += len(x)
            if x.shape[1] > len(total):
                total = np.concatenate([total, np.zeros(x.shape[1] - len(total), object)])
            big = np.abs(x).max(initial=0) >= 1 << 50
            total[:x.shape[1]] += (x.astype(object) if big else x).sum(axis=0) if len(x) else 0
        yield _rows([(-1, -1), *((i, -1) for i in range(len(total)))], [n, *total])
    found = _summed(vectors, run)
    return found.get((-1, -1), 0), [found[i, -1] for i in range(len(found) - 1)]


def squares(vectors: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums over the usable vectors, with d = floor(SCALE * c) - centre: of d_i ** 2 at (i, i), and of (d_i + d_j) ** 2 at
    (i, j) with i < j."""
    dims, middle = len(centre), np.array(centre, object)

    def run(batches):
        total = np.zeros((dims, dims), object)
        seen = False
        for batch in batches:
            _, x = grid(batch.column(1), dims)
            seen = seen or len(x) > 0
            for at in range(0, len(x), BLOCK_ROWS):
                d = x[at:at + BLOCK_ROWS].astype(object) - middle if max(map(abs, centre), default=0) >= 1 << 61 else x[at:at + BLOCK_ROWS] - middle.astype(np.int64)
                if d.dtype != object and np.abs(d).max(initial=0) >= SMALL:
                    d = d.astype(object)
                for i in range(dims):
                    both = d[:, i:] + d[:, i:i + 1]
                    both[:, 0] = d[:, i]
                    total[i, i:] += (both * both).sum(axis=0)
        if seen:
            keys = [(i, j) for i in range(dims) for j in range(i, dims)]
            yield _rows(keys, [total[k] for k in keys])
    return _summed(vectors, run)


def covariance(n: int, offset: list[int], square: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix, divisor n, from the sums of centred squares. `offset` holds the sums of d that rounding the
    centre to a whole number leaves. n ** 2 Var is a whole number for every dimension and every pair sum, and
    Var(i + j) - Var(i) - Var(j) = 2 Cov(i, j), so each entry is rounded once."""
    dims = len(offset)
    spread = [n * square[i, i] - offset[i] ** 2 for i in range(dims)]
    out = np.empty((dims, dims))
    for i in range(dims):
        out[i, i] = spread[i] / n ** 2
        for j in range(i + 1, dims):
            both = n * square[i, j] - (offset[i] + offset[j]) ** 2
            out[i, j] = out[j, i] = (both - spread[i] - spread[j]) / (2 * n ** 2)
    return out


def axes(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors as rows, the largest entry of each positive, without those of no variance."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(RANK * values.max(initial=0.0), 0.0)]
    rows = vectors[:, order].T
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]) if len(rows) else np.ones(0)
    return values[order], rows * signs[:, None]


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact of each usable vector and component.

    Three passes over the vectors: sums, squares of every dimension and of every sum of two dimensions (the covariances come
    out of their differences by polarisation), and the projection. The first two give one partial sum per task and pair,
    folded in Spark; only dims * (dims + 1) / 2 exact sums reach the driver. identity_error is the largest entry of the
    covariance of the whitened values, aggregated from them, minus the identity.

    Vectors that are null or hold a null or non-finite entry are left out; a shorter vector counts as followed by zeros, so
    an empty one is a vector of zeros. Ids are only carried: null and repeated ids keep their rows. Components without
    variance can't be whitened and aren't returned, so vectors that are all equal, one vector alone and an empty table
    give no rows. Entries beyond 2 ** 52 are cut to 2 ** 62 / SCALE. Where the deviation is beyond a long, `deviation` is null and
    deviation_exact (a string of digits) still holds it. Further columns play no part.
    """
    session = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    n, total = sums(rows)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
              "deviation_exact string")
    centre = [(2 * s + n) // (2 * n) for s in total] if n else []
    offset = [s - n * m for s, m in zip(total, centre)]
    v = covariance(n, offset, squares(rows, centre)) if centre else np.zeros((0, 0))
    values, base = axes(v, components) if centre else (np.zeros(0), np.zeros((0, 0)))
    k, trace = len(values), float(np.trace(v))
    if not k:
        return session.createDataFrame([], schema)
    dims, scaled = len(centre), base / np.sqrt(values)[:, None]
    middle, left, left_double = np.array(centre, object), np.array(offset, object), np.array([o / n for o in offset])

    def run(batches):
        for batch in batches:
            good, x = grid(batch.column(1), dims)
            d = x.astype(object) - middle
            reach = int(np.abs(d).max(initial=0))
            if reach < 1 << 52:
                d = d.astype(np.int64)
            if (n * reach + max(map(abs, offset))) ** 2 * dims < 1 << 62:
                away = n * d.astype(np.int64) - left.astype(np.int64)
            else:
                away = n * d.astype(object) - left
            deviation = [int(s) for s in (away * away).sum(axis=1)]
            w = (d.astype(float) - left_double) @ scaled.T
            yield pa.record_batch([
                batch.column(0).filter(pa.array(good)), pa.array([s if s < 1 << 63 else None for s in deviation], pa.int64()),
                pa.array([str(s) for s in deviation], pa.string()), *(pa.array(w[:, c], pa.float64()) for c in range(k))],
                ["vec_id", "deviation", "deviation_exact", *(f"w{c}" for c in range(k))])
    wide = stored(mapped(rows, run, "vec_id long, deviation long, deviation_exact string, " + ", ".join(f"w{c} double" for c in range(k))))
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    found = wide.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
    error = max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    parts = F.array(*(F.struct(F.lit(c + 1).alias("component"), F.col(f"w{c}").alias("whitened"),
                               F.lit(float(values[c]) / trace).alias("explained")) for c in range(k)))
    return (wide.select("vec_id", "deviation", "deviation_exact", F.explode(parts).alias("one"))
            .select("vec_id", "one.component", F.lit(n).cast("long").alias("n"), "deviation", "one.whitened", "one.explained",
                    F.lit(float(error)).alias("identity_error"), "deviation_exact"))
