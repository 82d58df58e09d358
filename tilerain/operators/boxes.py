"""Joins of overlapping boxes on a grid with levels.

A box lives on the level whose squares are just larger than it, so it touches at most four of them, whatever its size. Two
boxes meet on the coarser level of the two: the larger one at home, the smaller one as a visitor. Squares with many boxes
are cut into parts: one side's boxes are dealt to the parts, the other's repeated for each.

Where only figures on the boxes that a box overlaps are asked for, they come from sums over corners and no pair is made.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smallest level; points live there. A square of level n is 2 ** n wide.
FINEST = -20
#: Boxes of one side that meet in one part of a square at most, on average.
PART_ROWS = 4096
#: Hot squares up to this number are broadcast; beyond it they are joined like any table.
BROADCAST_SQUARES = 50_000
#: Boxes of one side in a slab, about, and slabs of an axis at most; ends of one side that meet in one part of a slab at most.
SLAB_ROWS, SLABS, SLAB_PART_ROWS = 1 << 16, 256, 1 << 18

_SQUARE = ["_role", "_lv", "_gx", "_gy"]


def overlaps(a: Column, b: Column, strict: bool = False) -> Column:
    """Box overlap of two bbox structs; `strict` leaves out boxes that only touch."""
    if strict:
        return ((a.minx < b.maxx) & (a.maxx > b.minx) & (a.miny < b.maxy) & (a.maxy > b.miny))
    return ((a.minx <= b.maxx) & (a.maxx >= b.minx) & (a.miny <= b.maxy) & (a.maxy >= b.miny))


def _usable(df: DataFrame, box: str) -> DataFrame:
    """Boxes with finite, ordered sides."""
    b = F.col(box)
    finite = F.abs(b.minx) + F.abs(b.maxx) + F.abs(b.miny) + F.abs(b.maxy) < F.lit(float("inf"))
    return df.where(finite & (b.minx <= b.maxx) & (b.miny <= b.maxy))


def _levelled(df: DataFrame, box: str, finest: int) -> DataFrame:
    """Boxes with finite, ordered sides and their level."""
    b = F.col(box)
    side = F.greatest(b.maxx - b.minx, b.maxy - b.miny)
    level = F.greatest(F.ceil(F.log2(F.nullif(side, F.lit(0.0)))), F.lit(finest))
    return _usable(df, box).withColumn("_own", F.coalesce(level, F.lit(finest)).cast("int"))


def _levels(left: DataFrame, right: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Boxes by level of both sides: a row per level reaches the driver, some thirty for sizes from a millimetre to the globe."""
    rows = left.select(F.lit(0).alias("side"), "_own").union(right.select(F.lit(1).alias("side"), "_own"))
    found = rows.groupBy("side", "_own").agg(F.count(F.lit(1)).alias("n")).collect()
    return tuple({r["_own"]: r["n"] for r in found if r["side"] == side} for side in (0, 1))


def _listed(df: DataFrame, box: str, own: dict[int, int], others: dict[int, int], home: int, strictly: bool) -> DataFrame:
    """A row per square. At home, under role `home`, if the other side has a box that is not coarser (with `strictly`, the
    left side's rule: it hosts equals, the right side hosts finer ones only); and as a visitor, under the other role, on each
    of the other side's coarser levels."""
    b, places = F.col(box), []
    for level in sorted(own):
        hosts = any(n <= level if strictly else n < level for n in others)
        spots = [(home, level)] * hosts + [(1 - home, n) for n in sorted(others) if (n > level if strictly else n >= level)]
        listed = F.array(*[F.struct(F.lit(role).alias("_role"), F.lit(n).alias("_lv")) for role, n in spots])
        places += [F.lit(level), listed.cast("array<struct<_role:int,_lv:int>>")]
    if not places:
        places = [F.lit(0), F.array().cast("array<struct<_role:int,_lv:int>>")]
    side = F.pow(F.lit(2.0), F.col("_lv"))
    return (df.withColumn("_at", F.explode(F.element_at(F.create_map(*places), F.col("_own")))).select("*", "_at.*")
            .withColumn("_gx", F.explode(F.sequence(F.floor(b.minx / side), F.floor(b.maxx / side))))
            .withColumn("_gy", F.explode(F.sequence(F.floor(b.miny / side), F.floor(b.maxy / side)))).drop("_at", "_own"))


def _hot_squares(left: DataFrame, right: DataFrame, keys: list[str], part_rows: int) -> DataFrame | None:
    """(keys, _p, _q): into how many parts the left and the right boxes of a square are dealt, where that is more than one.

    None if there is no such square. A list of at most BROADCAST_SQUARES is broadcast, a longer one stays a table.
    """
    counted = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_nl"), (right, "_nr"))]
    hot = counted[0].join(counted[1], keys).where(F.greatest("_nl", "_nr") > part_rows).select(
        *keys, F.ceil(F.col("_nl") / part_rows).alias("_p"), F.ceil(F.col("_nr") / part_rows).alias("_q"))
    first = hot.limit(BROADCAST_SQUARES + 1).collect()
    if not first:
        return None
    return hot if len(first) > BROADCAST_SQUARES else F.broadcast(left.sparkSession.createDataFrame(first, hot.schema))


def _dealt(df: DataFrame, hot: DataFrame, keys: list[str], own: str, other: str, by: Sequence[str]) -> DataFrame:
    """Adds `_i`, `_j`: the row's own part, and one row for each part of the other side."""
    n, m = F.coalesce(f"_{own}", F.lit(1)), F.coalesce(f"_{other}", F.lit(1))
    mine = F.when(n > 1, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), n)).otherwise(F.lit(0))
    names = ("_i", "_j") if own == "p" else ("_j", "_i")
    return (df.join(hot, keys, "left").withColumn(names[0], mine)
            .withColumn(names[1], F.explode(F.sequence(F.lit(0).cast("bigint"), m - 1))).drop("_p", "_q"))


def dominated(x: np.ndarray, y: np.ndarray, weights: np.ndarray, upto: np.ndarray, ceiling: np.ndarray, strict: bool) -> np.ndarray:
    """Sums of the rows of `weights` whose x is among the first `upto` in order and whose y is at most (`strict`: below)
    `ceiling`. Points come sorted by x. A wavelet matrix over the ranks of y: a pass over points and questions per bit."""
    n = len(x)
    total = np.zeros((len(upto), weights.shape[1]), np.int64)
    if not n or not len(upto):
        return total
    order = np.argsort(y, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    below = np.searchsorted(y[order], ceiling, side="left" if strict else "right")
    low, high = np.zeros(len(upto), np.int64), upto.astype(np.int64)
    for bit in range(n.bit_length() - 1, -1, -1):
        one = rank >> bit & 1 == 1
        zeros = np.concatenate(([0], np.cumsum(~one)))
        part = np.concatenate((np.flatnonzero(~one), np.flatnonzero(one)))
        rank, weights = rank[part], weights[part]
        sums = np.concatenate((np.zeros((1, weights.shape[1]), np.int64), np.cumsum(weights, axis=0)))
        low0, high0 = zeros[low], zeros[high]
        up = below >> bit & 1 == 1
        total[up] += sums[high0[up]] - sums[low0[up]]
        low, high = np.where(up, zeros[-1] + low - low0, low0), np.where(up, zeros[-1] + high - high0, high0)
    return total


def _weights(value: np.ndarray, known: np.ndarray) -> np.ndarray:
    """n, known values, and the two halves of their sum: columns whose sums don't overflow."""
    value = np.where(known, value, 0)
    return np.stack((np.ones(len(value), np.int64), known.astype(np.int64), value >> 32, value & 0xFFFFFFFF), axis=1)


def _values(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


#: Corners of a box as (end of x, end of y).
_CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def _corner_counts(xs: np.ndarray, ys: np.ndarray):
    """Sums of the weights of right boxes by corner and slabs of it, only those that have any."""
    def run(batches):
        for b in batches:
            x, y = ((np.searchsorted(cuts, b.column(i).to_numpy()), np.searchsorted(cuts, b.column(i + 2).to_numpy()))
                    for cuts, i in ((xs, 0), (ys, 1)))
            weights = _weights(*_values(b.column(4)))
            for corner, (i, j) in enumerate(_CORNERS):
                cell = x[i].astype(np.int64) * (len(ys) + 1) + y[j]
                cells, at = np.unique(cell, return_inverse=True)
                sums = np.zeros((len(cells), 4), np.int64)
                np.add.at(sums, at, weights)
                yield pa.record_batch([pa.array(np.full(len(cells), corner, np.int32)), pa.array(cells), *(pa.array(c) for c in np.ascontiguousarray(sums.T))],
                                      ["corner", "cell", "n", "known", "high", "low"])
    return run


def _ends(xs: np.ndarray, ys: np.ndarray, asks: bool, kept: list[str]):
    """Four rows a box: (_axis, _end, _slab), the coordinate `c` that an end has there and the interval `a`..`b` on the other axis.

    The lower ends of right boxes meet the upper ones of left boxes, which ask. On axis 0 the coordinates are those of the boxes;
    on axis 1 the interval is one of slabs, and a left box asks for what lies in slabs before its own.
    """
    def run(batches):
        for b in batches:
            minx, miny, maxx, maxy = (b.column(i).to_numpy() for i in range(4))
            slabs = [[np.searchsorted(cuts, side).astype(np.int32) for side in pair] for cuts, pair in ((xs, (minx, maxx)), (ys, (miny, maxy)))]
            # a left box overlaps what starts by its end and doesn't end before its start
            before = 0.5 if asks else 0.0
            others = (miny, maxy), (slabs[0][0].astype(np.float64), slabs[0][1] - before)
            for axis, pair in enumerate(((minx, maxx), (miny, maxy))):
                for end in (0, 1):
                    mine = 1 - end if asks else end
                    heads = [pa.array(np.full(b.num_rows, v, np.int32)) for v in (axis, end)]
                    yield pa.record_batch([*heads, pa.array(slabs[axis][mine]), *(pa.array(v) for v in (pair[mine], *others[axis])),
                                           *b.columns[4:]], ["_axis", "_end", "_slab", "c", "a", "b", *kept])
    return run


def _answers(ys: np.ndarray, table: np.ndarray, per: list[str], dealt: bool):
    """What the ends of one part of a slab add to the sums of the left boxes that ask there."""
    def run(keys, asking, held):
        axis, end, slab = (k.as_py() for k in keys[:3])
        order = np.argsort(held["c"].to_numpy(), kind="stable")
        c, a, b = (held[n].to_numpy()[order] for n in "cab")
        weights = _weights(*(v[order] for v in _values(held["_value"])))
        upto = np.searchsorted(c, asking["c"].to_numpy(), side="left" if end else "right")
        start, stop = asking["a"].to_numpy(), asking["b"].to_numpy()
        sums = dominated(c, a, weights, upto, stop, False) - dominated(c, b, weights, upto, start, True)
        # slabs before on both axes: added once, by the first part of the right side
        if axis == 0 and not (dealt and keys[4].as_py()):
            sums += table[2 * end, slab, np.searchsorted(ys, stop)] - table[2 * end + 1, slab, np.searchsorted(ys, start)]
        some = sums.any(axis=1)
        columns = np.ascontiguousarray((sums[some] * (1 - 2 * end)).T)
        return pa.table([*(asking[n].filter(pa.array(some)) for n in per), *(pa.array(v) for v in columns)],
                        names=[*per, "_n", "_known", "_high", "_low"])
    return run


def _cuts(left: DataFrame, right: DataFrame, slabs: int) -> list[np.ndarray]:
    """Bounds of the slabs of both axes, from approximate quantiles of either side; they decide on speed, not on results."""
    shares = [i / (slabs // 2) for i in range(1, slabs // 2)]
    found = [df.approxQuantile(["minx", "miny", "maxx", "maxy"], shares, 0.25 / slabs) if shares else [[]] * 4 for df in (left, right)]
    return [np.unique(np.array([*found[0][2 + i], *found[1][i]], np.float64)) for i in (0, 1)]


def overlap_totals(left: DataFrame, right: DataFrame, per: Sequence[str], value: str, part_rows: int = SLAB_PART_ROWS,
                   slab_rows: int = SLAB_ROWS) -> DataFrame:
    """per, n, total: number of pairs `box_overlap` (not strict) gives for the columns `per` of `left`, and the sum of the
    long column `value` of `right` over them; only where there are pairs.

    A box overlaps those that start by its end but for those that end before its start, on each axis. So its sums are four
    sums over corners of right boxes that lie below and left of a corner of its own: (axis 0) those in the same slab of x,
    (axis 1) those in slabs of x before and the same slab of y, and, from a table of slabs times slabs, those before on both.
    Every box is four rows, and a part of a slab is counted in n log n steps. Slabs with more than `part_rows` ends of a side
    are cut into parts as crowded squares are; the slabs grow in number with the input, up to SLABS.
    """
    def sides(df, box, *kept):
        return _usable(df, box).select(*[F.col(f"{box}.{s}").cast("double").alias(s) for s in ("minx", "miny", "maxx", "maxy")], *kept)
    asking = sides(left, "bbox", *per)
    held = sides(right, "box", F.col(value).cast("long").alias("_value"))
    most = max(asking.count(), held.count())
    slabs = min(SLABS, max(1, most // slab_rows))
    xs, ys = _cuts(asking, held, slabs)
    # at most 4 * SLABS * SLABS sums, whatever the input
    table = np.zeros((4, (len(xs) + 1) * (len(ys) + 1), 4), np.int64)
    counts = held.mapInArrow(_corner_counts(xs, ys), "corner int, cell long, n long, known long, high long, low long")
    corner, cell, *sums = counts.groupBy("corner", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "known", "high", "low")]).toArrow().columns
    table[corner.to_numpy(), cell.to_numpy()] = np.stack([s.to_numpy() for s in sums], axis=1)
    inner = table.reshape(4, len(xs) + 1, len(ys) + 1, 4).cumsum(axis=1).cumsum(axis=2)
    before = np.zeros_like(inner)
    before[:, 1:, 1:] = inner[:, :-1, :-1]
    keys, heads = ["_axis", "_end", "_slab"], "_axis int, _end int, _slab int, c double, a double, b double"
    kept = asking.select(*per)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    rows = [asking.mapInArrow(_ends(xs, ys, True, list(per)), f"{heads}, {types}"),
            held.mapInArrow(_ends(xs, ys, False, ["_value"]), f"{heads}, _value long")]
    parts = []
    hot = _hot_squares(*rows, keys, part_rows) if most > part_rows else None
    if hot is not None:
        rows = [_dealt(df, hot, keys, own, other, c) for df, own, other, c in zip(rows, "pq", "qp", (["c", "a", "b", *per], ["c", "a", "b", "_value"]))]
        parts = ["_i", "_j"]
    met = rows[0].groupBy(*keys, *parts).cogroup(rows[1].groupBy(*keys, *parts))
    sums = met.applyInArrow(_answers(ys, before, list(per), bool(parts)), f"{types}, _n long, _known long, _high long, _low long")
    sums = sums.groupBy(*per).agg(*[F.sum(c).alias(c) for c in ("_n", "_known", "_high", "_low")]).where("_n > 0")
    whole = F.expr("cast(cast(_high AS decimal(38,0)) * 4294967296 + _low AS bigint)")
    return sums.select(*per, F.col("_n").alias("n"), F.when(F.col("_known") > 0, whole).alias("total"))


def box_overlap(left: DataFrame, right: DataFrame, strict: bool = True, on: Sequence[str] = (), finest: int = FINEST,
                part_rows: int = PART_ROWS, per: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Pairs of overlapping boxes, columns `bbox` -> left and `box` -> right, that agree on the columns `on` if given.

    A pair is kept only in the square of its level that holds the lower-left corner of the intersection, so nothing has to
    be made distinct. Squares with more than `part_rows` boxes of a side are cut into parts of about that size; which part a
    row goes to follows from a hash of its columns. Boxes with a null, infinite or reversed side overlap nothing.

    With `per` and `total` the result is one row for each value of the left columns `per`: per, n, total, as `overlap_totals`
    finds them without the pairs. That form takes boxes that touch and no columns `on`.
    """
    if per:
        if strict or on or total is None:
            raise ValueError("figures per left box need strict=False, a column `total` and no columns `on`")
        return overlap_totals(left, right, per, total)
    a, b = _levelled(left, "bbox", finest), _levelled(right, "box", finest)
    mine, theirs = _levels(a, b)
    by = [[c for c, t in df.dtypes if "map<" not in t] for df in (left, right)]
    # role 0: the left box at home, role 1: the right box at home and the left one finer
    rows = [_listed(a, "bbox", mine, theirs, 0, True), _listed(b, "box", theirs, mine, 1, False)]
    keys = [*on, *_SQUARE]
    parts = []
    if max(sum(mine.values()), sum(theirs.values())) > part_rows:
        hot = _hot_squares(*rows, keys, part_rows)
        if hot is not None:
            rows = [_dealt(df, hot, keys, own, other, c) for df, own, other, c in zip(rows, "pq", "qp", by)]
            parts = ["_i", "_j"]
    p, q, side = F.col("bbox"), F.col("box"), F.pow(F.lit(2.0), F.col("_lv"))
    corner = ((F.floor(F.greatest(p.minx, q.minx) / side) == F.col("_gx"))
              & (F.floor(F.greatest(p.miny, q.miny) / side) == F.col("_gy")))
    return rows[0].join(rows[1], [*keys, *parts]).where(overlaps(p, q, strict) & corner).drop(*_SQUARE, *parts)
