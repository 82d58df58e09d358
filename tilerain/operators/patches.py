"""Patch positions, extraction and sampling.

Tiles come as rows of row-major channel arrays. Accepted corners are found inside the tile row, and windows are cut from
it a few at a time, so extraction is narrow and no generator copies a tile. Acceptance tests use summed-area tables: one
lookup of four corners per candidate, whatever the patch size.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilerain.functions.bands import d
from tilerain.functions.keys import KEY_SPACE, random_key
from tilerain.operators.ranking import integer_levels, ranked, ranked_by_key


def axis_positions(length: Column, size: int, stride: int) -> Column:
    """0, stride, 2 stride, ... and the last position that still fits."""
    last = length - size
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def fits(h: Column, w: Column, size: int) -> Column:
    return (h >= size) & (w >= size)


def require_fit(tiles: DataFrame, size: int) -> DataFrame:
    """Fails on a tile smaller than the patch."""
    text = F.format_string(f"no patch of {size} pixels fits tile %s of %s by %s", F.col("tile_id").cast("string"),
                           F.col("h").cast("string"), F.col("w").cast("string"))
    checked = F.when(fits(F.col("h"), F.col("w"), size), F.col("h")).otherwise(F.raise_error(text).cast("int"))
    return tiles.withColumn("h", checked)


def too_small(tiles: DataFrame, size: int) -> DataFrame:
    return tiles.where(~fits(F.col("h"), F.col("w"), size)).select("tile_id", "h", "w")


def strided_positions(tiles: DataFrame, size: int, stride: int) -> DataFrame:
    """One row per (tile, x0, y0); x0 counts rows and y0 columns."""
    return (require_fit(tiles, size)
            .withColumn("x0", F.explode(axis_positions(F.col("h"), size, stride)))
            .withColumn("y0", F.explode(axis_positions(F.col("w"), size, stride))))


def cut(data: Column, w: Column, x0: Column, y0: Column, size: int) -> Column:
    """The size x size window of a row-major array."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                       lambda k: F.slice(data, ((x0 + k) * w + y0 + 1).cast("int"), F.lit(size)))
    return F.flatten(rows)


#: Values that one batch of cut windows holds at most (a window that is larger goes alone).
BATCH_VALUES = 1 << 20


def cut_windows(tiles: DataFrame, channels: Sequence[str], size: int, keys: Sequence[str] = ("tile_id",),
                spots: str = "spots") -> DataFrame:
    """(keys, x0, y0, channels): the size x size windows at the listed corners of each tile row, in few rows at a time.

    `spots` is an array of structs with x0 and y0; null or empty lists give no rows.
    """
    types = {f.name: f.dataType for f in tiles.schema}
    schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [T.StructField(n, T.IntegerType()) for n in ("x0", "y0")]
                          + [T.StructField(c, types[c]) for c in channels])
    step = max(1, BATCH_VALUES // (size * size * len(channels)))
    corners = [F.col(spots)[n].cast("array<int>").alias(f"_{n}") for n in ("x0", "y0")]
    rows = tiles.select(*keys, "h", "w", *corners, *channels)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name).slice(at, 1) for name in batch.schema.names}
                shape = row["h"][0].as_py(), row["w"][0].as_py()
                x0, y0 = (row[n].flatten().to_numpy() for n in ("_x0", "_y0"))
                # positions rather than values are cut, so that nulls of a channel stay nulls
                place = np.lib.stride_tricks.sliding_window_view(np.arange(shape[0] * shape[1]).reshape(shape), (size, size))
                for first in range(0, len(x0), step):
                    xs, ys = x0[first:first + step], y0[first:first + step]
                    index = pa.array(place[xs, ys].ravel())
                    offsets = pa.array(np.arange(len(xs) + 1, dtype=np.int32) * (size * size))
                    same = pa.array(np.zeros(len(xs), np.int64))
                    cuts = [pa.ListArray.from_arrays(offsets, row[c].flatten().take(index)) for c in channels]
                    yield pa.record_batch([*[row[k].take(same) for k in keys], pa.array(xs), pa.array(ys), *cuts], [f.name for f in schema])
    return rows.mapInArrow(run, schema)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def summed_area(flags: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """(h + 1) x (w + 1) table of flag counts above and left of each corner."""
    out = []
    for flag, rows, cols in zip(flags, h, w):
        table = np.zeros((rows + 1, cols + 1), dtype=np.int32)
        table[1:, 1:] = np.asarray(flag, dtype=np.int32).reshape(rows, cols).cumsum(0).cumsum(1)
        out.append(table.ravel())
    return pd.Series(out)


#: A filter on its result would otherwise compute a tile's table twice.
summed_area = summed_area.asNondeterministic()


def window_count(table: Column, w: Column, x0: Column, y0: Column, size: int) -> Column:
    def at(r: Column, c: Column) -> Column:
        return F.get(table, (r * (w + 1) + c).cast("int"))
    return at(x0 + size, y0 + size) - at(x0, y0 + size) - at(x0 + size, y0) + at(x0, y0)


def with_tables(tiles: DataFrame, missing: str, clouds: str) -> DataFrame:
    """Replaces the two flag arrays by their summed-area tables."""
    return (tiles.withColumn("_miss", summed_area(F.col(missing), F.col("h"), F.col("w")))
            .withColumn("_cloud", summed_area(F.col(clouds), F.col("h"), F.col("w"))))


def accepted(x0: Column, y0: Column, size: int, max_missing: float, max_cloud: float) -> Column:
    """Rejects a share strictly above its limit."""
    area, w = d(size * size), F.col("w")
    return ((window_count(F.col("_miss"), w, x0, y0, size) / area <= d(max_missing))
            & (window_count(F.col("_cloud"), w, x0, y0, size) / area <= d(max_cloud)))


def strided_spots(tiles: DataFrame, size: int, stride: int, missing: str, clouds: str, max_missing: float,
                  max_cloud: float) -> DataFrame:
    """Adds `spots`, the accepted corners (x0, y0) with edge coverage, to each tile row."""
    rows, columns = axis_positions(F.col("h"), size, stride), axis_positions(F.col("w"), size, stride)
    every = F.flatten(F.transform(rows, lambda x: F.transform(columns, lambda y: F.struct(x.alias("x0"), y.alias("y0")))))
    good = F.filter(every, lambda s: accepted(s["x0"], s["y0"], size, max_missing, max_cloud))
    return with_tables(require_fit(tiles, size), missing, clouds).withColumn("spots", good).drop("_miss", "_cloud")


def listed(tiles: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """One row per entry of `spots`, with the keys alone: tile-sized columns don't pass through the generator."""
    return tiles.select(*keys, "spots").select(*keys, F.inline("spots"))


def strided_patches(tiles: DataFrame, size: int, stride: int, missing: str, clouds: str, max_missing: float,
                    max_cloud: float, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Accepted (keys, x0, y0) with edge coverage."""
    return listed(strided_spots(tiles, size, stride, missing, clouds, max_missing, max_cloud), keys)


def random_spots(tiles: DataFrame, size: int, samples: int, seed: int, missing: str, clouds: str, max_missing: float,
                 max_cloud: float, max_attempts: int = 20000, kind: str = "hash", strict: bool = False) -> DataFrame:
    """Adds `spots` (attempt, x0, y0): the first `samples` accepted of at most `max_attempts` drawn corners of each tile row.

    A tile that yields too few keeps those, or fails if `strict`. Attempts are numbers and acceptance is four lookups, so
    all of a tile's draws stay inside its row; most tiles need the first few draws only.
    """
    h, w = F.col("h"), F.col("w")
    mixed = lambda k, salt: random_key([F.col("tile_id"), k], seed + salt, "hash") if kind == "hash" else (
        random_key([F.col("tile_id") * 1000 + k], seed + salt, "mix"))

    def draw(k: Column) -> Column:
        x0 = F.floor(mixed(k, 0) * (h - size) / d(KEY_SPACE)).cast("int")
        y0 = F.floor(mixed(k, 1) * (w - size) / d(KEY_SPACE)).cast("int")
        return F.struct(k.alias("attempt"), x0.alias("x0"), y0.alias("y0"))

    # draws in growing chunks: a later one is made only in rows that still lack patches
    bounds, last = [], 0
    while last < max_attempts:
        first, last = last + 1, min(max_attempts, max(4 * last, 4 * samples, 16))
        bounds.append(F.struct(F.lit(first).alias("first"), F.lit(last).alias("last")))

    def more(found: Column, chunk: Column) -> Column:
        drawn = F.transform(F.sequence(chunk["first"], chunk["last"]), draw)
        good = F.filter(drawn, lambda s: accepted(s["x0"], s["y0"], size, max_missing, max_cloud))
        return F.when(F.size(found) >= samples, found).otherwise(F.concat(found, good))

    none = F.array().cast("array<struct<attempt:int,x0:int,y0:int>>")
    found = with_tables(require_fit(tiles, size), missing, clouds).withColumn("spots", F.aggregate(F.array(*bounds), none, more))
    found = found.withColumn("spots", F.slice("spots", 1, samples)).drop("_miss", "_cloud")
    if not strict:
        return found
    text = F.concat(F.lit("too few patches accepted on tile "), F.col("tile_id").cast("string"))
    return found.withColumn("spots", F.when(F.size("spots") == samples, F.col("spots")).otherwise(F.raise_error(text)))


def random_patches(tiles: DataFrame, size: int, samples: int, seed: int, missing: str, clouds: str, max_missing: float,
                   max_cloud: float, max_attempts: int = 20000, kind: str = "hash", strict: bool = False,
                   keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Accepted (keys, attempt, x0, y0), see `random_spots`."""
    return listed(random_spots(tiles, size, samples, seed, missing, clouds, max_missing, max_cloud, max_attempts, kind, strict), keys)


def fixed_spots(stacks: DataFrame, spots: DataFrame, size: int, missing: str | None = None, max_missing: float = 0.0) -> DataFrame:
    """Adds `spots`, the listed corners (i, j as x0, y0) of the stack's cell (y, x) that fit it, in corner order; stacks without
    any drop out.

    The few corners of a cell are gathered into one list first, so each stack passes the join once and unchanged; the test of
    the share of missing pixels (flag array `missing`, at most `max_missing`) runs in its row.
    """
    lists = spots.groupBy("y", "x").agg(F.sort_array(F.collect_list(F.struct(F.col("i").alias("x0"), F.col("j").alias("y0")))).alias("spots"))
    joined = stacks.join(lists, ["y", "x"])
    fit = lambda s: (s["x0"] + size <= F.col("h")) & (s["y0"] + size <= F.col("w"))
    joined = joined.withColumn("spots", F.filter("spots", fit)).where(F.size("spots") > 0)
    if missing is None:
        return joined
    share = lambda s: window_count(F.col("_miss"), F.col("w"), s["x0"], s["y0"], size) / d(size * size)
    return (joined.withColumn("_miss", summed_area(F.col(missing), F.col("h"), F.col("w")))
            .withColumn("spots", F.filter("spots", lambda s: share(s) <= d(max_missing))).drop("_miss").where(F.size("spots") > 0))


#: Stacks of one cell that one task joins with its corners, on average and at most; a cell of more is dealt out.
PART_STACKS = 1024
#: Cells of more stacks than that go to the executors as a list up to this number, else as a table.
BROADCAST_CELLS = 10_000


def _crowded_cells(stacks: DataFrame) -> DataFrame | None:
    """(y, x, _parts): into how many parts the stacks of a cell are dealt, where that is more than one. None if there is no such cell."""
    counted = stacks.groupBy("y", "x").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PART_STACKS)
    crowded = counted.where("y IS NOT NULL AND x IS NOT NULL").select("y", "x", F.ceil(F.col("_n") / PART_STACKS).alias("_parts"))
    first = crowded.limit(BROADCAST_CELLS + 1).toArrow()
    if not first.num_rows:
        return None
    return crowded if first.num_rows > BROADCAST_CELLS else F.broadcast(stacks.sparkSession.createDataFrame(first, crowded.schema))


def _dealt(stacks: DataFrame, corners: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Stacks, corners and the keys they meet by. Stacks of a crowded cell are dealt over parts that each get its corners, and
    all stacks over the set number of tasks: the rows a task makes don't show in the bytes it reads, by which Spark would
    put tasks together."""
    crowded, by = _crowded_cells(stacks), ["y", "x"]
    if crowded is not None:
        plain = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
        own = F.xxhash64(*[F.col(f.name) for f in stacks.schema if isinstance(f.dataType, plain)])
        parts = F.coalesce("_parts", F.lit(1))
        stacks = stacks.join(crowded, by, "left").withColumn("_part", F.pmod(own, parts)).drop("_parts")
        corners = corners.join(crowded, by, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
        by = [*by, "_part"]
    return stacks.repartition(int(stacks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by), corners, by


def fixed_patches(stacks: DataFrame, spots: DataFrame, size: int, missing: str | None = None,
                  max_missing: float = 0.0) -> DataFrame:
    """One row per accepted corner (i, j) of `fixed_spots` with the stack's columns that are no arrays; `cut_windows` on the
    spots gives the pixels.

    Without `missing` no array is asked for: the corners are joined row by row and the fit is part of the join, so no list of
    a cell's corners is built and filtered again for each of its stacks. Stacks are counted by cell first, to deal them evenly.
    """
    small = [f.name for f in stacks.schema if not isinstance(f.dataType, T.ArrayType)]
    if missing is None:
        corners = spots.select("y", "x", F.col("i").alias("_x0"), F.col("j").alias("_y0"))
        fit = (F.col("_x0") + size <= F.col("h")) & (F.col("_y0") + size <= F.col("w"))
        dealt, corners, by = _dealt(stacks.select(*small), corners)
        kept = dealt.join(corners, by).where(fit)
        return kept.select(*small, F.col("_x0").alias("i"), F.col("_y0").alias("j"))
    kept = fixed_spots(stacks, spots, size, missing, max_missing)
    return kept.select(*small, "spots").select(*small, F.inline("spots")).withColumnsRenamed({"x0": "i", "y0": "j"})


def grid_patches(pixels: DataFrame, size: int, missing: Column, tile: str = "tile_id") -> DataFrame:
    """Non-overlapping size x size blocks without any missing pixel; incomplete border blocks drop out."""
    return (pixels.groupBy(tile, F.floor(F.col("r") / size).cast("int").alias("br"),
                           F.floor(F.col("c") / size).cast("int").alias("bc"))
            .agg(F.count(F.lit(1)).alias("n"), F.bool_or(missing).alias("_miss"))
            .where((F.col("n") == size * size) & ~F.col("_miss")).drop("_miss"))


def no_missing(pixels: DataFrame, keys: Sequence[str], missing: Column) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.bool_or(missing).alias("_m")).where(~F.col("_m")).select(*keys)


def random_split(events: DataFrame, event: str, val_ratio: float, test_ratio: float, seed: int, kind: str = "hash",
                 number: Column | None = None) -> DataFrame:
    """Adds `split` to distinct events, so tiles of one event never part. Holdout = ceil(n * ratio)."""
    holdout = val_ratio + test_ratio
    if not 0 < holdout < 1:
        raise ValueError("the held-out share must lie between 0 and 1")
    columns = [number if number is not None else F.col(event)]
    first = ranked_by_key(events, [], random_key(columns, seed, kind), [event])
    n_hold = F.ceil(F.col("rank_total") * d(holdout))
    sided = (first.withColumn("held", F.col("rank") <= n_hold).withColumn("_nh", n_hold).drop("rank", "rank_total"))
    kept = sided.where(~F.col("held")).select(*events.columns, F.lit("train").alias("split"))
    second = ranked_by_key(sided.where("held"), [], random_key(columns, seed + 1222, kind), [event])
    n_test = F.ceil(F.col("rank_total") * d(test_ratio / holdout))
    tested = F.when(F.col("rank") <= n_test, "test").otherwise("val")
    return kept.unionByName(second.select(*events.columns, tested.alias("split")))


def listed_split(events: DataFrame, splits: DataFrame) -> DataFrame:
    """Split by the event's cell; events whose cell is not listed drop out."""
    return events.join(splits.select("y", "x", "split"), ["y", "x"])


def wet_dry_sample(patches: DataFrame, patch: str, wet: str, samples: int, wet_share: float, seed: int,
                   kind: str = "hash") -> DataFrame:
    """`samples` patch ids with int(samples * wet_share) wet ones.

    A stratum that is too small is taken whole and topped up with repeated draws; an empty one is replaced by the other.
    """
    spark = patches.sparkSession
    want_wet = int(samples * wet_share)
    ranks = ranked_by_key(patches.select(patch, F.col(wet).cast("boolean").alias("wet")), ["wet"],
                          random_key([F.col(patch)], seed, kind), [patch])
    flag = F.col(wet).cast("boolean")
    n_wet, n_dry = patches.agg(F.count_if(flag), F.count_if(~flag)).first()
    wet_need = 0 if n_wet == 0 else samples if n_dry == 0 else want_wet
    is_wet = F.col("id") < wet_need
    place = F.when(is_wet, F.col("id")).otherwise(F.col("id") - wet_need)
    size = F.when(is_wet, n_wet).otherwise(n_dry)
    redraw = F.pmod(random_key([F.col("id")], seed + 7, kind), F.greatest(size, F.lit(1))) + 1
    drawn = spark.range(samples).where(size > 0).select(
        F.col("id").alias("slot"), is_wet.alias("wet"), F.when(place < size, place + 1).otherwise(redraw).alias("rank"))
    return drawn.join(ranks.select(patch, "wet", "rank"), ["wet", "rank"]).select("slot", patch, "wet")


def random_batch(patches: DataFrame, patch: str, n: int, seed: int, kind: str = "hash") -> DataFrame:
    return patches.orderBy(random_key([F.col(patch)], seed, kind), patch).limit(n)


def shards(patches: DataFrame, order: str, count: int, total: int, drop_last: bool) -> DataFrame:
    """Adds `shard` and `shard_pos`: contiguous ranges of the patch order (`order` is a unique bigint).

    `total // count` each; the remainder is dropped or spread one by one over the first shards.
    """
    if count <= 0:
        raise ValueError(f"cannot write {count} shards")
    if count > total:
        raise ValueError(f"{total} patches do not fill {count} shards")
    base, extra = divmod(total, count)
    at = F.col("rank") - 1
    numbered = ranked(patches, [], integer_levels(F.col(order)), F.col(order))
    if drop_last:
        placed = numbered.where(at < base * count).withColumn("shard", F.floor(at / base).cast("int"))
        start = F.col("shard") * base
    else:
        big = extra * (base + 1)
        placed = numbered.withColumn("shard", F.when(at < big, F.floor(at / (base + 1)))
                                     .otherwise(F.floor((at - big) / base) + extra).cast("int"))
        start = F.col("shard") * base + F.least(F.col("shard"), F.lit(extra))
    return placed.withColumn("shard_pos", at - start).drop("rank", "rank_total")


def reader_order(sharded: DataFrame, shard_count: int, ranks: int, workers: int, block: int, seed: int, epoch: int,
                 kind: str = "hash") -> DataFrame:
    """Who reads a patch when: rank, worker, turn of its shard, block and position in the shuffled block.

    Shards are shuffled per epoch, cut into equal rank blocks (left-over shards are not read) and dealt to workers.
    """
    spark = sharded.sparkSession
    key = random_key([F.col("shard")], seed + epoch, kind)
    # the shard list has one row per output file, far below one task's worth
    turns = (spark.range(shard_count).select(F.col("id").cast("int").alias("shard"))
             .withColumn("_o", F.row_number().over(Window.orderBy(key, "shard")) - 1))
    per_rank = shard_count // ranks
    turns = (turns.where(F.col("_o") < per_rank * ranks)
             .withColumn("rank", F.floor(F.col("_o") / per_rank).cast("int"))
             .withColumn("_in_rank", F.col("_o") % per_rank)
             .select("shard", "rank", (F.col("_in_rank") % workers).cast("int").alias("worker"),
                     F.floor(F.col("_in_rank") / workers).cast("int").alias("turn")))
    blocks = sharded.join(F.broadcast(turns), "shard").withColumn("block", F.floor(F.col("shard_pos") / block).cast("int"))
    spot = random_key([F.col("shard_pos")], seed + epoch + 1, kind)
    within = Window.partitionBy("shard", "block").orderBy(spot, "shard_pos")
    return blocks.withColumn("pos", F.row_number().over(within) - 1)


def augmented(data: Column, size: int, flip_h: Column, flip_v: Column, turns: Column) -> Column:
    """Horizontal flip, vertical flip, then `turns` quarter turns counter-clockwise of a row-major square array."""
    last = size - 1

    def source(k: Column) -> Column:
        r, c = F.floor(k / size).cast("int"), (k % size).cast("int")
        rr = F.when(turns == 0, r).when(turns == 1, c).when(turns == 2, last - r).otherwise(last - c)
        cc = F.when(turns == 0, c).when(turns == 1, last - r).when(turns == 2, last - c).otherwise(r)
        rr = F.when(flip_v, last - rr).otherwise(rr)
        cc = F.when(flip_h, last - cc).otherwise(cc)
        return F.get(data, (rr * size + cc).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), source)


def augmentation_draws(patch: Column, seed: int, kind: str = "hash") -> dict[str, Column]:
    """Shared by every array of the patch: image, label and extras turn the same way."""
    half = KEY_SPACE // 2
    return {"flip_h": random_key([patch], seed, kind) >= half, "flip_v": random_key([patch], seed + 1, kind) >= half,
            "turns": F.floor(random_key([patch], seed + 2, kind) * 4 / d(KEY_SPACE)).cast("int")}


#: Rounds of the permutation of positions; an even number.
ROUNDS = 6


def permutation(size: int, seed: int, kind: str = "hash") -> np.ndarray:
    """Where the value at each position of a permuted size x size patch comes from, computed position by position.

    A position is a pair (row, column). A round swaps the two and moves one by a random number of the other, modulo `size`,
    which can be undone; so any number of rounds maps the positions one to one, for every size and without sorting.
    `kind="mix"` is a plain multiplicative key, as in `random_key`.
    """
    row, column = np.divmod(np.arange(size * size, dtype=np.uint64), np.uint64(size))
    with np.errstate(over="ignore"):
        for i in range(ROUNDS):
            key = column * np.uint64(16) + np.uint64(i + seed)
            if kind == "mix":
                key = key * np.uint64(2654435761) % np.uint64(KEY_SPACE)
            elif kind == "hash":
                key = (key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                key = (key ^ key >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
            else:
                raise ValueError(f"unknown key kind {kind!r}")
            row, column = column, (row + key * np.uint64(size) // np.uint64(KEY_SPACE)) % np.uint64(size)
    return (row * np.uint64(size) + column).astype(np.int64)


def _gathered(column: pa.ListArray, order: np.ndarray) -> pa.ListArray:
    """Every list rearranged by the same order; null lists stay null, others must have its length."""
    sizes = np.diff(column.offsets.to_numpy())
    there = column.is_valid().to_numpy(zero_copy_only=False)
    if (sizes[there] != len(order)).any():
        raise ValueError(f"a patch has not the {len(order)} values of the permutation")
    starts = column.offsets.to_numpy()[:-1][there]
    values = column.values.take(pa.array((starts[:, None] + order).ravel()))
    offsets = np.concatenate(([0], np.cumsum(np.where(there, len(order), 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~there))


def _replaced(batch: pa.RecordBatch, values: Sequence[str], order: np.ndarray) -> list[pa.Array]:
    return [_gathered(column, order) if name in values else column for name, column in zip(batch.schema.names, batch.columns)]


def permute_channels(patches: DataFrame, values: Sequence[str], size: int, seed: int, kind: str = "hash") -> DataFrame:
    """Rearranges the listed channel arrays of every patch row by the same permutation. Narrow: a gather in the row."""
    names = patches.columns

    def run(batches):
        order = permutation(size, seed, kind)
        for batch in batches:
            yield pa.record_batch(_replaced(batch, values, order), names)
    return patches.mapInArrow(run, patches.schema)


def permutation_runs(patches: DataFrame, channels: dict[str, str], size: int, seed: int, kind: str = "hash",
                     baseline: str = "none") -> DataFrame:
    """Every patch as it is (`channel` = baseline) and once for each named channel array with that one permuted. One scan, narrow."""
    schema = T.StructType([*patches.schema.fields, T.StructField("channel", T.StringType())])

    def run(batches):
        order = permutation(size, seed, kind)
        for batch in batches:
            for name, moved in [(baseline, ()), *((n, (c,)) for n, c in channels.items())]:
                yield pa.record_batch([*_replaced(batch, moved, order), pa.array([name] * batch.num_rows)], schema.names)
    return patches.mapInArrow(run, schema)
