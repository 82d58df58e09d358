"""Vectors burned into tiles as bit masks (I4, D3): runs of cells, never one row per cell.

Segments (x1, y1, x2, y2) are in pixel units of a raster of height x width pixels, which lies in square tiles (ty, tx) of
`tile` pixels. A segment is first cut to the tiles that it crosses; inside a tile a run of cells in one row is a few 64-bit
words. Words fold by `bit_or` (lines, parts of a feature) and `bit_xor` (crossings of a ring) before they are shuffled, so
what is shuffled grows with the burned runs of a tile, at most `tile` rows of `tile` / 64 words, whatever share of all
segments one key holds.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilerain.functions.bands import d

WORD = 64
#: Segments that one task cuts into words, on average and at most.
SEGMENTS = 50_000


def _ones(n: Column) -> Column:
    """A word with its n lowest bits set, n from 1 to 64."""
    return F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (F.lit(WORD) - n).cast("int"))


def _spread(segments: DataFrame) -> DataFrame:
    """At most about SEGMENTS segments in a task, however few files they come from and however equal they are: the words of a
    task are folded in its memory."""
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(max(n, -(-segments.count() // SEGMENTS)))


def _words(runs: DataFrame, kept: Sequence[str], tile: int) -> DataFrame:
    """(kept, ty, tx, word, mask) of runs from column `_a` to `_b` in row `r` of the raster, both inside tile tx."""
    wide = -(-tile // WORD)
    a, b = F.col("_a") - F.col("tx") * tile, F.col("_b") - F.col("tx") * tile
    parts = runs.where("_a <= _b").select(*kept, "ty", "tx", (F.col("r") - F.col("ty") * tile).alias("_r"), a.alias("_a"), b.alias("_b"),
                                          F.explode(F.sequence(F.floor(a / WORD).cast("int"), F.floor(b / WORD).cast("int"))).alias("_w"))
    low = F.greatest(F.col("_a") - F.col("_w") * WORD, F.lit(0))
    high = F.least(F.col("_b") - F.col("_w") * WORD, F.lit(WORD - 1))
    mask = F.call_function("shiftleft", _ones(high - low + 1), low.cast("int"))
    return parts.select(*kept, "ty", "tx", (F.col("_r") * wide + F.col("_w")).cast("int").alias("word"), mask.alias("mask"))


def _wanted(pieces: DataFrame, tiles: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Pieces of the tiles asked for; the others are never scan converted."""
    return pieces if tiles is None else pieces.join(tiles.select(*keys, "ty", "tx").distinct(), [*keys, "ty", "tx"], "left_semi")


def line_masks(segments: DataFrame, keys: Sequence[str], height: int, width: int, tile: int = 400, tiles: DataFrame | None = None) -> DataFrame:
    """(keys, ty, tx, word, mask) of the cells that segments pass through.

    In each row of cells the columns of a segment are a run. Segments with a null corner, and parts outside the raster,
    burn nothing. `tiles` (keys, ty, tx) restricts the work to some tiles.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    dy = F.nullif(y2 - y1, d(0))

    def columns(top: Column, bottom: Column) -> tuple[Column, Column]:
        """Leftmost and rightmost column of the part of a segment between two row lines."""
        t, u = (top - y1) / dy, (bottom - y1) / dy
        t0 = F.coalesce(F.greatest(d(0), F.least(t, u)), d(0))
        t1 = F.coalesce(F.least(d(1), F.greatest(t, u)), d(1))
        xa, xb = x1 + t0 * (x2 - x1), x1 + t1 * (x2 - x1)
        return F.floor(F.least(xa, xb)), F.floor(F.greatest(xa, xb))

    low = F.greatest(F.floor(F.least(y1, y2)), F.lit(0)).cast("int")
    high = F.least(F.floor(F.greatest(y1, y2)), F.lit(height - 1)).cast("int")
    strips = _spread(segments).select(*keys, "x1", "y1", "x2", "y2", low.alias("_low"), high.alias("_high")).where("_low <= _high")
    strips = strips.select("*", F.explode(F.sequence(F.floor(F.col("_low") / tile).cast("int"), F.floor(F.col("_high") / tile).cast("int"))).alias("ty"))
    strips = strips.withColumn("_low", F.greatest(F.col("_low"), F.col("ty") * tile)).withColumn("_high", F.least(F.col("_high"), F.col("ty") * tile + tile - 1))
    left, right = columns(F.col("_low"), F.col("_high") + 1)
    strips = strips.withColumn("_a", F.greatest(left, F.lit(0)).cast("int")).withColumn("_b", F.least(right, F.lit(width - 1)).cast("int")).where("_a <= _b")
    pieces = strips.select("*", F.explode(F.sequence(F.floor(F.col("_a") / tile).cast("int"), F.floor(F.col("_b") / tile).cast("int"))).alias("tx"))
    rows = _wanted(pieces, tiles, keys).withColumn("r", F.explode(F.sequence("_low", "_high")))
    left, right = columns(F.col("r"), F.col("r") + 1)
    runs = rows.select(*keys, "ty", "tx", "r", F.greatest(left, F.col("tx") * tile).cast("int").alias("_a"),
                       F.least(right, F.col("tx") * tile + tile - 1, F.lit(width - 1)).cast("int").alias("_b"))
    return _words(runs, keys, tile).groupBy(*keys, "ty", "tx", "word").agg(F.bit_or("mask").alias("mask"))


def fill_masks(segments: DataFrame, keys: Sequence[str], ring: Sequence[str], height: int, width: int, tile: int = 400,
               right: str | None = None, tiles: DataFrame | None = None) -> DataFrame:
    """(keys, ty, tx, word, mask) of the cells whose center lies inside closed rings (even-odd rule).

    Each crossing of a row of centers turns over all cells to its right, up to the ring's right end, and `bit_xor` leaves
    those with an odd number of crossings: no crossing is sorted and no ring has to fit in one task. `right` names a column
    with the largest x of the segment's ring; without it cells are turned over to the raster's edge. Polygons told apart by
    `ring` unite by `bit_or`; an empty `ring` takes all segments of a key as one polygon. `tiles` as in `line_masks`.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    first = F.greatest(F.ceil(low - d(0.5)), F.lit(0)).cast("int")
    last = F.least(F.ceil(high - d(0.5)) - 1, F.lit(height - 1)).cast("int")
    end = F.lit(width - 1) if right is None else F.least(F.ceil(F.col(right) - d(0.5)) - 1, F.lit(width - 1))
    kept = [*keys, *ring]
    strips = _spread(segments).select(*kept, "x1", "y1", "x2", "y2", first.alias("_low"), last.alias("_high"), end.cast("int").alias("_end")).where("_low <= _high")
    strips = strips.select("*", F.explode(F.sequence(F.floor(F.col("_low") / tile).cast("int"), F.floor(F.col("_high") / tile).cast("int"))).alias("ty"))
    strips = strips.withColumn("_low", F.greatest(F.col("_low"), F.col("ty") * tile)).withColumn("_high", F.least(F.col("_high"), F.col("ty") * tile + tile - 1))
    start = F.greatest(F.ceil(F.least(x1, x2) - d(0.5)) - 1, F.lit(0)).cast("int")
    pieces = strips.withColumn("_a", start).where("_a <= _end")
    pieces = pieces.select("*", F.explode(F.sequence(F.floor(F.col("_a") / tile).cast("int"), F.floor(F.col("_end") / tile).cast("int"))).alias("tx"))
    rows = _wanted(pieces, tiles, keys).withColumn("r", F.explode(F.sequence("_low", "_high")))
    at = F.ceil(x1 + (F.col("r") + d(0.5) - y1) / (y2 - y1) * (x2 - x1) - d(0.5))
    runs = rows.select(*kept, "ty", "tx", "r", F.greatest(at, F.col("tx") * tile).cast("int").alias("_a"),
                       F.least(F.col("_end"), F.col("tx") * tile + tile - 1).alias("_b"))
    odd = _words(runs, kept, tile).groupBy(*kept, "ty", "tx", "word").agg(F.bit_xor("mask").alias("mask")).where("mask <> 0")
    return odd.groupBy(*keys, "ty", "tx", "word").agg(F.bit_or("mask").alias("mask")) if ring else odd


def united(masks: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Cells of any of the masks, e.g. of a region's border and its inside."""
    whole = masks[0]
    for other in masks[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy(*keys, "ty", "tx", "word").agg(F.bit_or("mask").alias("mask"))


def burned_shares(masks: DataFrame, tiles: DataFrame, keys: Sequence[str], height: int, width: int, tile: int = 400) -> DataFrame:
    """(keys, ty, tx, n_cells, burned, share) per tile, counted on the words; tiles without features have 0."""
    counts = masks.groupBy(*keys, "ty", "tx").agg(F.sum(F.bit_count("mask")).alias("_n"))
    h, w = _sides(height, width, tile)
    n = (h * w).cast("long")
    hit = F.coalesce("_n", F.lit(0)).cast("long")
    return tiles.select(*keys, "ty", "tx").join(counts, [*keys, "ty", "tx"], "left").select(
        *keys, "ty", "tx", n.alias("n_cells"), hit.alias("burned"), (hit / n).alias("share"))


def burned_tiles(masks: DataFrame, tiles: DataFrame, keys: Sequence[str], height: int, width: int, tile: int = 400) -> DataFrame:
    """(keys, ty, tx, h, w, burned) with a row-major 0/1 array per tile of `tiles` (keys, ty, tx); all zeros without features.

    Only words reach the tile's row; the array is unpacked there.
    """
    wide = -(-tile // WORD)

    @F.pandas_udf("array<tinyint>")
    def unpacked(words: pd.Series, masks: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for at, bits, h, w in zip(words, masks, heights, widths):
            grid = np.zeros(h * wide, np.int64)
            if at is not None and len(at):
                grid[np.asarray(at)] = np.asarray(bits, np.int64)
            cells = np.unpackbits(grid.astype("<i8").view(np.uint8).reshape(h, wide * 8), axis=1, bitorder="little")
            out.append(cells[:, :w].ravel().astype(np.int8))
        return pd.Series(out)

    lists = masks.groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct("word", "mask")).alias("_m"))
    h, w = _sides(height, width, tile)
    rows = tiles.select(*keys, "ty", "tx", h.alias("h"), w.alias("w")).join(lists, [*keys, "ty", "tx"], "left")
    return rows.select(*keys, "ty", "tx", "h", "w", unpacked(F.col("_m.word"), F.col("_m.mask"), F.col("h"), F.col("w")).alias("burned"))


def tiles_of(features: DataFrame, keys: Sequence[str], height: int, width: int, tile: int = 400) -> DataFrame:
    """All tiles (keys, ty, tx) of the rasters of some keys."""
    down, across = (height - 1) // tile, (width - 1) // tile
    return (features.select(*keys).distinct().withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(down))))
            .withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(across)))))


def _sides(height: int, width: int, tile: int) -> tuple[Column, Column]:
    """Rows and columns of a tile; those at the lower and right edge may have fewer."""
    return (F.least(F.lit(tile), F.lit(height) - F.col("ty") * tile).cast("int"), F.least(F.lit(tile), F.lit(width) - F.col("tx") * tile).cast("int"))
