"""Grid changes and vector burning in pixel form.

An affine grid is (ulx, sx, uly, sy) with square-free scale: x = ulx + c * sx, y = uly + r * sy, sy negative.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilerain.functions.bands import d

Grid = tuple[float, float, float, float]


def dense_grid(keys: DataFrame, height: Column | int, width: Column | int) -> DataFrame:
    """All (r, c) of each key row; narrow."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return (keys.withColumn("r", F.explode(F.sequence(F.lit(0), lift(height) - 1)))
            .withColumn("c", F.explode(F.sequence(F.lit(0), lift(width) - 1))))


def crop(pixels: DataFrame, bounds: DataFrame, grid: Grid, value: str, nodata: float = 0.0,
         tile: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Crops to (west, south, east, north) per tile in the tile's own grid; nodata outside the raster. Half pixels round to even."""
    ulx, sx, uly, sy = grid
    b = bounds.select(
        *tile, F.rint((F.col("west") - ulx) / sx).cast("int").alias("_c0"),
        F.rint((F.col("north") - uly) / sy).cast("int").alias("_r0"),
        F.rint((F.col("east") - F.col("west")) / sx).cast("int").alias("_w"),
        F.rint((F.col("south") - F.col("north")) / sy).cast("int").alias("_h"))
    wanted = dense_grid(b, F.col("_h"), F.col("_w"))
    source = pixels.select(*tile, F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(value))
    at = wanted.withColumn("_sr", F.col("r") + F.col("_r0")).withColumn("_sc", F.col("c") + F.col("_c0"))
    return at.join(source, [*tile, "_sr", "_sc"], "left").select(
        *tile, "r", "c", F.coalesce(F.col(value), F.lit(nodata)).alias(value))


def halo(pixels: DataFrame, r0: int, c0: int, height: int, width: int, pad: int = 1) -> DataFrame:
    """Window of a source grid widened by `pad` pixels on every side."""
    return pixels.where(F.col("r").between(r0 - pad, r0 + height - 1 + pad)
                        & F.col("c").between(c0 - pad, c0 + width - 1 + pad))


def source_position(src: Grid, dst: Grid) -> tuple[Column, Column]:
    """Fractional source (row, col) of the center of destination pixel (r, c), counted from pixel centers."""
    x = d(dst[0]) + (F.col("c") + d(0.5)) * d(dst[1])
    y = d(dst[2]) + (F.col("r") + d(0.5)) * d(dst[3])
    return (y - d(src[2])) / d(src[3]) - d(0.5), (x - d(src[0])) / d(src[1]) - d(0.5)


def nearest_regrid(pixels: DataFrame, tiles: DataFrame, value: str, src: Grid, dst: Grid, height: int, width: int,
                   nodata, tile: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Nearest source pixel for class layers."""
    row, col = source_position(src, dst)
    spots = dense_grid(tiles.select(*tile), height, width).select(
        *tile, "r", "c", F.floor(row + d(0.5)).cast("int").alias("_sr"), F.floor(col + d(0.5)).cast("int").alias("_sc"))
    source = pixels.select(*tile, F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(value))
    return spots.join(source, [*tile, "_sr", "_sc"], "left").select(
        *tile, "r", "c", F.coalesce(F.col(value), F.lit(nodata)).alias(value))


def bilinear_regrid(pixels: DataFrame, tiles: DataFrame, value: str, src: Grid, dst: Grid, height: int, width: int,
                    nodata: float, tile: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Weighted mean of the up to four neighbors that exist and are valid; nodata where there is none."""
    row, col = source_position(src, dst)
    r0, c0 = F.floor(row), F.floor(col)
    fr, fc = row - r0, col - c0
    corners = F.array(*[
        F.struct((r0 + i).cast("int").alias("sr"), (c0 + j).cast("int").alias("sc"),
                 ((fr if i else d(1) - fr) * (fc if j else d(1) - fc)).alias("w")) for i in (0, 1) for j in (0, 1)])
    spots = (dense_grid(tiles.select(*tile), height, width).select(*tile, "r", "c", F.explode(corners).alias("_k"))
             .select(*tile, "r", "c", F.col("_k.sr").alias("_sr"), F.col("_k.sc").alias("_sc"), F.col("_k.w").alias("_w")))
    source = (pixels.where(F.col(value) != F.lit(nodata))
              .select(*tile, F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(value).alias("_v")))
    summed = spots.join(source, [*tile, "_sr", "_sc"], "left").groupBy(*tile, "r", "c").agg(
        F.sum(F.col("_v") * F.col("_w")).alias("_s"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))).alias("_n"))
    return summed.select(*tile, "r", "c", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
                         .otherwise(F.lit(nodata)).alias(value))


def mosaic(sources: DataFrame, value: str, nodata: float, key: Sequence[str] = ("r", "c")) -> DataFrame:
    """First non-missing source in `file_ord` wins; nodata where all miss. `min_by` combines map-side."""
    seen = F.col(value) != F.lit(nodata)
    best = F.min_by(F.when(seen, F.col(value)), F.when(seen, F.col("file_ord")))
    return sources.groupBy(*key).agg(F.coalesce(best, F.lit(nodata)).alias(value))


def mixed_sources(sources: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups whose sources differ in CRS or nodata; a mosaic of them is an error."""
    return (sources.groupBy(*group).agg(F.count_distinct("crs").alias("n_crs"), F.count_distinct("nodata").alias("n_nodata"))
            .where((F.col("n_crs") > 1) | (F.col("n_nodata") > 1)))


def touched_cells(segments: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Grid cells that line segments pass through, as distinct (keys, r, c).

    Segments (x1, y1, x2, y2) are in pixel units. A segment is cut at the row lines it crosses; in each row its
    columns are a range. Everything is generated from the segment row itself, so no segment-by-cell join exists.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    low = F.greatest(F.floor(F.least(y1, y2)), F.lit(0)).cast("int")
    high = F.least(F.floor(F.greatest(y1, y2)), F.lit(height - 1)).cast("int")
    in_rows = segments.where(low <= high).withColumn("r", F.explode(F.sequence(low, high)))
    # part of the segment inside the row slab, by its parameter along y
    dy = F.nullif(y2 - y1, d(0))
    top, bottom = (F.col("r") - y1) / dy, (F.col("r") + 1 - y1) / dy
    t0 = F.coalesce(F.greatest(d(0), F.least(top, bottom)), d(0))
    t1 = F.coalesce(F.least(d(1), F.greatest(top, bottom)), d(1))
    xa, xb = x1 + t0 * (x2 - x1), x1 + t1 * (x2 - x1)
    ca = F.greatest(F.floor(F.least(xa, xb)), F.lit(0)).cast("int")
    cb = F.least(F.floor(F.greatest(xa, xb)), F.lit(width - 1)).cast("int")
    return (in_rows.select(*keys, "r", ca.alias("_a"), cb.alias("_b")).where("_a <= _b")
            .select(*keys, "r", F.explode(F.sequence("_a", "_b")).alias("c")).distinct())


def filled_cells(segments: DataFrame, keys: Sequence[str], ring: Sequence[str], height: int, width: int) -> DataFrame:
    """Cells whose center lies inside closed rings (even-odd rule), from the ring edges of each polygon `ring`."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    # centers at r + 0.5 with low <= center < high
    first = F.greatest(F.ceil(low - d(0.5)), F.lit(0)).cast("int")
    last = F.least(F.ceil(high - d(0.5)) - 1, F.lit(height - 1)).cast("int")
    crossings = (segments.where(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
                 .withColumn("_x", x1 + (F.col("r") + d(0.5) - y1) / (y2 - y1) * (x2 - x1)))
    group = Window.partitionBy(*keys, *ring, "r").orderBy("_x")
    spans = (crossings.withColumn("_i", F.row_number().over(group)).withColumn("_to", F.lead("_x").over(group))
             .where((F.col("_i") % 2 == 1) & F.col("_to").isNotNull()))
    ca = F.greatest(F.ceil(F.col("_x") - d(0.5)), F.lit(0)).cast("int")
    cb = F.least(F.ceil(F.col("_to") - d(0.5)) - 1, F.lit(width - 1)).cast("int")
    return (spans.select(*keys, "r", ca.alias("_a"), cb.alias("_b")).where("_a <= _b")
            .select(*keys, "r", F.explode(F.sequence("_a", "_b")).alias("c")).distinct())


def burned(cells: DataFrame, tiles: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """0/1 raster per tile: 1 at the given cells, all zeros for a tile without features."""
    hit = cells.select(*keys, "r", "c", F.lit(1).alias("_v")).distinct()
    return dense_grid(tiles.select(*keys), height, width).join(hit, [*keys, "r", "c"], "left").select(
        *keys, "r", "c", F.coalesce("_v", F.lit(0)).alias("burned"))


def region_cells(segments: DataFrame, keys: Sequence[str], ring: Sequence[str], height: int, width: int) -> DataFrame:
    """Grid cells that intersect a polygon: on its boundary or inside it."""
    border = touched_cells(segments, keys, height, width)
    return border.unionByName(filled_cells(segments, keys, ring, height, width)).distinct()


def shifted_pair(optical: DataFrame, radar: DataFrame, shifts: DataFrame, tile: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Optical pixels moved onto the radar grid by (shift_x, shift_y) per tile; the inner join crops the overlap.

    Radar row r meets optical row r - shift_y, radar column c meets optical column c + shift_x; re-indexed to 0.
    `shifts` has one row per tile.
    """
    sx, sy = F.col("shift_x"), F.col("shift_y")
    moved = optical.join(shifts.select(*tile, "shift_x", "shift_y"), list(tile)).withColumn(
        "r", F.col("r") + sy).withColumn("c", F.col("c") - sx)
    return moved.join(radar, [*tile, "r", "c"]).withColumn("r", F.col("r") - F.greatest(F.lit(0), sy)).withColumn(
        "c", F.col("c") - F.greatest(F.lit(0), -sx)).drop("shift_x", "shift_y")


def gray_levels(pixels: DataFrame, value: str, tile: Sequence[str] = ("tile_id",), nodata: float | None = None,
                span: tuple[float, float] | None = None, table: DataFrame | None = None) -> DataFrame:
    """Linear colormap of 256 steps over the given range or the tile's own; nodata is black.

    Without a `table` (level, red, green, blue) the map is gray. Tile ranges are a small aggregate joined back.
    """
    seen = F.lit(True) if nodata is None else F.col(value) != d(nodata)
    if span is None:
        ranges = pixels.groupBy(*tile).agg(F.min(F.when(seen, F.col(value))).alias("_lo"),
                                           F.max(F.when(seen, F.col(value))).alias("_hi"))
        ranged = pixels.join(ranges, list(tile))
    else:
        ranged = pixels.withColumn("_lo", d(span[0])).withColumn("_hi", d(span[1]))
    unit = F.when(F.col("_hi") == F.col("_lo"), d(0)).otherwise(
        (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), d(0)))
    level = F.least(F.greatest(F.floor(unit * 256), F.lit(0)), F.lit(255)).cast("int")
    leveled = ranged.withColumn("_seen", seen).withColumn("level", F.when(F.col("_seen"), level)).drop("_lo", "_hi")
    if table is None:
        out = leveled.select("*", *[F.coalesce("level", F.lit(0)).alias(b) for b in ("red", "green", "blue")])
    else:
        lut = F.broadcast(table.select("level", "red", "green", "blue"))
        out = leveled.join(lut, "level", "left").fillna(0, ["red", "green", "blue"])
    return out.drop("_seen", "level")
