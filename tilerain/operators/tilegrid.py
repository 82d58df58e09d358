"""Stencils, crops and grid changes that cross tile borders, in tile form.

A raster is cut into tiles at (ty, tx): row-major channel arrays of h x w pixels. `with_halo` sends the border strips of each
tile to its up to eight neighbors; `read_windows` cuts any windows out of a raster. Either is one shuffle of whole blocks, never of
pixels, and what follows works inside the row.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilerain.functions.bands import d
from tilerain.operators.neighborhood import LEE_CMAX, LEE_CU, LEE_DAMPING, LEE_KERNEL, lee_array
from tilerain.operators.regrid import Grid
from tilerain.schema import SAR_NODATA

#: Rows of tile size that are handed on at once.
ROWS = 16


def _arrays(values: list[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    return pa.array([None if v is None else v for v in values], pa.list_(kind))


def _block(image: np.ndarray, top: int, left: int, bottom: int, right: int) -> np.ndarray:
    return np.ascontiguousarray(image[top:bottom, left:right]).ravel()


def _images(row: dict, channels: Sequence[str], h: int, w: int) -> list[np.ndarray]:
    out = []
    for c in channels:
        flat = row[c].values.to_numpy(zero_copy_only=False) if row[c].is_valid else np.full(h * w, np.nan)
        if len(flat) != h * w:
            raise ValueError(f"channel {c} holds {len(flat)} values, not {h} x {w}")
        out.append(flat.reshape(h, w))
    return out


def _emit(rows: list[tuple], schema: T.StructType, fixed: int):
    """Record batches of few rows; the first `fixed` columns are scalars, the rest arrays."""
    names = [f.name for f in schema]
    kinds = [pa.float64() if isinstance(f.dataType, T.ArrayType) else {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()]
             for f in schema]
    for at in range(0, len(rows), ROWS):
        part = rows[at:at + ROWS]
        yield pa.record_batch([pa.array([r[i] for r in part], kinds[i]) if i < fixed else _arrays([r[i] for r in part], kinds[i])
                               for i in range(len(names))], names)


def with_halo(tiles: DataFrame, channels: Sequence[str], pad: int, keys: Sequence[str] = ("raster_id",), fill: float = SAR_NODATA) -> DataFrame:
    """(keys, ty, tx, height, width, sides, channels): each tile widened by `pad` pixels of its neighbors on every side.

    Only border strips travel beside the tile itself. Pixels beyond the raster, or of a tile that is not there, hold `fill`;
    `sides` is a bit mask of the neighbors that are there (1 above, 2 below, 4 left, 8 right). Tiles of one tile row have the
    same height and those of one tile column the same width; a tile narrower than `pad` fails. One shuffle, on the tile.
    """
    if pad < 1:
        raise ValueError("a halo has at least one pixel")
    types = {f.name: f.dataType for f in tiles.schema}
    integer = T.IntegerType()
    schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [T.StructField(n, integer) for n in (
        "ty", "tx", "r_off", "c_off", "bh", "bw", "height", "width", "sides")] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in channels])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row, rows = {n: batch.column(n)[at] for n in batch.schema.names}, []
                h, w, ty, tx = (row[n].as_py() for n in ("h", "w", "ty", "tx"))
                if min(h, w) < pad:
                    raise ValueError(f"a tile of {h} by {w} is narrower than a halo of {pad}")
                key = [row[k].as_py() for k in keys]
                images = _images(row, channels, h, w)
                rows.append((*key, ty, tx, None, None, None, None, h + 2 * pad, w + 2 * pad, 0, *[None] * len(channels)))
                for dy in (-1, 0, 1):
                    top, bottom = (h - pad, h) if dy > 0 else (0, pad) if dy < 0 else (0, h)
                    for dx in (-1, 0, 1):
                        left, right = (w - pad, w) if dx > 0 else (0, pad) if dx < 0 else (0, w)
                        # seen from the receiver: a sender above fills the rows before its own, one below those after
                        r_off = 0 if dy > 0 else pad if dy == 0 else -1
                        c_off = 0 if dx > 0 else pad if dx == 0 else -1
                        side = {(1, 0): 1, (-1, 0): 2, (0, 1): 4, (0, -1): 8}.get((dy, dx), 0)
                        rows.append((*key, ty + dy, tx + dx, r_off, c_off, bottom - top, right - left, None, None, side,
                                     *[_block(i, top, left, bottom, right) for i in images]))
                yield from _emit(rows, schema, len(keys) + 9)
    blocks = tiles.select(*keys, "ty", "tx", "h", "w", *[F.col(c).cast("array<double>").alias(c) for c in channels]).mapInArrow(run, schema)
    return _joined_halo(blocks, [*keys, "ty", "tx"], channels, pad, fill)


def _joined_halo(blocks: DataFrame, keys: list[str], channels: Sequence[str], pad: int, fill: float) -> DataFrame:
    types = {f.name: f.dataType for f in blocks.schema}
    parts = F.collect_list(F.when(F.col("bh").isNotNull(), F.struct("r_off", "c_off", "bh", "bw", *channels)))
    whole = blocks.groupBy(*keys).agg(F.max("height").alias("height"), F.max("width").alias("width"), F.bit_or("sides").alias("sides"), parts.alias("_parts"))
    whole = whole.where(F.col("height").isNotNull())
    at = F.transform("_parts", lambda p: p.withField("r_off", F.when(p["r_off"] < 0, F.col("height") - pad).otherwise(p["r_off"]))
                     .withField("c_off", F.when(p["c_off"] < 0, F.col("width") - pad).otherwise(p["c_off"])))
    placed = whole.withColumn("_parts", at)
    schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [T.StructField(n, T.IntegerType()) for n in ("height", "width", "sides")]
                          + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in channels])
    return placed.mapInArrow(_filler(keys, ["height", "width", "sides"], channels, fill, schema), schema)


def _filler(keys: Sequence[str], scalars: Sequence[str], channels: Sequence[str], fill: float, schema: T.StructType):
    """Puts the blocks of `_parts` into arrays of height x width."""
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at] for n in batch.schema.names}
                height, width = row["height"].as_py(), row["width"].as_py()
                images = [np.full((height, width), fill) for _ in channels]
                for part in row["_parts"]:
                    r, c, bh, bw = (part[n].as_py() for n in ("r_off", "c_off", "bh", "bw"))
                    for image, name in zip(images, channels):
                        image[r:r + bh, c:c + bw] = part[name].values.to_numpy(zero_copy_only=False).reshape(bh, bw)
                yield from _emit([(*[row[k].as_py() for k in (*keys, *scalars)], *[i.ravel() for i in images])], schema, len(keys) + len(scalars))
    return run


def read_windows(tiles: DataFrame, windows: DataFrame, channels: Sequence[str], tile_h: int, tile_w: int,
                 keys: Sequence[str] = ("raster_id",), window: str = "window_id", fill: float = SAR_NODATA,
                 carried: Sequence[str] = ()) -> DataFrame:
    """(keys, window, r0, c0, height, width, carried, channels): windows of a raster that may lie over several tiles.

    `windows` holds keys, window (unique below the keys), r0, c0, height, width and the `carried` columns; tile (ty, tx) starts at
    pixel (ty * tile_h, tx * tile_w). Pixels outside all tiles hold `fill`. The windows of a tile are gathered into one list
    before the join, so that a tile's arrays pass it once; only the overlapping blocks are shuffled afterwards.
    """
    types = {**{f.name: f.dataType for f in tiles.schema}, **{f.name: f.dataType for f in windows.schema}}
    asked = windows.select(*keys, window, *[F.col(n).cast("int").alias(n) for n in ("r0", "c0", "height", "width")], *carried)
    bottom, right = F.col("r0") + F.col("height") - 1, F.col("c0") + F.col("width") - 1
    steps = lambda low, high, size: F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))
    lists = (asked.where("height > 0 AND width > 0").withColumn("ty", F.explode(steps(F.col("r0"), bottom, tile_h)))
             .withColumn("tx", F.explode(steps(F.col("c0"), right, tile_w)))
             .groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct(window, "r0", "c0", "height", "width")).alias("_windows")))
    rows = tiles.select(*keys, "ty", "tx", "h", "w", *[F.col(c).cast("array<double>").alias(c) for c in channels]).join(lists, [*keys, "ty", "tx"])
    scalars = ["r_off", "c_off", "bh", "bw"]
    schema = T.StructType([T.StructField(k, types[k]) for k in (*keys, window)] + [T.StructField(n, T.IntegerType()) for n in scalars]
                          + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in channels])

    def cut(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at] for n in batch.schema.names}
                h, w = row["h"].as_py(), row["w"].as_py()
                images = _images(row, channels, h, w)
                top, left = row["ty"].as_py() * tile_h, row["tx"].as_py() * tile_w
                key, out = [row[k].as_py() for k in keys], []
                for one in row["_windows"].as_py():
                    a, b = max(one["r0"], top), min(one["r0"] + one["height"], top + h)
                    e, f = max(one["c0"], left), min(one["c0"] + one["width"], left + w)
                    if a < b and e < f:
                        out.append((*key, one[window], a - one["r0"], e - one["c0"], b - a, f - e,
                                    *[_block(i, a - top, e - left, b - top, f - left) for i in images]))
                        if len(out) >= ROWS:
                            yield from _emit(out, schema, len(keys) + 5)
                            out = []
                yield from _emit(out, schema, len(keys) + 5)
    blocks = rows.mapInArrow(cut, schema)
    parts = blocks.groupBy(*keys, window).agg(F.collect_list(F.struct(*scalars, *channels)).alias("_parts"))
    none = F.array().cast(parts.schema["_parts"].dataType)
    placed = asked.join(parts, [*keys, window], "left").withColumn("_parts", F.coalesce("_parts", none))
    kept = [*keys, window, "r0", "c0", "height", "width", *carried]
    result = T.StructType([placed.schema[c] for c in kept] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in channels])
    return placed.select(*kept, "_parts").mapInArrow(_window_filler(kept, channels, fill, result), result)


def _window_filler(kept: Sequence[str], channels: Sequence[str], fill: float, schema: T.StructType):
    inner = _filler([], [], channels, fill, T.StructType([schema[c] for c in channels]))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                filled = next(iter(inner([one])))
                yield pa.record_batch([*[one.column(c) for c in kept], *filled.columns], [*kept, *channels])
    return run


def _in_row(tiles: DataFrame, fields: dict[str, T.DataType], inputs: Sequence[str], fn) -> DataFrame:
    """Adds columns computed by `fn` (row dict -> tuple) from some columns; batches hold few rows."""
    schema = T.StructType([*tiles.schema.fields, *[T.StructField(n, t) for n, t in fields.items()]])
    kinds = [pa.list_(pa.float64()) if isinstance(t, T.ArrayType) else pa.int64() if isinstance(t, T.LongType) else pa.float64() for t in fields.values()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [fn({n: part.column(n)[i] for n in inputs}) for i in range(part.num_rows)]
                yield pa.record_batch([*part.columns, *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], schema.names)
    return tiles.mapInArrow(run, schema)


def _image(row: dict, channel: str) -> np.ndarray:
    return row[channel].values.to_numpy(zero_copy_only=False).reshape(row["height"].as_py(), row["width"].as_py())


def slopes_across(haloed: DataFrame, channel: str) -> DataFrame:
    """Adds slope_y, slope_x of each tile (without its halo of one pixel): central differences, also across tile borders, and
    one-sided ones where there is no neighbor."""
    def slope(row: dict) -> tuple:
        a, sides = _image(row, channel), row["sides"].as_py()
        out = []
        for axis, (before, after) in ((0, (1, 2)), (1, (4, 8))):
            b = a[:, 1:-1] if axis == 0 else a[1:-1].T
            g = (b[2:] - b[:-2]) / 2
            if not sides & before:
                g[0] = b[2] - b[1] if len(b) > 3 or sides & after else 0.0
            if not sides & after:
                g[-1] = b[-2] - b[-3] if len(b) > 3 or sides & before else 0.0
            out.append(np.ascontiguousarray(g if axis == 0 else g.T).ravel())
        return tuple(out)
    kind = T.ArrayType(T.DoubleType())
    return _in_row(haloed, {"slope_y": kind, "slope_x": kind}, ["height", "width", "sides", channel], slope)


def laplacian_across(haloed: DataFrame, channel: str, keys: Sequence[str] = ("raster_id",)) -> DataFrame:
    """Sample variance of the 4-neighbor Laplacian of whole rasters, from tiles with a halo of one pixel filled with zeros."""
    def moments(row: dict) -> tuple:
        a = _image(row, channel)
        lap = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]
        return lap.size, float(lap.mean()), float(lap.var() * lap.size)
    parts = _in_row(haloed, {"_n": T.LongType(), "_mean": T.DoubleType(), "_m2": T.DoubleType()}, ["height", "width", channel], moments)
    n, mean, m2 = F.col("_n"), F.col("_mean"), F.col("_m2")
    # spreads inside the tiles and of the tiles' means around the raster's mean
    folded = parts.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(m2).alias("inside"), F.sum(n * mean).alias("s"), F.sum(n * mean * mean).alias("q"))
    spread = F.col("inside") + F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return folded.select(*keys, F.when(F.col("n") > 1, spread / (F.col("n") - 1)).alias("var_laplacian"))


def lee_across(haloed: DataFrame, channel: str, kernel: int = LEE_KERNEL, damping: float = LEE_DAMPING, cu: float = LEE_CU,
               cmax: float = LEE_CMAX) -> DataFrame:
    """Adds `filtered`, the enhanced Lee filter of each tile without its halo of kernel // 2 pixels (filled with nodata)."""
    pad = kernel // 2

    def lee(row: dict) -> tuple:
        out = lee_array(_image(row, channel), kernel, damping, cu, cmax)
        return (np.ascontiguousarray(out[pad:-pad, pad:-pad]).ravel(),)
    return _in_row(haloed, {"filtered": T.ArrayType(T.DoubleType())}, ["height", "width", channel], lee)


def axis_places(n: int, origin: float, step: float, src_origin: float, src_step: float) -> np.ndarray:
    """Fractional source positions of n destination centers along an axis, counted from pixel centers."""
    return (origin + (np.arange(n) + 0.5) * step - src_origin) / src_step - 0.5


def resampled(image: np.ndarray, rows: np.ndarray, cols: np.ndarray, nodata: float, method: str) -> np.ndarray:
    """An image at fractional (row, col) positions: the grid is separable, so each axis has its own short weight list.

    Bilinear: two weights per row and per column, applied to the values and to the 0/1 image of the valid ones; their quotient
    is the mean of the neighbors that exist and are valid.
    """
    def lists(at: np.ndarray, length: int):
        low = np.floor(at)
        part = at - low
        low = low.astype(int)
        for shift, weight in ((0, 1 - part), (1, part)):
            inside = (low + shift >= 0) & (low + shift < length)
            yield np.clip(low + shift, 0, max(length - 1, 0)), np.where(inside, weight, 0.0)

    def nearest(at: np.ndarray, length: int):
        place = np.floor(at + 0.5).astype(int)
        return np.clip(place, 0, max(length - 1, 0)), (place >= 0) & (place < length)
    if not image.size:
        return np.full((len(rows), len(cols)), nodata)
    if method == "nearest":
        (r, r_in), (c, c_in) = nearest(rows, image.shape[0]), nearest(cols, image.shape[1])
        return np.where(r_in[:, None] & c_in, image[np.ix_(r, c)], nodata)
    if method != "bilinear":
        raise ValueError(f"unknown method {method!r}, use 'nearest' or 'bilinear'")
    valid = image != nodata
    tables = (np.where(valid, image, 0.0), valid.astype(float))
    down = [sum(t[r] * w[:, None] for r, w in lists(rows, image.shape[0])) for t in tables]
    total, mass = (sum(t[:, c] * w for c, w in lists(cols, image.shape[1])) for t in down)
    return np.where(mass > 0, total / np.where(mass > 0, mass, 1.0), nodata)


def regrid_tiles(tiles: DataFrame, channel: str, src: Grid, dst: Grid, height: int, width: int, nodata: float,
                 method: str = "bilinear") -> DataFrame:
    """Adds `regridded` (height x width, row-major) to tiles that each have the source grid `src`. Narrow, no pixel rows."""
    rows, cols = axis_places(height, dst[2], dst[3], src[2], src[3]), axis_places(width, dst[0], dst[1], src[0], src[1])

    def grid(row: dict) -> tuple:
        image = row[channel].values.to_numpy(zero_copy_only=False).astype(float).reshape(row["h"].as_py(), row["w"].as_py())
        return (resampled(image, rows, cols, nodata, method).ravel(),)
    return _in_row(tiles, {"regridded": T.ArrayType(T.DoubleType())}, ["h", "w", channel], grid)


def source_window(src: Grid, margin: int = 1) -> list[Column]:
    """r0, c0, height, width of the source pixels that a destination tile (ulx, sx, uly, sy, h, w) needs."""
    def axis(origin: str, step: str, n: str, start: float, size: float) -> tuple[Column, Column]:
        first = (F.col(origin) + d(0.5) * F.col(step) - d(start)) / d(size) - d(0.5)
        last = (F.col(origin) + (F.col(n) - d(0.5)) * F.col(step) - d(start)) / d(size) - d(0.5)
        low, high = F.floor(F.least(first, last)) - margin, F.floor(F.greatest(first, last)) + 1 + margin
        return low.cast("int"), (high - low + 1).cast("int")
    r0, height = axis("uly", "sy", "h", src[2], src[3])
    c0, width = axis("ulx", "sx", "w", src[0], src[1])
    return [r0.alias("r0"), c0.alias("c0"), height.alias("height"), width.alias("width")]


def regrid_across(tiles: DataFrame, wanted: DataFrame, channel: str, src: Grid, tile_h: int, tile_w: int, nodata: float,
                  method: str = "bilinear", keys: Sequence[str] = ("raster_id",), window: str = "window_id") -> DataFrame:
    """(keys, window, h, w, data): destination tiles (ulx, sx, uly, sy, h, w) resampled from a raster of many source tiles.

    Each destination tile reads the window of source pixels around it, wherever it lies, and is computed in its row. Equal to
    resampling the whole raster at once.
    """
    asked = wanted.select(*keys, window, "ulx", "sx", "uly", "sy", "h", "w", *source_window(src))
    pixels = read_windows(tiles, asked, [channel], tile_h, tile_w, keys, window, nodata, ["ulx", "sx", "uly", "sy", "h", "w"])

    def grid(row: dict) -> tuple:
        v = {n: row[n].as_py() for n in ("r0", "c0", "ulx", "sx", "uly", "sy", "h", "w")}
        rows = axis_places(v["h"], v["uly"], v["sy"], src[2], src[3]) - v["r0"]
        cols = axis_places(v["w"], v["ulx"], v["sx"], src[0], src[1]) - v["c0"]
        return (resampled(_image(row, channel), rows, cols, nodata, method).ravel(),)
    out = _in_row(pixels, {"data": T.ArrayType(T.DoubleType())}, ["r0", "c0", "height", "width", "ulx", "sx", "uly", "sy", "h", "w", channel], grid)
    return out.select(*keys, window, "h", "w", "data")
