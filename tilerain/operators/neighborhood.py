"""Neighborhood operators on pixel rows and on tile rows.

Pixel form: windows over one raster line. A tile is bounded, so `by_tile` hashes its pixels together once and every
line window after it is already co-located (one shuffle for any number of stencils).
Tile form: one row holds a whole channel, so a stencil needs no shuffle at all; the kernel is a vectorized function over
Arrow batches. Both give the same numbers.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilerain.functions.bands import clip_normalize, d, db_to_amplitude, db_to_power
from tilerain.schema import SAR_NODATA

# ---- fixed values: speckle filter defaults and display ranges in dB ----
LEE_KERNEL, LEE_DAMPING, LEE_CU, LEE_CMAX = 7, 1.0, 0.523, 1.73
DB_RANGE = {"vv": (-30.0, 0.0), "vh": (-30.0, -5.0)}
PSNR_EPS = 1e-10


def by_tile(pixels: DataFrame, tile: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Hash on the tile only: it satisfies every line window and per-tile aggregate that follows."""
    return pixels.repartition(*tile)


def along_rows(tile: Sequence[str]):
    return Window.partitionBy(*tile, "c").orderBy("r")


def along_cols(tile: Sequence[str]):
    return Window.partitionBy(*tile, "r").orderBy("c")


def gradient(pixels: DataFrame, value: str, tile: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Adds slope_y, slope_x: central differences inside, one-sided ones on the border."""
    def along(window) -> Column:
        ahead, behind, here = F.lead(value).over(window), F.lag(value).over(window), F.col(value)
        return F.when(ahead.isNull(), here - behind).when(behind.isNull(), ahead - here).otherwise((ahead - behind) / 2)
    return by_tile(pixels, tile).withColumn("slope_y", along(along_rows(tile))).withColumn("slope_x", along(along_cols(tile)))


def laplacian_variance(pixels: DataFrame, value: str, tile: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Sample variance of the 4-neighbor Laplacian, zero outside the tile."""
    down, across = along_rows(tile), along_cols(tile)
    around = (F.coalesce(F.lag(value).over(down), d(0)) + F.coalesce(F.lead(value).over(down), d(0))
              + F.coalesce(F.lag(value).over(across), d(0)) + F.coalesce(F.lead(value).over(across), d(0)))
    return (by_tile(pixels, tile).withColumn("_lap", around - d(4) * F.col(value)).groupBy(*tile)
            .agg(F.var_samp("_lap").alias("var_laplacian")))


def total_variation(pixels: DataFrame, value: str, tile: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Sum of squared vertical and horizontal steps, per tile and per pixel."""
    step_y = F.col(value) - F.lag(value).over(along_rows(tile))
    step_x = F.col(value) - F.lag(value).over(along_cols(tile))
    squares = F.coalesce(step_y * step_y, d(0)) + F.coalesce(step_x * step_x, d(0))
    return (by_tile(pixels, tile).withColumn("_tv", squares).groupBy(*tile)
            .agg(F.sum("_tv").alias("tv"), (F.sum("_tv") / F.count(F.lit(1))).alias("tv_per_pixel")))


def suppression_index(pixels: DataFrame, noisy: str, filtered: str, tile: Sequence[str] = ("tile_id",)) -> DataFrame:
    """(std / mean of the filtered power) x (mean / std of the noisy power); inputs in dB."""
    n, f = F.pow(d(10), F.col(noisy) / 10), F.pow(d(10), F.col(filtered) / 10)
    return pixels.groupBy(*tile).agg(
        ((F.stddev_samp(f) / F.avg(f)) * (F.avg(n) / F.stddev_samp(n))).alias("ssi"))


def equivalent_looks(pixels: DataFrame, db: str, tile: Sequence[str] = ("tile_id",)) -> DataFrame:
    power = F.pow(d(10), F.col(db) / 10)
    return pixels.groupBy(*tile).agg((F.avg(power) * F.avg(power) / F.nullif(F.var_samp(power), d(0))).alias("enl"))


def unit_amplitude(db: Column, channel: str) -> Column:
    low, high = (10 ** (v / 20) for v in DB_RANGE[channel])
    return clip_normalize(db_to_amplitude(db), low, high)


def unit_db(db: Column, channel: str) -> Column:
    return clip_normalize(db, *DB_RANGE[channel])


def psnr(pixels: DataFrame, value: str, truth: str, tile: Sequence[str] = ("tile_id",), peak: float = 1.0) -> DataFrame:
    gap = F.col(value) - F.col(truth)
    return pixels.groupBy(*tile).agg(
        (d(10) * F.log10(d(peak * peak) / (F.avg(gap * gap) + d(PSNR_EPS)))).alias("psnr"))


def leave_one_out(pixels: DataFrame, values: Sequence[str], key: Sequence[str] = ("stack_id", "r", "c"),
                  acq: str = "acq") -> DataFrame:
    """Mean of the other acquisitions at each pixel, nodata if any of them is missing.

    Adds `<v>_composite` per value and `union_missing` over all acquisitions and values. One group is one pixel's stack.
    """
    stack = Window.partitionBy(*key)
    out = pixels
    absent = {v: F.col(v) == d(SAR_NODATA) for v in values}
    n = F.count(F.lit(1)).over(stack)
    any_missing = F.lit(False)
    columns = []
    for v in values:
        gone = F.when(absent[v], 1).otherwise(0)
        gone_others = F.sum(gone).over(stack) - gone
        rest = F.sum(F.col(v)).over(stack) - F.col(v)
        columns.append(F.when((gone_others > 0) | (n < 2), d(SAR_NODATA)).otherwise(rest / (n - 1)).alias(f"{v}_composite"))
        any_missing = any_missing | absent[v]
    return out.select("*", *columns, F.max(any_missing).over(stack).alias("union_missing"))


def complete_stacks(pixels: DataFrame, acquisitions: int, stack: str = "stack_id", acq: str = "acq") -> DataFrame:
    """Stacks with exactly the required number of acquisitions."""
    full = (pixels.groupBy(stack).agg(F.count_distinct(acq).alias("_n")).where(F.col("_n") == acquisitions).select(stack))
    return pixels.join(full, stack, "left_semi")


def lee_weight(mean: Column, std: Column, damping: float, cu: float, cmax: float) -> Column:
    ci = F.when(mean != 0, std / mean).otherwise(d(0))
    return (F.when(ci <= cu, d(1)).when(ci >= cmax, d(0))
            .otherwise(F.exp(d(-damping) * (ci - d(cu)) / (d(cmax) - ci))))


def lee_filter(pixels: DataFrame, db: str, out: str, tile: Sequence[str] = ("tile_id",), kernel: int = LEE_KERNEL,
               damping: float = LEE_DAMPING, cu: float = LEE_CU, cmax: float = LEE_CMAX) -> DataFrame:
    """Enhanced Lee filter on pixel rows. The k x k sums split into a sum down the column and one along the row."""
    half = kernel // 2
    down, across = along_rows(tile).rangeBetween(-half, half), along_cols(tile).rangeBetween(-half, half)
    p = F.col("_p")
    step = (by_tile(pixels, tile).withColumn("_p", db_to_power(F.col(db)))
            .withColumn("_n1", F.sum(F.when(p != 0, 1).otherwise(0)).over(down))
            .withColumn("_s1", F.sum(p).over(down)).withColumn("_q1", F.sum(p * p).over(down))
            .withColumn("_n", F.sum("_n1").over(across))
            .withColumn("_s", F.sum("_s1").over(across)).withColumn("_q", F.sum("_q1").over(across)))
    n = F.nullif(F.col("_n"), F.lit(0))
    mean = F.col("_s") / n
    spread = (F.col("_q") / n - mean * mean) * n / F.nullif(n - 1, F.lit(0))
    std = F.when(n == 1, d(0)).otherwise(F.sqrt(F.greatest(d(0), spread)))
    weight = lee_weight(F.col("_mean"), F.col("_std"), damping, cu, cmax)
    mixed = F.col("_mean") * F.col("_w") + p * (d(1) - F.col("_w"))
    return (step.withColumn("_mean", mean).withColumn("_std", std).withColumn("_w", weight).withColumn("_mixed", mixed)
            .select(*pixels.columns, F.when((p != 0) & (F.col("_mixed") > 0), d(10) * F.log10("_mixed"))
                    .otherwise(d(SAR_NODATA)).alias(out)))


# ---- tile form -------------------------------------------------------------------------------------------------

def box_sum(a: np.ndarray, half: int) -> np.ndarray:
    """Sums over the (2 half + 1)^2 window cut at the border, by a summed-area table."""
    h, w = a.shape
    table = np.zeros((h + 1, w + 1))
    table[1:, 1:] = a.cumsum(0).cumsum(1)
    top, bottom = np.clip(np.arange(h) - half, 0, h), np.clip(np.arange(h) + half + 1, 0, h)
    left, right = np.clip(np.arange(w) - half, 0, w), np.clip(np.arange(w) + half + 1, 0, w)
    return table[np.ix_(bottom, right)] - table[np.ix_(top, right)] - table[np.ix_(bottom, left)] + table[np.ix_(top, left)]


def lee_array(db: np.ndarray, kernel: int, damping: float, cu: float, cmax: float) -> np.ndarray:
    present = db != SAR_NODATA
    power = np.where(present, np.float_power(10.0, db / 10), 0.0)
    n = box_sum(present.astype(float), kernel // 2)
    s, q = box_sum(power, kernel // 2), box_sum(power * power, kernel // 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = s / n
        std = np.where(n > 1, np.sqrt(np.maximum(0.0, (q / n - mean * mean) * n / (n - 1))), 0.0)
        ci = np.where(mean != 0, std / mean, 0.0)
        weight = np.where(ci <= cu, 1.0, np.where(ci >= cmax, 0.0, np.exp(-damping * (ci - cu) / (cmax - ci))))
        mixed = mean * weight + power * (1 - weight)
        return np.where(present & (mixed > 0), 10 * np.log10(mixed), SAR_NODATA)


def lee_filter_tiles(tiles: DataFrame, column: str = "data", kernel: int = LEE_KERNEL, damping: float = LEE_DAMPING,
                     cu: float = LEE_CU, cmax: float = LEE_CMAX) -> DataFrame:
    """Enhanced Lee filter on tile rows (`h`, `w`, row-major `data` in dB): narrow, one Arrow pass."""
    @F.pandas_udf("array<double>")
    def filtered(data: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([
            lee_array(np.asarray(v, dtype=float).reshape(hh, ww), kernel, damping, cu, cmax).ravel()
            for v, hh, ww in zip(data, h, w)])
    return tiles.withColumn(column, filtered(F.col(column), F.col("h"), F.col("w")))


def gradient_tiles(tiles: DataFrame, column: str = "data") -> DataFrame:
    """Adds `slope_y`, `slope_x` arrays to tile rows; narrow."""
    def slope(axis: int):
        @F.pandas_udf("array<double>")
        def along(data: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
            return pd.Series([np.gradient(np.asarray(v, dtype=float).reshape(hh, ww), axis=axis).ravel()
                              for v, hh, ww in zip(data, h, w)])
        return along(F.col(column), F.col("h"), F.col("w"))
    return tiles.withColumn("slope_y", slope(0)).withColumn("slope_x", slope(1))


def laplacian_variance_tiles(tiles: DataFrame, column: str = "data") -> DataFrame:
    """Adds `var_laplacian` to tile rows; narrow."""
    @F.pandas_udf("double")
    def spread(data: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for v, hh, ww in zip(data, h, w):
            framed = np.pad(np.asarray(v, dtype=float).reshape(hh, ww), 1)
            inner = framed[1:-1, 1:-1]
            around = framed[:-2, 1:-1] + framed[2:, 1:-1] + framed[1:-1, :-2] + framed[1:-1, 2:]
            out.append((around - 4 * inner).var(ddof=1))
        return pd.Series(out, dtype="float64")
    return tiles.withColumn("var_laplacian", spread(F.col(column), F.col("h"), F.col("w")))


def leave_one_out_tiles(tiles: DataFrame, acquisitions: int, column: str = "data", stack: str = "stack_id",
                        acq: str = "acq") -> DataFrame:
    """(stack, acq, h, w, data, composite) rows of stacks with exactly `acquisitions` tiles.

    Stacks of any other size are left out by their count first, so what is gathered is a handful of compact tile rows.
    """
    counts = tiles.groupBy(stack).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(acq).alias("_d"))
    fitting = counts.where((F.col("_n") == acquisitions) & (F.col("_d") == acquisitions)).select(stack)
    layers = F.array_sort(F.collect_list(F.struct(acq, "h", "w", column)))
    full = (tiles.join(fitting, stack, "left_semi").groupBy(stack).agg(layers.alias("_layers"))
            .withColumn("_values", F.transform("_layers", lambda s: s[column])))

    @F.pandas_udf("array<array<double>>")
    def others(stacks: pd.Series) -> pd.Series:
        out = []
        for layers in stacks:
            values = np.stack([np.asarray(v, dtype=float) for v in layers])
            gone = values == SAR_NODATA
            rest = (values.sum(0) - values) / (len(values) - 1)
            out.append(list(np.where(gone.sum(0) - gone > 0, SAR_NODATA, rest)))
        return pd.Series(out)
    merged = full.withColumn("_others", others("_values"))
    return merged.select(stack, F.inline(F.transform(
        F.arrays_zip(F.col("_layers").alias("a"), F.col("_others").alias("b")),
        lambda s: F.struct(s["a"][acq].alias(acq), s["a"]["h"].alias("h"), s["a"]["w"].alias("w"),
                           s["a"][column].alias(column), s["b"].alias("composite")))))


def gaussian_taps(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(size) - size // 2
    g = np.exp(-(x ** 2) / (2 * sigma ** 2))
    return g / g.sum()


def smooth(a: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Separable smoothing without padding; an axis shorter than the taps is left as it is."""
    for axis in (0, 1):
        length = a.shape[axis] - len(taps) + 1
        if length > 0:
            a = sum(t * a.take(range(i, i + length), axis=axis) for i, t in enumerate(taps))
    return a


def ssim_array(x: np.ndarray, y: np.ndarray, taps: np.ndarray, span: float = 1.0) -> float:
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    mx, my = smooth(x, taps), smooth(y, taps)
    vx, vy = smooth(x * x, taps) - mx * mx, smooth(y * y, taps) - my * my
    cov = smooth(x * y, taps) - mx * my
    return float((((2 * mx * my + c1) / (mx * mx + my * my + c1)) * ((2 * cov + c2) / (vx + vy + c2))).mean())


def ssim_tiles(tiles: DataFrame, value: str, truth: str) -> DataFrame:
    """Adds `ssim` of two row-major unit-range arrays of the same h x w."""
    taps = gaussian_taps()

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([
            ssim_array(np.asarray(p, dtype=float).reshape(hh, ww), np.asarray(q, dtype=float).reshape(hh, ww), taps)
            for p, q, hh, ww in zip(a, b, h, w)], dtype="float64")
    return tiles.withColumn("ssim", score(F.col(value), F.col(truth), F.col("h"), F.col("w")))


def despeckling_report(pixels: DataFrame, channel: str, tile: Sequence[str] = ("tile_id",),
                       homogeneous: DataFrame | None = None) -> DataFrame:
    """Mean PSNR, SSIM, Laplacian variance and looks per modality of (modality, tile, r, c, db, clean_db) rows.

    Looks are taken from the `homogeneous` rows (modality, tile, r, c, db) when given. One shuffle on (modality, tile)
    serves the stencil, the per-tile sums and the arrays for the similarity kernel.
    """
    key = ["modality", *tile]
    unit = by_tile(pixels, key).withColumn("_a", unit_amplitude(F.col("db"), channel)).withColumn(
        "_t", unit_amplitude(F.col("clean_db"), channel)).withColumn("_u", unit_db(F.col("db"), channel))
    down, across = along_rows(key), along_cols(key)
    around = (F.coalesce(F.lag("_u").over(down), d(0)) + F.coalesce(F.lead("_u").over(down), d(0))
              + F.coalesce(F.lag("_u").over(across), d(0)) + F.coalesce(F.lead("_u").over(across), d(0)))
    gap, power = F.col("_a") - F.col("_t"), F.pow(d(10), F.col("db") / 10)
    looks = F.avg(power) * F.avg(power) / F.nullif(F.var_samp(power), d(0))
    cells = F.array_sort(F.collect_list(F.struct("r", "c", "_a", "_t")))
    per_tile = unit.withColumn("_lap", around - d(4) * F.col("_u")).groupBy(*key).agg(
        (d(10) * F.log10(d(1) / (F.avg(gap * gap) + d(PSNR_EPS)))).alias("psnr"), F.var_samp("_lap").alias("var_lap"),
        looks.alias("enl"), cells.alias("_cells"), (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    compared = ssim_tiles(per_tile.withColumn("_x", F.transform("_cells", lambda s: s["_a"]))
                          .withColumn("_y", F.transform("_cells", lambda s: s["_t"])).drop("_cells"), "_x", "_y")
    report = compared.groupBy("modality").agg(*[F.avg(m).alias(m) for m in ("psnr", "ssim", "var_lap", "enl")])
    if homogeneous is None:
        return report
    flat = homogeneous.groupBy(*key).agg(looks.alias("enl")).groupBy("modality").agg(F.avg("enl").alias("enl"))
    return report.drop("enl").join(flat, "modality", "left")


def despeckling_table(by_channel: dict[str, DataFrame]) -> DataFrame:
    """One row per modality with the metrics of every channel side by side."""
    out = None
    for channel, report in by_channel.items():
        named = report.select("modality", *[F.col(c).alias(f"{c}_{channel}") for c in report.columns if c != "modality"])
        out = named if out is None else out.join(named, "modality")
    return out
