"""Sliding-window scoring and overlap blending.

A scorer is `factory() -> f(batch)`: the factory runs once per Python worker (load weights there), `f` maps a float array
(n, channels, size, size) to (n, size, size), or to (n, outputs, size, size) where several maps are made. `index_scorer` and
`smoothing_scorer` are closed-form defaults, so jobs run without weights.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilerain.functions.bands import d, masked_prediction, predicted
from tilerain.operators.patches import axis_positions, cut_windows, require_fit

Scorer = Callable[[np.ndarray], np.ndarray]


def index_scorer(scale: float = 10.0, threshold: float = 0.0) -> Callable[[], Scorer]:
    """Probability from the first channel alone: logistic of scale * (value - threshold)."""
    def factory() -> Scorer:
        return lambda batch: 1.0 / (1.0 + np.exp(-scale * (batch[:, 0] - threshold)))
    return factory


def smoothing_scorer(share: float = 0.5) -> Callable[[], Scorer]:
    """One map per channel: every pixel is pulled to its window's mean of that channel by `share`."""
    def factory() -> Scorer:
        return lambda batch: (1 - share) * batch + share * batch.mean(axis=(2, 3), keepdims=True)
    return factory


def window_weights(size: int, kind: str = "uniform", floor: float = 1e-3) -> list[float]:
    """Row-major blending weights: ones, or a symmetric Hann window floored so that borders keep some weight."""
    if kind == "uniform":
        return [1.0] * (size * size)
    if kind != "hann":
        raise ValueError(f"unknown weighting {kind!r}, use 'uniform' or 'hann'")
    line = np.hanning(size)
    return np.maximum(np.outer(line, line), floor).ravel().tolist()


def windows(tiles: DataFrame, channels: Sequence[str], size: int, stride: int) -> DataFrame:
    """Sliding windows with edge coverage; each channel array is cut to the window. Narrow."""
    rows, columns = axis_positions(F.col("h"), size, stride), axis_positions(F.col("w"), size, stride)
    every = F.flatten(F.transform(rows, lambda x: F.transform(columns, lambda y: F.struct(x.alias("x0"), y.alias("y0")))))
    return cut_windows(require_fit(tiles, size).withColumn("spots", every), channels, size)


def scored_windows(cut_windows: DataFrame, channels: Sequence[str], size: int, factory: Callable[[], Scorer]) -> DataFrame:
    """Adds `scores` (row-major) to window rows; one model per worker, one call per Arrow batch."""
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        scorer = factory()
        for corner, *parts in batches:
            stacked = np.stack([np.stack(p.to_numpy()).reshape(-1, size, size) for p in parts], axis=1)
            out = np.asarray(scorer(stacked), dtype=float).reshape(len(corner), size * size)
            yield pd.Series(list(out))
    return cut_windows.withColumn("scores", run(F.col("x0"), *[F.col(c) for c in channels]))


def blended(scored: DataFrame, size: int, weighting: str = "uniform", scores: str = "scores") -> DataFrame:
    """Weighted mean of overlapping window scores per (tile_id, r, c); sums combine map-side."""
    at = F.posexplode(F.arrays_zip(F.col(scores).alias("v"), F.array(*[d(w) for w in window_weights(size, weighting)])
                                   .alias("w"))).alias("pos", "s")
    flat = scored.select("tile_id", "x0", "y0", at)
    r, c = F.col("x0") + F.floor(F.col("pos") / size), F.col("y0") + F.col("pos") % size
    return flat.groupBy("tile_id", r.cast("int").alias("r"), c.cast("int").alias("c")).agg(
        (F.sum(F.col("s.v") * F.col("s.w")) / F.greatest(F.sum("s.w"), d(1e-3))).alias("prob"))


def tile_scores(tiles: DataFrame, channels: Sequence[str], size: int, factory: Callable[[], Scorer],
                stride: int | None = None, weighting: str = "uniform") -> DataFrame:
    """The same result in tile form: windows, scores and blending of a tile stay in its row, without a shuffle.

    Window corners come from the plan. A window is a gather from the flat image, and blending is a weighted count of the
    same flat indices.
    """
    step = stride if stride is not None else size - size // 4
    weight = np.asarray(window_weights(size, weighting))
    row, col = np.divmod(np.arange(size * size), size)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        scorer = factory()
        for heights, widths, tops, lefts, *parts in batches:
            maps = []
            for h, w, top, left, *layers in zip(heights, widths, tops, lefts, *parts):
                x0, y0 = (a.ravel() for a in np.meshgrid(top, left, indexing="ij"))
                spot = (x0[:, None] + row) * w + y0[:, None] + col
                image = np.stack([np.asarray(layer, dtype=float) for layer in layers])
                batch = image[:, spot].swapaxes(0, 1).reshape(len(spot), len(layers), size, size)
                scores = np.asarray(scorer(batch), dtype=float).reshape(spot.shape)
                total = np.bincount(spot.ravel(), (scores * weight).ravel(), h * w)
                mass = np.bincount(spot.ravel(), np.broadcast_to(weight, spot.shape).ravel(), h * w)
                maps.append(total / np.maximum(mass, 1e-3))
            yield pd.Series(maps)

    ready = require_fit(tiles, size)
    corners = [axis_positions(F.col(side), size, step) for side in ("h", "w")]
    return ready.withColumn("prob", run(F.col("h"), F.col("w"), *corners, *[F.col(c) for c in channels]))


def blended_maps(image: np.ndarray, spots: np.ndarray, size: int, outputs: int, scorer: Scorer, weight: np.ndarray,
                 batch: int) -> np.ndarray:
    """Weighted mean (outputs, pixels) of the window maps of one image (channels, pixels); `spots` lists each window's pixels."""
    pixels = image.shape[1]
    total, mass = np.zeros((outputs, pixels)), np.zeros(pixels)
    for at in range(0, len(spots), batch):
        some = spots[at:at + batch]
        maps = np.asarray(scorer(image[:, some].swapaxes(0, 1).reshape(len(some), len(image), size, size)), dtype=float)
        maps = maps.reshape(len(some), outputs, size * size) * weight
        for k in range(outputs):
            total[k] += np.bincount(some.ravel(), maps[:, k].ravel(), pixels)
        mass += np.bincount(some.ravel(), np.broadcast_to(weight, some.shape).ravel(), pixels)
    return total / np.maximum(mass, 1e-3)


def tile_maps(tiles: DataFrame, channels: Sequence[str], outputs: dict[str, tuple[float, float]], size: int,
              factory: Callable[[], Scorer], moments: dict[str, tuple[float, float]], stride: int | None = None,
              weighting: str = "uniform", nodata: float | None = None, batch: int = 128) -> DataFrame:
    """Adds one blended map per output of a scorer that makes several, in tile form, without a shuffle.

    A pixel that is nodata (or null) in any channel is missing in all: it is fed as the channels' means and is nodata again in
    every map. Channels enter standardized by their `moments` (mean, std); a map is scaled back by the moments of its name in
    `outputs`. Windows are scored `batch` at a time. A tile with a null channel has null maps; one whose arrays don't hold
    h * w values fails.
    """
    step = stride if stride is not None else size - size // 4
    weight = np.asarray(window_weights(size, weighting))
    row, col = np.divmod(np.arange(size * size), size)
    mean, std = (np.array([moments[c][i] for c in channels])[:, None] for i in (0, 1))
    back_mean, back_std = (np.array([m[i] for m in outputs.values()])[:, None] for i in (0, 1))
    schema = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in outputs])

    def one(scorer: Scorer, h: int, w: int, top, left, layers) -> list:
        if any(layer is None for layer in layers):
            return [None] * len(outputs)
        if any(len(layer) != h * w for layer in layers):
            raise ValueError(f"a tile of {h} by {w} has channels of {[len(layer) for layer in layers]} values")
        image = np.stack([np.asarray(layer, dtype=float) for layer in layers])
        gone = np.isnan(image).any(axis=0)
        if nodata is not None:
            gone |= (image == nodata).any(axis=0)
        image = (np.where(gone, mean, image) - mean) / std
        x0, y0 = (a.ravel() for a in np.meshgrid(top, left, indexing="ij"))
        maps = blended_maps(image, (x0[:, None] + row) * w + y0[:, None] + col, size, len(outputs), scorer, weight, batch)
        return list(np.where(gone, np.nan if nodata is None else nodata, maps * back_std + back_mean))

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for heights, widths, tops, lefts, *parts in batches:
            rows = [one(scorer, h, w, top, left, layers) for h, w, top, left, *layers in zip(heights, widths, tops, lefts, *parts)]
            yield pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(outputs)})

    corners = [axis_positions(F.col(side), size, step) for side in ("h", "w")]
    ready = require_fit(tiles, size).withColumn("_maps", run(F.col("h"), F.col("w"), *corners, *[F.col(c) for c in channels]))
    return ready.withColumns({n: F.col(f"_maps.{n}") for n in outputs}).drop("_maps")


def final_map(scores: DataFrame, missing: Column, threshold: float = 0.5) -> DataFrame:
    """Inclusive threshold for maps; missing input is never water."""
    return scores.withColumn("water", masked_prediction(predicted(F.col("prob"), threshold, inclusive=True), missing))


def despeckle_targets(files: DataFrame, done: DataFrame) -> DataFrame:
    """VV/VH pairs not yet despeckled: both inputs must exist, the output must not."""
    pairs = files.groupBy("eid", "s2_date", "s1_date").agg(
        F.bool_or(F.col("polarization") == "vv").alias("_vv"), F.bool_or(F.col("polarization") == "vh").alias("_vh"))
    return (pairs.where("_vv AND _vh").drop("_vv", "_vh").join(
        done.select("eid", "s2_date", "s1_date"), ["eid", "s2_date", "s1_date"], "left_anti"))


# ---- fixed values: file prefix by speckle filter ----
SAR_PREFIX = {"none": "sar", "enhanced_lee": "enhanced_lee", "cvae": "cvae"}


def sar_variant(rows: DataFrame, filter_type: str) -> DataFrame:
    """Rows of the requested speckle-filter variant; captures without it drop out."""
    if filter_type not in SAR_PREFIX:
        raise ValueError(f"no speckle filter {filter_type!r}, only {sorted(SAR_PREFIX)}")
    return rows.where(F.col("variant") == SAR_PREFIX[filter_type])


def mean_filled(values: Column, mean: float, nodata: float) -> Column:
    """Array with nodata replaced by the training mean; the caller restores nodata after blending."""
    return F.transform(values, lambda v: F.when(v == d(nodata), d(mean)).otherwise(v))
