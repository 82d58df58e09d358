"""Scoring and evaluation: imputation -> standardization -> windows -> blended map -> class metrics."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilerain.functions.bands import d
from tilerain.operators.metrics import confusion_by_group, core_row
from tilerain.operators.scoring import Scorer, tile_scores
from tilerain.operators.stacking import exploded


def prepared(tiles: DataFrame, stats: dict[str, tuple[float, float]], radar: Sequence[str], nodata: float) -> DataFrame:
    """Radar channels filled with their tile mean (0 for an empty tile), all channels standardized, `missing` kept.

    `stats` maps a channel to (mean, std); they are a handful of numbers, so they enter the plan as literals.
    """
    out = tiles
    gone = None
    for c in radar:
        flags = F.transform(c, lambda v: v == d(nodata))
        gone = flags if gone is None else F.zip_with(gone, flags, lambda a, b: a | b)
    out = out.withColumn("missing", gone)
    for c in radar:
        valid = F.filter(c, lambda v: v != d(nodata))
        mean = F.when(F.size(valid) > 0, F.aggregate(valid, d(0), lambda a, v: a + v) / F.size(valid)).otherwise(d(0))
        out = out.withColumn("_mean", mean).withColumn(c, F.transform(
            c, lambda v: F.when(v == d(nodata), F.col("_mean")).otherwise(v))).drop("_mean")
    return out.withColumns({c: _standardized(c, *moments) for c, moments in stats.items()})


def _standardized(channel: str, mean: float, std: float) -> Column:
    return F.transform(channel, lambda v: (v - d(mean)) / d(std))


def scored_pixels(tiles: DataFrame, channels: Sequence[str], size: int, factory: Callable[[], Scorer],
                  keep: Sequence[str] = ()) -> DataFrame:
    """Pixel rows with blended probability and the carried layers; no shuffle before the metrics."""
    maps = tile_scores(tiles, channels, size, factory)
    return exploded(maps, ["prob", "missing", *keep])


def evaluated(pixels: DataFrame, keys: Sequence[str], system: str) -> tuple[DataFrame, DataFrame]:
    """Core row and per-group rows of scored pixels."""
    return core_row(pixels, None, keys), confusion_by_group(pixels, system, keys)
