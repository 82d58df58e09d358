"""Patch preprocessing as one DAG: labels and splits -> tile statistics -> accepted windows -> patch arrays."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilerain.operators.patches import cut_windows, random_spots, strided_spots
from tilerain.operators.stacking import exploded
from tilerain.operators.stats import masked_moments
from tilerain.schema import CLOUD_CLASSES, SAR_NODATA


def flagged(tiles: DataFrame, red: str = "red") -> DataFrame:
    """Adds the missing and cloud flag arrays of stacked radar tiles (vv, vh, red, scl arrays)."""
    zipped = F.arrays_zip(F.col("vv").alias("vv"), F.col("vh").alias("vh"), F.col(red).alias("red"))
    nodata = F.lit(SAR_NODATA)
    return tiles.withColumns({
        "missing": F.transform(zipped, lambda p: F.when((p["vv"] == nodata) | (p["vh"] == nodata) | (p["red"] == 0), 1).otherwise(0)),
        "clouds": F.transform("scl", lambda v: F.when(v.isin(*CLOUD_CLASSES), 1).otherwise(0))})


def training_statistics(tiles: DataFrame, channels: Sequence[str], constant: Sequence[str]) -> DataFrame:
    """Masked channel statistics over the training tiles; pixel rows are only ever partial aggregates."""
    px = exploded(flagged(tiles.where(F.col("split") == "train")), [*channels, "missing"])
    return masked_moments(px, list(channels), F.col("missing") == 0, list(constant))


def patches(tiles: DataFrame, channels: Sequence[str], size: int, method: str, stride: int = 0, samples: int = 0,
            seed: int = 0, max_missing: float = 0.0, max_cloud: float = 0.1) -> DataFrame:
    """(split, tile_id, x0, y0, size, channels) rows of accepted windows. Narrow from the tile rows on."""
    ready = flagged(tiles)
    if method == "strided":
        spots = strided_spots(ready, size, stride, "missing", "clouds", max_missing, max_cloud)
    elif method == "random":
        spots = random_spots(ready, size, samples, seed, "missing", "clouds", max_missing, max_cloud)
    else:
        raise ValueError(f"unknown method {method!r}, use 'random' or 'strided'")
    wins = cut_windows(spots, channels, size, ["split", "tile_id"])
    arrays = [v for c in channels for v in (F.lit(c), F.col(c).cast("array<float>"))]
    return wins.select("split", "tile_id", "x0", "y0", F.lit(size).alias("size"), F.create_map(*arrays).alias("channels"))
