"""Pixel statistics (E1-E14, E29-E32, E42, E44, E45). All are built-in aggregates with map-side combine."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilerain.functions.bands import d


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, d(1)).otherwise(d(0)))


def whole_percent(condition: Column) -> Column:
    """Percent 0-100 cut to an integer. From counts, so that no product of a rounded share is cut."""
    hits = F.count_if(condition)
    return F.floor(hits / F.count(F.lit(1)) * d(100)).cast("int")


def cover_percent(df: DataFrame, keys: list[str], scl: str = "scl") -> DataFrame:
    return df.groupBy(*keys).agg(whole_percent(F.col(scl).isin(0, 8, 9)).alias("cover_pct"))


def radar_missing_percent(df: DataFrame, keys: list[str], power: str = "power") -> DataFrame:
    """Whole and fractional percent of non-positive power."""
    bad = F.col(power) <= 0
    return df.groupBy(*keys).agg(whole_percent(bad).alias("missing_int"),
                                 (F.count_if(bad) / F.count(F.lit(1)) * d(100)).alias("missing_pct"))


def class_percent(df: DataFrame, keys: list[str], dn: str, scl: str, classes: list[int]) -> DataFrame:
    return df.groupBy(*keys).agg(whole_percent(F.col(dn) == 0).alias("null_pct"),
                                 whole_percent(F.col(scl).isin(*classes)).alias("class_pct"))


def patch_fractions(df: DataFrame, keys: list[str], missing: Column, scl: str = "scl") -> DataFrame:
    return df.groupBy(*keys).agg(share(missing).alias("missing_fraction"),
                                 share(F.col(scl).isin(8, 9)).alias("cloud_fraction"))


def long_channels(df: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """One row per key and channel; narrow."""
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.channel", "_p.value")


def masked_moments(df: DataFrame, channels: list[str], valid: Column, constant: list[str] = ()) -> DataFrame:
    """Mean, sample std (1 below two values), min, max and count per channel over valid pixels.

    `constant` lists binary or index channels, which keep mean 0 and std 1. All channels aggregate in one pass over the
    unexploded rows; only the one-row result is unpivoted.
    """
    aggregates = [F.count(F.when(valid, F.lit(1))).alias("n")]
    for c in channels:
        value = F.when(valid, F.col(c).cast("double"))
        aggregates += [F.avg(value).alias(f"{c}_mean"), F.stddev_samp(value).alias(f"{c}_std"),
                       F.min(value).alias(f"{c}_min"), F.max(value).alias(f"{c}_max")]
    one = df.agg(*aggregates)
    rows = F.array(*[F.struct(
        F.lit(c).alias("channel"), F.col("n"),
        (d(0) if c in constant else F.coalesce(F.col(f"{c}_mean"), d(0))).alias("mean"),
        (d(1) if c in constant else F.when(F.col("n") < 2, d(1)).otherwise(F.col(f"{c}_std"))).alias("std"),
        F.coalesce(F.col(f"{c}_min"), d(float("inf"))).alias("min"),
        F.coalesce(F.col(f"{c}_max"), d(float("-inf"))).alias("max")) for c in channels])
    return one.select(F.inline(rows))


def population_moments(df: DataFrame, channels: list[str], valid: Column) -> DataFrame:
    aggregates = []
    for c in channels:
        value = F.when(valid, F.col(c).cast("double"))
        aggregates += [F.avg(value).alias(f"{c}_mean"), F.stddev_pop(value).alias(f"{c}_std")]
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_mean").alias("mean"),
                              F.col(f"{c}_std").alias("std")) for c in channels])
    return df.agg(*aggregates).select(F.inline(rows))


def running_mean_var(df: DataFrame, keys: list[str], value: str, unbiased: bool = False) -> DataFrame:
    variance = F.var_samp(value) if unbiased else F.var_pop(value)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.greatest(variance, d(0)).alias("var"))


def imputed(df: DataFrame, keys: list[str], value: str, missing: Column, fallback: str = "zero") -> DataFrame:
    """Fills missing pixels with the mean of the valid ones of the same tile and channel.

    The tile means are a small aggregate joined back, which is cheaper than a window over all pixels.
    An entirely missing tile gives 0 (`zero`) or an error (`error`).
    """
    means = df.groupBy(*keys).agg(F.avg(F.when(~missing, F.col(value))).alias("_mean"))
    if fallback == "error":
        empty = F.raise_error(F.lit("no value left to fill from")).cast("double")
    elif fallback == "zero":
        empty = d(0)
    else:
        raise ValueError(f"unknown fallback {fallback!r}")
    filled = F.when(missing, F.coalesce(F.col("_mean"), empty)).otherwise(F.col(value))
    return df.join(means, keys).withColumn(value, filled).drop("_mean")


def imputed_from_stats(df: DataFrame, stats: DataFrame, value: str, missing: Column) -> DataFrame:
    """Fills with the training mean of the channel; `stats` is one row per channel, hence broadcast."""
    means = stats.select("channel", F.col("mean").alias("_mean"))
    return df.join(F.broadcast(means), "channel").withColumn(
        value, F.when(missing, F.col("_mean")).otherwise(F.col(value))).drop("_mean")


def standardized(df: DataFrame, stats: DataFrame, value: str = "value", override: DataFrame | None = None) -> DataFrame:
    """(value - mean) / std per channel; `override` replaces the statistics of some channels."""
    table = stats.select("channel", F.col("mean").alias("_m"), F.col("std").alias("_s"))
    if override is not None:
        other = override.select("channel", F.col("mean").alias("_om"), F.col("std").alias("_os"))
        table = table.join(other, "channel", "left").select(
            "channel", F.coalesce("_om", "_m").alias("_m"), F.coalesce("_os", "_s").alias("_s"))
    return df.join(F.broadcast(table), "channel").withColumn(
        value, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def label_pixel_stats(df: DataFrame, keys: list[str], label: str, clip: float = 10.0) -> DataFrame:
    """Positive and negative pixel totals and the positive-class weight clipped to [1, clip]."""
    sums = df.groupBy(*keys).agg(F.sum(F.col(label).cast("double")).alias("pos"),
                                 F.count(label).cast("double").alias("total"))
    neg = F.greatest(F.col("total") - F.col("pos"), d(1))
    weight = F.greatest(d(1), F.least(neg / F.greatest(F.col("pos"), d(1)), d(clip)))
    return sums.select(*keys, "pos", neg.alias("neg"), "total", weight.alias("pos_weight"))


def wet_patches(df: DataFrame, keys: list[str], label: str, more_than: int = 100) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(label) > more_than).cast("int").alias("wet"))


def water_share(df: DataFrame, tile: str, label: str) -> DataFrame:
    """Mean over tiles of the tile's water and dry percent."""
    per_tile = df.groupBy(tile).agg((F.avg(F.col(label).cast("double")) * 100).alias("water"))
    return per_tile.agg(F.avg("water").alias("water_pct"), F.avg(d(100) - F.col("water")).alias("dry_pct"))


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """Counts of equal bins; the top edge belongs to the last bin, values outside are not counted."""
    width = (high - low) / bins
    spot = F.least(F.floor((F.col(value) - d(low)) / d(width)), F.lit(bins - 1)).cast("int")
    return (df.where(F.col(value).between(low, high)).groupBy(*keys, spot.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def odd_labels(df: DataFrame, tile: str, value: str) -> DataFrame:
    """Tiles with label values other than 0 and 255."""
    return (df.groupBy(tile).agg(F.count_if(~F.col(value).isin(0, 255)).alias("odd_pixels"))
            .where(F.col("odd_pixels") > 0))


def look_average(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over stochastic draws of the same pixel."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("looks"))
