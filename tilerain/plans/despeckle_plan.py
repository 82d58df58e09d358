"""Despeckling of radar captures: open pairs -> joint mask -> overlapping windows -> blended VV and VH tiles, written per capture."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilerain.operators.scoring import SAR_PREFIX, Scorer, despeckle_targets, tile_maps
from tilerain.operators.stacking import stacked
from tilerain.schema import SAR_NODATA
from tilerain.sources.sinks import exists, write_captures

CAPTURE = ["eid", "s2_date", "s1_date"]
POLARIZATIONS = ["vv", "vh"]


def finished(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """Captures whose VV and VH outputs of a variant are both there; none where nothing was written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], "eid string, s2_date string, s1_date string")
    rows = spark.read.parquet(path).where(F.col("variant") == variant)
    both = rows.groupBy(*CAPTURE).agg(F.count_distinct("polarization").alias("_n")).where(F.col("_n") == len(POLARIZATIONS))
    return both.select(*[F.col(c).cast("string").alias(c) for c in CAPTURE])


def despeckled(tiles: DataFrame, done: DataFrame | None, moments: dict[str, tuple[float, float]], size: int,
               factory: Callable[[], Scorer], stride: int = 32, weighting: str = "hann", variant: str = "cvae",
               batch: int = 128) -> DataFrame:
    """(capture, variant, polarization, h, w, data) of each capture that is not done, in dB with nodata where any input misses.

    `tiles` holds one row per capture and polarization (h, w, data in dB). Captures without one of the two drop out; `done`
    lists the finished ones, None repeats all. The tile arrays are shuffled once, on the capture; all else stays in the row.
    """
    if variant not in SAR_PREFIX:
        raise ValueError(f"no speckle filter {variant!r}, only {sorted(SAR_PREFIX)}")
    listed = tiles.select(*CAPTURE, "polarization")
    none = listed.select(*CAPTURE).limit(0)
    wanted = despeckle_targets(listed, none if done is None else done)
    rows = tiles.withColumnRenamed("polarization", "channel").join(wanted, CAPTURE, "left_semi")
    pairs = stacked(rows.select(*CAPTURE, "channel", "h", "w", "data"), POLARIZATIONS, CAPTURE)
    named = {f"_{p}": moments[p] for p in POLARIZATIONS}
    maps = tile_maps(pairs.withColumn("tile_id", F.concat_ws("_", *CAPTURE)), POLARIZATIONS, named, size, factory, moments, stride,
                     weighting, SAR_NODATA, batch)
    sides = F.array(*[F.struct(F.lit(p).alias("polarization"), F.col(f"_{p}").alias("data")) for p in POLARIZATIONS])
    # two arrays per row pass this generator, both of which it gives out
    return maps.select(*CAPTURE, F.lit(variant).alias("variant"), "h", "w", F.inline(sides)).select(
        *CAPTURE, "variant", "polarization", "h", "w", "data")


def despeckle(tiles: DataFrame, path: str, moments: dict[str, tuple[float, float]], size: int, factory: Callable[[], Scorer],
              replace: bool = False, variant: str = "cvae", **options) -> None:
    """Runs the job. What was written stays unless `replace`; a run that broke off is taken up by starting it again, since a
    capture's folder is replaced as a whole."""
    done = None if replace else finished(tiles.sparkSession, path, variant)
    rows = despeckled(tiles, done, moments, size, factory, variant=variant, **options)
    write_captures(rows.withColumn("data", F.col("data").cast("array<float>")), path, ["variant", *CAPTURE])
