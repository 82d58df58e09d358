"""Daily grid ingest and the contiguous precipitation cube (A1, A2, A10)."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilerain.functions.dates import date_to_index
from tilerain.schema import CUBE_START, PRECIP_NODATA

GRID_CELL = "day string, y int, x int, precip float"


def _grid_files(spark: SparkSession, path: str, first: str | None, last: str | None) -> DataFrame:
    """Grid files with `day`, the first run of eight digits in the name. Days outside first..last (YYYYMMDD) are dropped
    when files are listed, since only the name decides."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bil").option("recursiveFileLookup", "true").load(path)
    day = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{8})", 1)
    for wanted in ([] if first is None else [day >= first]) + ([] if last is None else [day <= last]):
        files = files.where(wanted)
    return files.select(day.alias("day"), "content")


def grid_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """event_date of every grid file, from the names alone: no file is opened."""
    return _grid_files(spark, path, first, last).select(F.to_date("day", "yyyyMMdd").alias("event_date"))


def read_daily_grids(spark: SparkSession, path: str, height: int, width: int, first: str | None = None, last: str | None = None) -> DataFrame:
    """Flat little-endian float32 grids (`*.bil`), one file per day, as (event_date, y, x, precip) rows.

    The date is the first run of eight digits in the file name; missing cells become NULL. Files are decoded in tasks,
    one day at a time; those of days before `first` or after `last` (YYYYMMDD) are not read.
    """
    named = _grid_files(spark, path, first, last)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = (a.ravel() for a in np.indices((height, width), dtype=np.int32))
        for batch in batches:
            for day, content in zip(batch["day"], batch["content"]):
                values = np.frombuffer(content, dtype="<f4")
                if values.size != height * width:
                    raise ValueError(f"grid {day} holds {values.size} cells, expected {height * width}")
                yield pd.DataFrame({"day": day, "y": y, "x": x, "precip": values})

    rows = named.mapInPandas(cells, GRID_CELL)
    wet = F.when((F.col("precip") != PRECIP_NODATA) & ~F.isnan("precip"), F.col("precip"))
    return rows.select(F.to_date("day", "yyyyMMdd").alias("event_date"), "y", "x", wet.alias("precip"))


def date_gaps(days: DataFrame, start: str = CUBE_START) -> DataFrame:
    """Days that break the run start, start + 1, ... (empty when contiguous). One row per day, at most some thousands."""
    order = Window.orderBy("event_date")
    numbered = days.select("event_date").withColumn("_i", F.row_number().over(order) - 1)
    return numbered.where(F.col("event_date") != F.date_add(F.lit(start).cast("date"), F.col("_i"))).select("event_date")


def build_cube(grids: DataFrame, start: str = CUBE_START, days: DataFrame | None = None) -> DataFrame:
    """(t, y, x, precip, month) rows; an error names the first day that breaks the run or comes twice.

    `days` (event_date, one row per grid) is what is checked, from `grid_days` where grids are files; without it one cell of
    every day of `grids` is. A single date reaches the driver.
    """
    days = grids.where((F.col("y") == 0) & (F.col("x") == 0)) if days is None else days
    gap = date_gaps(days, start).agg(F.min("event_date")).first()[0]
    if gap is not None:
        raise ValueError(f"Dates are not contiguous at {gap}")
    return grids.select(date_to_index(F.col("event_date"), start).alias("t"), "y", "x", "precip",
                        F.date_format("event_date", "yyyy-MM").alias("month"))


def cube_of_files(spark: SparkSession, path: str, height: int, width: int, start: str = CUBE_START, last: str | None = None) -> DataFrame:
    """The cube of a folder of grids from `start` (up to `last`, YYYYMMDD): contiguity is checked on the names and each file
    decoded once, when the cube is read."""
    first = start.replace("-", "")
    return build_cube(read_daily_grids(spark, path, height, width, first, last), start, grid_days(spark, path, first, last))


def write_cube(cube: DataFrame, path: str) -> None:
    """Partitioned by month and sorted by cell, so day ranges prune folders and cells prune row groups."""
    (cube.repartition("month").sortWithinPartitions("month", "y", "x", "t")
     .write.mode("overwrite").partitionBy("month").parquet(path))


def read_raw_tiles(spark: SparkSession, path: str, dtype: str = "<f4") -> DataFrame:
    """Flat raster files `<channel>_<tile_id>_<h>x<w>.bin` as tile rows."""
    pattern = r"^(\w+)_(\d+)_(\d+)x(\d+)\.bin$"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.where(name.rlike(pattern)).select(
        F.regexp_extract(name, pattern, 2).cast("bigint").alias("tile_id"), F.regexp_extract(name, pattern, 1).alias("channel"),
        F.regexp_extract(name, pattern, 3).cast("int").alias("h"), F.regexp_extract(name, pattern, 4).cast("int").alias("w"),
        "content")

    @F.pandas_udf("array<float>")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda b: np.frombuffer(b, dtype=dtype).astype("float32"))
    return parts.withColumn("data", decoded("content")).drop("content")
