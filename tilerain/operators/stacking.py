"""Label choice, split joins and channel stacks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilerain.functions.bands import pair_shift
from tilerain.operators.ranking import exact_medians
from tilerain.schema import S2_CHANNELS, SAR_CHANNELS


def selected_channels(mask: str, sensor: str = "s2") -> list[str]:
    """Channel names of a '0'/'1' mask."""
    names = S2_CHANNELS if sensor == "s2" else SAR_CHANNELS
    if len(mask) != len(names) or set(mask) - {"0", "1"}:
        raise ValueError(f"channel mask must be {len(names)} characters of 0 and 1, got {mask!r}")
    return [name for name, flag in zip(names, mask) if flag == "1"]


def channel_index(mask: str, sensor: str = "s2") -> dict[str, int]:
    return {name: i for i, name in enumerate(selected_channels(mask, sensor))}


def select_channels(df: DataFrame, mask: str, sensor: str = "s2", keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    return df.select(*keys, *selected_channels(mask, sensor))


def first_per_key(rows: DataFrame, keys: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """First row per key in `rank` order. `min_by` reduces map-side, so a hot key costs no more than others."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("_f")).select(*keys, "_f.*")


def chosen_labels(captures: DataFrame, labels: DataFrame) -> DataFrame:
    """Manual label (first directory) before machine label; captures with neither drop out."""
    key = ["img_date", "eid"]
    rank = F.struct(F.when(F.col("source") == "manual", 0).otherwise(1).alias("s"), F.col("dir_rank").alias("d"))
    best = labels.groupBy(*key).agg(F.min_by(F.struct("source", "dir_rank", "path"), rank).alias("_l"))
    return captures.join(best, key).select(*captures.columns, F.col("_l.source").alias("label_source"),
                                           F.col("_l.path").alias("label_path"))


def with_split(rows: DataFrame, splits: DataFrame) -> DataFrame:
    return rows.join(splits.select("y", "x", "split"), ["y", "x"])


def stacked(tile_rows: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """One row per tile with a column per channel array, from one row per (tile, channel).

    A single aggregation on the tile replaces a chain of joins; tiles that lack a channel drop out. A tile whose channels
    differ in shape fails.
    """
    picks = [F.max_by("data", F.when(F.col("channel") == c, F.lit(1))).alias(c) for c in channels]
    shape = F.struct("h", "w")
    wide = tile_rows.where(F.col("channel").isin(*channels)).groupBy(*keys).agg(F.min(shape).alias("_low"), F.max(shape).alias("_high"), *picks)
    complete = F.lit(True)
    for c in channels:
        complete = complete & F.col(c).isNotNull()
    text = F.concat(F.lit("channels of different shapes on tile "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    height = F.when(F.col("_low") == F.col("_high"), F.col("_low.h")).otherwise(F.raise_error(text).cast("int"))
    return wide.where(complete).select(*keys, height.alias("h"), F.col("_low.w").alias("w"), *channels)


def exploded(tiles: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Pixel rows (keys, r, c, one column per channel) of stacked tile rows; narrow."""
    zipped = F.posexplode(F.arrays_zip(*[F.col(c) for c in channels])).alias("pos", "_px")
    return tiles.select(*keys, "w", zipped).select(
        *keys, F.floor(F.col("pos") / F.col("w")).cast("int").alias("r"), (F.col("pos") % F.col("w")).cast("int").alias("c"),
        *[F.col(f"_px.{c}").alias(c) for c in channels])


def collected(pixels: DataFrame, value: str, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Back to one row-major array per tile. A tile with a pixel missing or there twice fails: it would shift all after it."""
    ordered = F.array_sort(F.collect_list(F.struct("r", "c", F.col(value).alias("v"))))
    tiles = pixels.groupBy(*keys).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), F.count_distinct("r", "c").alias("_n"), ordered.alias("_px"))
    whole = (F.col("_n") == F.col("h") * F.col("w")) & (F.size("_px") == F.col("_n"))
    text = F.concat(F.lit("not one value for each pixel of tile "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    values = F.when(whole, F.transform("_px", lambda s: s["v"])).otherwise(F.raise_error(text).cast(f"array<{pixels.schema[value].dataType.simpleString()}>"))
    return tiles.select(*keys, "h", "w", values.alias(value))


def polarization_pairs(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Captures with a VV and a VH file of the same shape; one aggregate instead of a self-join."""
    def of(pol: str, column: str) -> Column:
        return F.max(F.when(F.col("polarization") == pol, F.col(column)))
    wide = files.groupBy(*keys).agg(*[of(p, c).alias(f"{p}_{c}") for p in ("vv", "vh") for c in ("h", "w")])
    return wide.where((F.col("vv_h") == F.col("vh_h")) & (F.col("vv_w") == F.col("vh_w"))).select(
        *keys, F.col("vv_h").alias("h"), F.col("vv_w").alias("w"))


def union_once(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of several sample folders, earlier folders first; later copies of a key drop out."""
    all_rows = None
    for rank, part in enumerate(parts):
        ranked = part.withColumn("dir_rank", F.lit(rank))
        all_rows = ranked if all_rows is None else all_rows.unionByName(ranked)
    return first_per_key(all_rows, keys, ["dir_rank"])


def missing_files(files: DataFrame, patterns: dict[str, str], events: DataFrame | None = None) -> DataFrame:
    """Per event the required file kinds without a non-empty file; `complete` when none is missing.

    With `events` (distinct eid) exactly those are reported; one without any file lacks every kind. One boolean per pattern
    in a single aggregate, patterns anchored at the start of the name.
    """
    found = {kind: F.bool_or(F.col("name").rlike("^" + rx) & (F.col("size_bytes") > 0)).alias(f"_{i}")
             for i, (kind, rx) in enumerate(patterns.items())}
    rows = files.groupBy("eid").agg(*found.values())
    if events is not None:
        rows = events.select("eid").join(rows, "eid", "left")
    absent = F.array_compact(F.array(*[F.when(~F.coalesce(f"_{i}", F.lit(False)), F.lit(kind)) for i, kind in enumerate(patterns)]))
    return rows.select("eid", absent.alias("missing")).withColumn("complete", F.size("missing") == 0)


# ---- fixed values: files of a complete paired event ----
EVENT_FILES = {
    "DEM": r"dem_.*\.tif", "FLOWLINES": r"flowlines_.*\.tif", "ROADS": r"roads_.*\.tif",
    "WATERBODY": r"waterbody_.*\.tif", "NLCD": r"nlcd_.*\.tif", "S2 IMAGERY": r"tci_\d{8}.*\.tif",
    "RGB": r"rgb_\d{8}.*\.tif", "NDWI": r"ndwi_\d{8}.*\.tif", "B8 NIR": r"b08_\d{8}.*\.tif",
    "SWIR1": r"b11_\d{8}.*\.tif", "SWIR2": r"b12_\d{8}.*\.tif", "SAR": r"sar_\d{8}.*\.tif",
    "SCL": r"scl_\d{8}.*\.tif", "METADATA": r"metadata.json",
}


def inconsistent_rasters(rasters: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Per event the first file (by name) whose shape, CRS or transform differs from the event's first file.

    `transform` is an array of six doubles. Files fold map-side to one row per distinct layout of an event before anything
    is compared, so an event with very many files costs no more than its few layouts. Consistent events have
    `mismatched_file` NULL. A file without a CRS differs from one that has it.
    """
    layouts = rasters.groupBy("eid", "h", "w", "crs", "transform").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))
    reference = layouts.groupBy("eid").agg(F.min_by(F.struct("h", "w", "crs", "transform"), "name").alias("_ref"),
                                           F.sum("n").alias("total_files"))
    off = F.exists(F.arrays_zip(F.col("transform").alias("a"), F.col("_ref.transform").alias("b")),
                   lambda s: F.abs(s["a"] - s["b"]) >= tolerance)
    reason = (F.when((F.col("h") != F.col("_ref.h")) | (F.col("w") != F.col("_ref.w")), "shape")
              .when(~F.col("crs").eqNullSafe(F.col("_ref.crs")), "crs").when(off, "transform"))
    judged = layouts.join(reference, "eid").withColumn("_reason", reason)
    bad = F.col("_reason").isNotNull()
    return judged.groupBy("eid").agg(
        F.max("total_files").alias("total_files"), F.min(F.when(bad, F.col("name"))).alias("mismatched_file"),
        F.min_by(F.when(bad, F.col("_reason")), F.when(bad, F.col("name"))).alias("reason"),
        (~F.bool_or(bad)).alias("is_valid"))


def median_shift(points: DataFrame, tile: Sequence[str]) -> DataFrame:
    """Median control-point offset per tile in whole pixels, halves to even."""
    offsets = points.select(*tile, *[pair_shift(F.col(f"map{axis}"), F.col(f"source{axis}")).alias(f"shift_{axis.lower()}") for axis in "XY"])
    middle = exact_medians(offsets, tile, ["shift_x", "shift_y"])
    return middle.select(*tile, *[F.rint(c).cast("int").alias(c) for c in ("shift_x", "shift_y")])


def labeled_events(paths: DataFrame) -> DataFrame:
    """Distinct event ids of label file names, with the first folder holding each."""
    eid = F.regexp_extract("path", r"label_\d{8}_(\d{8}_\d+_\d+)\.tif$", 1)
    return (paths.withColumn("eid", eid).where(F.col("eid") != "").groupBy("eid")
            .agg(F.min_by("dir", "dir_rank").alias("dir")))
