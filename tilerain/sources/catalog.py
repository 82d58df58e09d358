"""File-name catalogs and event metadata."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilerain.schema import EVENT_METADATA

# ---- fixed values: file-name patterns ----
SAR_FILE = r"^(sar|enhanced_lee|cvae)_(\d{8})_(\d{8})_(\d{8}_\d+_\d+)_(vv|vh)\.tif$"
OPTICAL_FILE = r"^(tci|rgb|b08|b11|b12|ndwi|scl|label|pred)_(\d{8})_(\d{8}_\d+_\d+)\.tif$"
LAYER_FILE = r"^(dem|roads|flowlines|waterbody|nlcd)_(\d{8}_\d+_\d+)\.tif$"
STACK_FILE = r"^multi_(\d{8})-(\d{8})_(\d+)_(\d+)_(vv|vh)\.tif$"
CELL_DIR = r"(\d+)_(\d+)$"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size_bytes) without reading content. Empty files are not listed, so they count as absent."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"))


def _part(name: Column, pattern: str, group: int) -> Column:
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, group))


def named_files(files: DataFrame, name: str = "name") -> DataFrame:
    """Adds kind, img_date, s1_date, eid, polarization from the file name; unknown names get NULL kind."""
    n = F.col(name)
    sar = lambda g: _part(n, SAR_FILE, g)
    opt = lambda g: _part(n, OPTICAL_FILE, g)
    lay = lambda g: _part(n, LAYER_FILE, g)
    return files.withColumns({
        "kind": F.coalesce(sar(1), opt(1), lay(1)), "img_date": F.coalesce(sar(2), opt(2)), "s1_date": sar(3),
        "eid": F.coalesce(sar(4), opt(3), lay(2)), "polarization": sar(5)})


def named_stacks(files: DataFrame, name: str = "name") -> DataFrame:
    """Interval, cell and polarization of multitemporal stack files; other names drop out."""
    n = F.col(name)
    return files.where(n.rlike(STACK_FILE)).withColumns({
        "start_date": _part(n, STACK_FILE, 1), "end_date": _part(n, STACK_FILE, 2),
        "y": _part(n, STACK_FILE, 3).cast("int"), "x": _part(n, STACK_FILE, 4).cast("int"),
        "polarization": _part(n, STACK_FILE, 5)})


def cell_of_dir(path: Column) -> Column:
    """(y, x) of a `y_x` folder name, NULL for other folders."""
    cell = F.struct(F.regexp_extract(path, "(?:^|/)" + CELL_DIR, 1).cast("int").alias("y"),
                    F.regexp_extract(path, "(?:^|/)" + CELL_DIR, 2).cast("int").alias("x"))
    return F.when(path.rlike("(?:^|/)" + CELL_DIR), cell)


def flat_metadata(raw: DataFrame) -> DataFrame:
    """Event metadata from either layout, wrapped in `metadata` or flat; dates dashed or packed."""
    both = lambda name: F.coalesce(F.col(f"metadata.`{name}`"), F.col(f"`{name}`"))
    from tilerain.functions.dates import parse_date
    return raw.select(both("Sample ID").alias("eid"), parse_date(both("Precipitation Event Date")).alias("event_date"),
                      both("CRS").alias("crs"), both("State").alias("state"), both("Bounding Box").alias("bbox"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return flat_metadata(spark.read.json(path, schema=EVENT_METADATA, multiLine=True))


def parse_metadata(json_rows: DataFrame, column: str = "json") -> DataFrame:
    return flat_metadata(json_rows.select(F.from_json(column, EVENT_METADATA).alias("j")).select("j.*"))


def products_by_date(chosen: DataFrame) -> DataFrame:
    """Date -> product maps per event and sensor, as they appear in the event metadata. One entry per date."""
    entry = F.struct(F.date_format("scene_date", "yyyy-MM-dd").alias("key"), F.col("item_id").cast("string").alias("value"))
    per = lambda s: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("sensor") == s, entry))))
    return chosen.groupBy("eid").agg(per("s2").alias("s2_products"), per("s1").alias("s1_products"))


def metadata_json(events: DataFrame, products: DataFrame, parameters: dict[str, object]) -> DataFrame:
    """(eid, json) with the event's ids, maps and sampling parameters."""
    body = F.struct(
        F.col("eid").alias("Sample ID"), F.date_format("event_date", "yyyy-MM-dd").alias("Precipitation Event Date"),
        F.col("precip").alias("Cumulative Daily Precipitation (mm)"), F.col("crs").alias("CRS"),
        F.col("state").alias("State"), F.col("bbox").alias("Bounding Box"), F.col("s2_products").alias("S2 Products"),
        F.col("s1_products").alias("S1 Products"), *[F.lit(v).alias(k) for k, v in parameters.items()])
    return events.join(products, "eid").select("eid", F.to_json(body).alias("json"))


def write_metadata(rows: DataFrame, path: str) -> None:
    rows.select("json").write.mode("append").text(path)
