"""Scene choice for areas of interest."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilerain.functions.dates import buffered_bounds, clamped_year
from tilerain.operators.boxes import box_overlap
from tilerain.operators.scenes import best_per_date, id_has_any


def select_area_scenes(areas: DataFrame, scenes: DataFrame, s2_ids: list[str] | None = None,
                       s1_ids: list[str] | None = None, buffer: float = 0.2,
                       class_years: tuple[int, int] = (1985, 2023)) -> DataFrame:
    """Best scene per date and sensor of each area, with the area's CRS and land-cover year.

    `areas` has one row per geometry part (area_id, minx..maxy, start_date, end_date, crs or NULL). The search box is the
    total bound widened on each side; the CRS is the given one, or that of the earliest chosen optical scene, or without
    any that of the earliest radar scene. `s2_ids` and `s1_ids` list parts of wanted product ids of each sensor; a missing
    or empty list takes all.
    """
    total = areas.groupBy("area_id", "start_date", "end_date", "crs").agg(
        buffered_bounds(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy"), buffer).alias("bbox"))
    catalog = scenes
    for sensor, ids in (("s2", s2_ids), ("s1", s1_ids)):
        if ids:
            catalog = catalog.where((F.col("sensor") != sensor) | id_has_any(ids))
    boxed = catalog.withColumnRenamed("bbox", "box").withColumnRenamed("crs", "scene_crs")
    day = F.col("dt").cast("date")
    found = box_overlap(total, boxed, strict=False).where((day >= F.col("start_date")) & (day <= F.col("end_date")))
    best = best_per_date(found.select("area_id", "sensor", "start_date", "crs", "scene_crs", "item_id", "dt", "missing_pct", "ord"),
                         ["area_id", "sensor"])
    first = best.groupBy("area_id").agg(F.min_by("scene_crs", F.struct(F.col("sensor") != "s2", "dt", "ord")).alias("_first"))
    return best.join(first, "area_id").select(
        "area_id", "sensor", "scene_date", "item_id", F.coalesce("crs", "_first").alias("crs"),
        clamped_year(F.year("start_date"), *class_years).alias("class_year"))
