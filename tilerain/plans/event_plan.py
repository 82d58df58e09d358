"""Event sampling as one DAG: rain events -> catalog search -> pairing -> cover filter -> scene choice -> radar match."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilerain.operators.events import describe_events, extreme_events
from tilerain.operators.pairing import mutual_pairs, nearest
from tilerain.operators.scenes import below_cover, event_crs, primary_per_date, search_events
from tilerain.session import cut

def select_event_scenes(cells: DataFrame, scenes: DataFrame, history: DataFrame | None, threshold: float, before: int,
                        after: int, hours: float, max_cover: float, geotransform: tuple[float, ...],
                        start: str) -> DataFrame:
    """One row per optical date of each event that has any radar scene, with the radar scene of that date or none.

    `scenes` is a catalog (`schema.SCENE`) with the measured cover_pct and missing_pct. One box join finds the scenes of both
    sensors; the cheap time pairing runs before any cover test. Tables that several branches read (events, found scenes,
    chosen scenes) hold the few columns needed from there on and are written once. Radar scenes are organized under the
    date of the optical scene they are closest to, and one is chosen per date with the same CRS preference.
    """
    events = cut(describe_events(extreme_events(cells, threshold, history), geotransform, start))
    found = cut(search_events(events.select("eid", "event_date", "bbox"), scenes, before, after, hours)
                .select("eid", "sensor", "item_id", "dt", "crs", "ord", "cover_pct", "missing_pct"))
    optical, radar = (found.where(F.col("sensor") == sensor).drop("sensor") for sensor in ("s2", "s1"))
    optical, radar = mutual_pairs(optical, radar, ["eid"], hours)
    clear = cut(below_cover(optical, max_cover))
    main = event_crs(clear).withColumnRenamed("crs", "main_crs")
    chosen = cut(primary_per_date(clear.join(main, "eid"), ["eid", "main_crs"], F.col("main_crs")))
    with_crs = radar.join(chosen.select("eid", "main_crs").distinct(), "eid")
    matched = below_cover(nearest(cut(with_crs), chosen, ["eid"], hours), max_cover, "missing_pct")
    dated = matched.withColumn("s1_dt", F.col("dt")).withColumn("dt", F.col("match_dt"))
    radar_choice = primary_per_date(dated, ["eid", "main_crs"], F.col("main_crs"))
    # a window group is the few optical dates of one event
    any_radar = F.count("s1_item").over(Window.partitionBy("eid")) > 0
    return (chosen.select("eid", "scene_date", "main_crs", F.col("item_id").alias("s2_item"))
            .join(radar_choice.select("eid", "scene_date", F.col("item_id").alias("s1_item"), "s1_dt"),
                  ["eid", "scene_date"], "left")
            .withColumn("_any", any_radar).where("_any").drop("_any")
            .join(events.select("eid", "event_date", "precip"), "eid"))
