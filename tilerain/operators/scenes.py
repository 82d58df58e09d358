"""Scene catalog search, filters and per-date choice."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilerain.functions.dates import radar_days_after, rain_day_start
from tilerain.operators.boxes import box_overlap


def property_test(name: str, op: str, value: object) -> Column:
    """A test (`eq`, `gte`, `lte`, ...) of an entry of the `properties` map. It runs on the rows read; a map is not pruned by the scan."""
    held = F.try_element_at(F.col("properties"), F.lit(name))
    if not isinstance(value, str):
        held = held.try_cast("double")
    test = {"eq": held == value, "neq": held != value, "gt": held > value, "gte": held >= value, "lt": held < value, "lte": held <= value}
    if op not in test:
        raise ValueError(f"unknown property operator {op!r}")
    return test[op]


def search(scenes: DataFrame, sensor: str, bbox: tuple[float, float, float, float] | None = None,
           start: str | None = None, end: str | None = None, where: dict[str, tuple[str, object]] | None = None) -> DataFrame:
    """Catalog search by sensor, box, whole-day interval and property tests.

    Sensor, box and interval are tests on plain columns and bbox fields, so they reach the Parquet scan.
    """
    found = scenes.where(F.col("sensor") == sensor)
    if bbox is not None:
        minx, miny, maxx, maxy = bbox
        found = found.where((F.col("bbox.minx") <= maxx) & (F.col("bbox.maxx") >= minx)
                            & (F.col("bbox.miny") <= maxy) & (F.col("bbox.maxy") >= miny))
    if start is not None:
        found = found.where(F.col("dt") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        found = found.where(F.col("dt") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    for name, (op, value) in (where or {}).items():
        found = found.where(property_test(name, op, value))
    return found


#: Days after an event that each sensor is searched for: a function of the days after it and the pairing tolerance in hours.
WINDOW_AFTER = {"s2": lambda after, hours: after, "s1": radar_days_after}
#: Property tests of the event search, by sensor (fixed values of the catalogs).
EVENT_SEARCH = {"s2": {}, "s1": {"sar:instrument_mode": ("eq", "IW")}}


def search_events(events: DataFrame, scenes: DataFrame, before: int, after: int, hours: float = 0.0,
                  where: dict[str, dict[str, tuple[str, object]]] | None = None) -> DataFrame:
    """Scenes whose footprint meets an event's box, from `before` days before to `after` days after it, all days whole.

    Radar scenes are searched for longer, by the whole days that `hours` reach. `where` holds the property tests of each
    sensor searched for (default: both sensors, radar in its wide mode). Events have eid, event_date and bbox, scenes the
    columns of `schema.SCENE`; the result has both, the footprint as `box`. The event's few days are listed, so that the box
    join meets boxes of one sensor and day only, and one join serves both sensors.
    """
    tests = EVENT_SEARCH if where is None else where
    wanted = F.lit(False)
    for sensor, test in tests.items():
        kept = F.col("sensor") == sensor
        for name, (op, value) in test.items():
            kept = kept & property_test(name, op, value)
        wanted = wanted | kept
    windows = F.array(*[F.struct(F.lit(sensor).alias("sensor"), F.sequence(
        F.date_sub("event_date", before), F.date_add("event_date", WINDOW_AFTER[sensor](after, hours))).alias("days")) for sensor in tests])
    days = F.flatten(F.transform(windows, lambda w: F.transform(w["days"], lambda day: F.struct(w["sensor"].alias("sensor"), day.alias("_day")))))
    asked = events.withColumn("_w", F.explode(days)).select("*", "_w.sensor", "_w._day").drop("_w")
    footprints = scenes.where(wanted).withColumn("_day", F.col("dt").cast("date")).withColumnRenamed("bbox", "box")
    return box_overlap(asked, footprints, strict=False, on=["sensor", "_day"]).drop("_day")


# ---- fixed values: asset names by catalog provider ----
ASSET_NAMES = {
    ("mpc", "s2"): {"B02": "B02", "B03": "B03", "B04": "B04", "B08": "B08", "B11": "B11", "B12": "B12", "SCL": "SCL",
                    "visual": "visual"},
    ("mpc", "s1"): {"vv": "vv", "vh": "vh"},
    ("aws", "s2"): {"B02": "blue", "B03": "green", "B04": "red", "B08": "nir", "B11": "swir16", "B12": "swir22",
                    "SCL": "scl", "visual": "visual"},
    ("aws", "s1"): {"vv": "vv", "vh": "vh"},
    ("cdse", "s2"): {"B02": "B02_10m", "B03": "B03_10m", "B04": "B04_10m", "B08": "B08_10m", "B11": "B11_20m",
                     "B12": "B12_20m", "SCL": "SCL_20m", "visual": "TCI_10m"},
    ("cdse", "s1"): {"vv": "vv", "vh": "vh"},
}


def asset_name(provider: Column, sensor: Column, band: Column) -> Column:
    """Catalog-specific asset name of a band; NULL where the provider has none. A literal map needs no join."""
    pairs = []
    for (prov, sens), names in ASSET_NAMES.items():
        for generic, actual in names.items():
            pairs += [F.lit(f"{prov}/{sens}/{generic}"), F.lit(actual)]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws("/", provider, sensor, band))


def item_crs(item: Column, asset_crs: Column) -> Column:
    """The item's own projection, else the first one among its assets (array in asset order)."""
    return F.coalesce(item, F.try_element_at(F.filter(asset_crs, lambda c: c.isNotNull()), F.lit(1)))


def below_cover(scenes: DataFrame, limit: float, cover: str = "cover_pct") -> DataFrame:
    """Rejects cover strictly above the limit."""
    return scenes.where(~(F.col(cover) > limit))


def class_rich(scenes: DataFrame, max_null: float, min_class: float) -> DataFrame:
    return scenes.where((F.col("null_pct") <= max_null) & (F.col("class_pct") >= min_class))


def events_with_scene_after(scenes: DataFrame, max_cover: float) -> DataFrame:
    """Event ids with a scene on or after the rain day's start, before and after the cover filter.

    The second test sees dates cut to midnight, so a scene late on the previous day passes only the first one.
    """
    begin = rain_day_start(F.col("event_date"))
    raw = F.col("dt").cast("timestamp_ntz") >= begin
    cut = F.col("dt").cast("date").cast("timestamp_ntz") >= begin
    kept = ~(F.col("cover_pct") > max_cover)
    return (scenes.groupBy("eid").agg(F.bool_or(raw).alias("_any"), F.bool_or(cut & kept).alias("_kept"))
            .where(F.col("_any") & F.col("_kept")).select("eid"))


def post_event_only(scenes: DataFrame) -> DataFrame:
    """Scoring looks at images from the previous day's midnight on."""
    return scenes.where(F.col("dt").cast("timestamp_ntz") >= rain_day_start(F.col("event_date"), hour=0))


def id_has_any(wanted: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in wanted]), lambda w: F.contains(F.col("item_id"), w))


def id_contains_any(scenes: DataFrame, wanted: list[str]) -> DataFrame:
    return scenes.where(id_has_any(wanted))


def dual_polarized(scenes: DataFrame, assets: tuple[str, ...] = ("vv", "vh")) -> DataFrame:
    """Needs both polarizations listed and the measurement assets present."""
    both = F.array_contains("polarizations", "VV") & F.array_contains("polarizations", "VH")
    for name in assets:
        both = both & F.map_contains_key("assets", F.lit(name))
    return scenes.where(both)


def primary_per_date(scenes: DataFrame, keys: list[str], preferred: Column | None = None) -> DataFrame:
    """One scene per (keys, UTC day): preferred CRS first, then alphabetical CRS, then insertion order.

    `min_by` combines map-side, so a hot event is reduced before the shuffle.
    """
    want = F.coalesce(F.col("crs") == preferred, F.lit(False)) if preferred is not None else F.lit(False)
    rank = F.struct(F.when(want, 0).otherwise(1).alias("p"), F.col("crs").alias("crs"), F.col("ord").alias("o"))
    rest = [c for c in scenes.columns if c not in keys]
    return (scenes.groupBy(*keys, F.col("dt").cast("date").alias("scene_date"))
            .agg(F.min_by(F.struct(*rest), rank).alias("_s")).select(*keys, "scene_date", "_s.*"))


def event_crs(scenes: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """The listed CRS of an event, else the alphabetically first one among its scenes."""
    first = scenes.groupBy("eid").agg(F.min("crs").alias("_first"))
    if manual is None:
        return first.select("eid", F.col("_first").alias("crs"))
    listed = manual.select("eid", F.col("crs").alias("_listed"))
    return first.join(listed, "eid", "left").select("eid", F.coalesce("_listed", "_first").alias("crs"))


def by_orbit(scenes: DataFrame, orbit: str = "orbit") -> DataFrame:
    """Lower-cased pass direction; rows of any other state are dropped."""
    state = F.lower(F.col(orbit))
    return scenes.where(state.isin("ascending", "descending")).withColumn(orbit, state)


def best_per_orbit_date(scenes: DataFrame, keys: list[str], max_missing: float, first_n: int | None = None,
                        require_n: bool = False) -> DataFrame:
    """Least missing scene per (keys, orbit, day), tie to the earlier `ord`; then the first n days of each orbit."""
    rest = [c for c in scenes.columns if c not in [*keys, "orbit"]]
    best = (scenes.groupBy(*keys, "orbit", F.col("dt").cast("date").alias("scene_date"))
            .agg(F.min_by(F.struct(*rest), F.struct("missing_pct", "ord")).alias("_s"))
            .select(*keys, "orbit", "scene_date", "_s.*").where(F.col("missing_pct") <= max_missing))
    if first_n is None:
        return best
    group = Window.partitionBy(*keys, "orbit")
    numbered = best.withColumn("acq_idx", F.row_number().over(group.orderBy("dt", "ord")) - 1)
    if require_n:
        numbered = numbered.withColumn("_n", F.count(F.lit(1)).over(group)).where(F.col("_n") >= first_n).drop("_n")
    return numbered.where(F.col("acq_idx") < first_n)


def best_per_date(scenes: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in scenes.columns if c not in keys]
    return (scenes.groupBy(*keys, F.col("dt").cast("date").alias("scene_date"))
            .agg(F.min_by(F.struct(*rest), F.struct("missing_pct", "ord")).alias("_s"))
            .select(*keys, "scene_date", "_s.*"))


def date_and_crs_lists(scenes: DataFrame, keys: list[str]) -> DataFrame:
    return scenes.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.col("dt").cast("date"))).alias("dates"),
        F.sort_array(F.collect_set("crs")).alias("crs_list"))


def widened(box: Column, by: float) -> Column:
    return F.struct((box.minx - by).alias("minx"), (box.miny - by).alias("miny"),
                    (box.maxx + by).alias("maxx"), (box.maxy + by).alias("maxy"))


def elevation_tiles(events: DataFrame, tiles: DataFrame, buffer: float = 0.02) -> DataFrame:
    """Elevation tiles of each event; an event that needs one and has none comes back with `error` set."""
    wide = events.withColumn("bbox", widened(F.col("bbox"), buffer))
    pairs = box_overlap(wide.select("eid", "bbox"), tiles.select("name", "box")).groupBy("eid").agg(
        F.sort_array(F.collect_list("name")).alias("names"))
    return events.select("eid").join(pairs, "eid", "left").select(
        "eid", F.coalesce("names", F.array().cast("array<string>")).alias("names"),
        F.when(F.col("names").isNull(), F.lit("no elevation tile")).alias("error"))


def state_of_box(events: DataFrame, states: DataFrame) -> DataFrame:
    """State holding the first matching corner, corners tried lower-left, lower-right, upper-left, upper-right.

    `states` has (state, ord, box); where boxes of states overlap the lower `ord` wins.
    """
    b = F.col("bbox")
    corners = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("px"), y.alias("py")) for i, (x, y) in enumerate(
        [(b.minx, b.miny), (b.maxx, b.miny), (b.minx, b.maxy), (b.maxx, b.maxy)])])
    points = events.select("eid", F.explode(corners).alias("c")).select(
        "eid", F.col("c.i").alias("corner"),
        F.struct(F.col("c.px").alias("minx"), F.col("c.py").alias("miny"),
                 F.col("c.px").alias("maxx"), F.col("c.py").alias("maxy")).alias("bbox"))
    hits = box_overlap(points, states, strict=False)
    found = hits.groupBy("eid").agg(F.min_by("state", F.struct("corner", "ord")).alias("state"))
    return events.select("eid").join(found, "eid", "left")
