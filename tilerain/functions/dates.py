"""Date, interval, event-id and grid-cell columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilerain.schema import CUBE_START

EPOCH = "1970-01-01 00:00:00"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch without any time-zone conversion."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def parse_date(text: Column) -> Column:
    """`YYYY-MM-DD`, then `YYYYMMDD`, else NULL."""
    dashed = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))
    packed = F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    return F.coalesce(dashed, packed)


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def date_interval(day: Column, before: int, after: int) -> Column:
    """`start/end`; a single date when nothing is added on either side."""
    if before + after == 0:
        return iso(day)
    return F.concat_ws("/", iso(F.date_sub(day, before)), iso(F.date_add(day, after)))


def interval_to_latest(day: Column, latest: Column, days_after: int) -> Column:
    return F.concat_ws("/", iso(day), iso(F.date_add(latest, days_after)))


def interval_between(start: Column, end: Column) -> Column:
    return F.concat_ws("/", iso(start), iso(end))


def radar_days_after(after: int, hours: float) -> int:
    """The radar search window reaches ceil(hours / 24) days further than the optical one."""
    return after + int(-(-hours // 24))


def rain_day_start(day: Column, hour: int = 12) -> Column:
    """A rain day begins at noon UTC of the previous day; `hour=0` gives the scoring variant."""
    return F.date_sub(day, 1).cast("timestamp_ntz") + F.make_interval(hours=F.lit(hour))


def index_to_date(t: Column, start: str = CUBE_START) -> Column:
    return F.date_add(F.lit(start).cast("date"), t)


def date_to_index(day: Column, start: str = CUBE_START) -> Column:
    return F.date_diff(day, F.lit(start).cast("date"))


def event_id(day: Column, y: Column, x: Column) -> Column:
    return F.concat_ws("_", F.date_format(day, "yyyyMMdd"), y.cast("string"), x.cast("string"))


EVENT_ID = r"^(\d{8})_(\d+)_(\d+)$"


def event_id_part(eid: Column, part: str) -> Column:
    group = {"date": 1, "y": 2, "x": 3}[part]
    text = F.when(eid.rlike(EVENT_ID), F.regexp_extract(eid, EVENT_ID, group))
    return F.to_date(text, "yyyyMMdd") if part == "date" else text.cast("int")


def cell_bbox(y: Column, x: Column, geotransform: tuple[float, ...]) -> Column:
    """Bounds of a grid cell; geotransform = (ulx, sx, 0, uly, 0, sy) with sy negative for north-up grids."""
    ulx, sx, _, uly, _, sy = (float(v) for v in geotransform)
    return F.struct(
        (x * sx + ulx).alias("minx"), ((y + 1) * sy + uly).alias("miny"),
        ((x + 1) * sx + ulx).alias("maxx"), (y * sy + uly).alias("maxy"))


def buffered_bounds(minx: Column, miny: Column, maxx: Column, maxy: Column, share: float = 0.2) -> Column:
    """Bounds widened by `share` of the extent on each side; use over min/max aggregates for a total bound."""
    dx, dy = (maxx - minx) * share, (maxy - miny) * share
    return F.struct((minx - dx).alias("minx"), (miny - dy).alias("miny"),
                    (maxx + dx).alias("maxx"), (maxy + dy).alias("maxy"))


def clamped_year(year: Column, first: Column | int, last: Column | int) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(year, lift(first)), lift(last))


ELEVATION_NAME = r"n(\d+)w(\d+)\.tif$"


def elevation_bounds(name: Column) -> Column:
    """One-degree tile named by its top-left corner, `n<lat>w<lon>.tif`; NULL for other names."""
    lat = F.regexp_extract(name, ELEVATION_NAME, 1).cast("double")
    lon = F.regexp_extract(name, ELEVATION_NAME, 2).cast("double")
    box = F.struct((-lon).alias("minx"), (lat - 1).alias("miny"), (1 - lon).alias("maxx"), lat.alias("maxy"))
    return F.when(name.rlike(ELEVATION_NAME), box)


def is_epsg(code: Column) -> Column:
    return code.rlike(r"^EPSG:\d+$")
