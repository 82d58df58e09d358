"""Rain events from the daily precipitation table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilerain.functions.dates import cell_bbox, date_to_index, event_id, index_to_date
from tilerain.functions.keys import random_key
from tilerain.schema import CUBE_START

CELL_KEY = ["t", "y", "x"]


def describe_events(cells: DataFrame, geotransform: tuple[float, ...], start: str = CUBE_START) -> DataFrame:
    """Adds the event date, id and bounds to (t, y, x, precip) rows."""
    day = index_to_date(F.col("t"), start)
    return cells.select(
        event_id(day, F.col("y"), F.col("x")).alias("eid"), day.alias("event_date"), *CELL_KEY, "precip",
        cell_bbox(F.col("y"), F.col("x"), geotransform).alias("bbox"))


def without_history(cells: DataFrame, history: DataFrame) -> DataFrame:
    return cells.join(history.select(*CELL_KEY), CELL_KEY, "left_anti")


def extreme_events(cells: DataFrame, threshold: float, history: DataFrame | None = None, region: DataFrame | None = None,
                   first_day: int = 0, limit: int | None = None) -> DataFrame:
    """Cell-days strictly above the threshold; the first `limit` in (t, y, x) order are taken after the exclusions."""
    hits = cells.where((F.col("precip") > threshold) & (F.col("t") >= first_day))
    if region is not None:
        hits = hits.join(region.select("y", "x"), ["y", "x"], "left_semi")
    if history is not None:
        hits = without_history(hits, history)
    return hits if limit is None else hits.orderBy(*CELL_KEY).limit(limit)


def manual_events(listed: DataFrame, cells: DataFrame, history: DataFrame | None = None,
                  start: str = CUBE_START) -> DataFrame:
    """Listed (event_date, y, x, crs) rows with their rain; days before the cube get 0."""
    wanted = listed.select(date_to_index(F.col("event_date"), start).alias("t"), "y", "x", "crs")
    if history is not None:
        wanted = without_history(wanted, history)
    rain = cells.select(*CELL_KEY, F.col("precip").cast("double").alias("_p"))
    return wanted.join(rain, CELL_KEY, "left").select(
        *CELL_KEY, F.when(F.col("t") < 0, F.lit(0.0)).otherwise(F.col("_p")).alias("precip"), "crs")


def valid_cells(cells: DataFrame) -> DataFrame:
    """Cells with a value on the first day."""
    return cells.where((F.col("t") == 0) & F.col("precip").isNotNull()).select("y", "x")


def random_events(pool: DataFrame, cells: DataFrame, days: int, n: int, seed: int, history: DataFrame | None = None,
                  kind: str = "hash", cell_number: Column | None = None) -> DataFrame:
    """One random day for each cell of `pool`, cells in random order, history excluded, first n kept."""
    columns = [cell_number] if cell_number is not None else [F.col("y"), F.col("x")]
    drawn = pool.select(
        "y", "x", random_key(columns, seed, kind).alias("_key"),
        F.pmod(random_key(columns, seed + 1, kind), F.lit(days)).cast("int").alias("t"))
    if history is not None:
        drawn = without_history(drawn, history)
    chosen = drawn.orderBy("_key", "y", "x").limit(n)
    return chosen.join(cells.select(*CELL_KEY, "precip"), CELL_KEY, "left").select(*CELL_KEY, "precip")


def dry_interval_starts(cells: DataFrame, length: int, threshold: float | None, lead: int = 0) -> DataFrame:
    """Start days whose interval (and `lead` days before it) stays below the threshold in every cell-day.

    Missing rain and absent days count as dry; a cell's series ends with its last day. Without a threshold the last start is excluded, as in the original sampler.
    One window group is one cell's day series.
    """
    if length <= 0:
        raise ValueError("length must be positive")
    if lead < 0:
        raise ValueError("lead must not be negative")
    series = Window.partitionBy("y", "x")
    span = F.max("t").over(series) + 1
    if threshold is None:
        return cells.withColumn("_n", span).where(F.col("t") < F.col("_n") - length).select("y", "x", "t")
    bad = F.when(F.col("precip") >= threshold, 1).otherwise(0)
    frame = series.orderBy("t").rangeBetween(-lead, length - 1)
    return (cells.withColumn("_n", span).withColumn("_bad", F.sum(bad).over(frame))
            .where((F.col("_bad") == 0) & (F.col("t") <= F.col("_n") - length)).select("y", "x", "t"))


def sampled_intervals(starts: DataFrame, scenes: DataFrame, length: int, acquisitions: int, max_missing: float,
                      target: int, max_tries: int, seed: int, start: str = CUBE_START, kind: str = "hash") -> DataFrame:
    """Random intervals per cell with a random usable orbit each, until `target` stacks or `max_tries` failures.

    Intervals are tried in random order; one succeeds when an orbit has enough days with little missing data. Each try is
    a success or a failure, so only the first target + max_tries - 1 intervals of a cell can matter.
    """
    from tilerain.operators.scenes import best_per_orbit_date, by_orbit
    cell = Window.partitionBy("y", "x")
    number = F.col("y") * 10000 + F.col("x")
    key = random_key([F.col("t")] if kind == "mix" else [number, F.col("t")], seed, kind)
    tries = (starts.withColumn("_key", key)
             .withColumn("turn", F.row_number().over(cell.orderBy("_key", "t"))).drop("_key")
             .where(F.col("turn") <= target + max_tries - 1))
    first = index_to_date(F.col("t"), start)
    daily = tries.withColumn("_day", F.explode(F.sequence(first, F.date_add(first, length))))
    inside = by_orbit(scenes).withColumn("_day", F.col("dt").cast("date")).join(daily, ["y", "x", "_day"]).drop("_day")
    usable = (best_per_orbit_date(inside, ["y", "x", "t", "turn"], max_missing)
              .groupBy("y", "x", "t", "turn", "orbit").agg(F.count(F.lit(1)).alias("days"))
              .where(F.col("days") >= acquisitions))
    coin = random_key([F.col("t") * 2 + (F.col("orbit") == "ascending").cast("int")] if kind == "mix"
                      else [number, F.col("t"), F.col("orbit")], seed + 1, kind)
    picked = usable.groupBy("y", "x", "t", "turn").agg(F.min_by("orbit", F.struct(coin, "orbit")).alias("orbit"))
    judged = tries.join(picked, ["y", "x", "t", "turn"], "left")
    before = cell.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("orbit").isNotNull()
    counted = judged.withColumn("_won", F.coalesce(F.sum(won.cast("int")).over(before), F.lit(0))).withColumn(
        "_lost", F.coalesce(F.sum((~won).cast("int")).over(before), F.lit(0)))
    return counted.where(won & (F.col("_won") < target) & (F.col("_lost") < max_tries)).select("y", "x", "t", "orbit")
