"""Pairing two sensors in time without emitting candidate pairs.

Existence within a tolerance: time is cut into buckets as wide as the tolerance, so a partner lies in the same bucket or
a direct neighbor, and all that a neighbor can contribute is its earliest or latest time. The nearest scene: a running
maximum and minimum over the distinct times of a key. Work is linear in the rows and spreads over tasks also when one
event, or one short span of one event, holds most of them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilerain.functions.dates import micros
from tilerain.operators.ranking import Fold, running_folds

HOUR = 3_600_000_000
DAY = 24 * HOUR


def _timed(scenes: DataFrame) -> DataFrame:
    return scenes.withColumn("_us", micros(F.col("dt")))


def _bucketed(scenes: DataFrame, keys: list[str], width: int) -> DataFrame:
    return _timed(scenes).withColumn("_bucket", F.floor(F.col("_us") / F.lit(width)))


def within_hours(left: DataFrame, right: DataFrame, keys: list[str], hours: float) -> DataFrame:
    """Rows of `left` with at least one `right` row of the same keys strictly closer than `hours`."""
    width = int(hours * HOUR)
    edges = (_bucketed(right, keys, width).groupBy(*keys, "_bucket")
             .agg(F.min("_us").alias("lo"), F.max("_us").alias("hi")))
    role = F.explode(F.array(*[
        F.struct((F.col("_bucket") + shift).alias("bucket"), F.lit(shift).alias("shift")) for shift in (-1, 0, 1)]))
    reach = (edges.select(*keys, "lo", "hi", role.alias("s"))
             .groupBy(*keys, F.col("s.bucket").alias("_bucket"))
             .agg(F.max(F.when(F.col("s.shift") == 1, F.col("hi"))).alias("_prev_hi"),
                  F.max(F.when(F.col("s.shift") == 0, F.lit(True))).alias("_same"),
                  F.min(F.when(F.col("s.shift") == -1, F.col("lo"))).alias("_next_lo")))
    near = (F.coalesce(F.col("_same"), F.lit(False))
            | F.coalesce(F.col("_us") - F.col("_prev_hi") < width, F.lit(False))
            | F.coalesce(F.col("_next_lo") - F.col("_us") < width, F.lit(False)))
    return _bucketed(left, keys, width).join(reach, [*keys, "_bucket"]).where(near).select(*left.columns)


def mutual_pairs(optical: DataFrame, radar: DataFrame, keys: list[str], hours: float) -> tuple[DataFrame, DataFrame]:
    """Optical scenes near any radar scene, then radar scenes near a kept optical one."""
    kept = within_hours(optical, radar, keys, hours)
    return kept, within_hours(radar, kept, keys, hours)


def _parts(unit: int, bits: tuple[int, ...]) -> list[tuple[str, Column]]:
    """Nested time spans of unit / 2^bits."""
    return [(f"_w{b}", F.floor(F.col("_us") / F.lit(unit / (1 << b)))) for b in bits]


def nearest(left: DataFrame, right: DataFrame, keys: list[str], hours: float) -> DataFrame:
    """Adds `match_id`, `match_dt`: the closest `right` scene strictly within `hours`; ties go to the lower `ord`.

    `left` rows without a match are dropped. `right` needs item_id, dt and ord. On the time line of a key the last scene
    before and the first one after a question are running extremes, folded over days and parts of a day.
    """
    width = int(hours * HOUR)
    stops = (_timed(right).groupBy(*keys, "_us").agg(F.min(F.struct("ord", "item_id", "dt")).alias("s"))
             .select(*keys, "_us", F.struct("_us", "s.ord", "s.item_id", "s.dt").alias("hit"), F.lit(False).alias("ask")))
    asks = _timed(left).select(*keys, "_us").distinct().withColumn("ask", F.lit(True))
    line = stops.unionByName(asks, allowMissingColumns=True)
    answered = running_folds(line, keys, _parts(DAY, (0, 17)), F.col("_us"), {
        "before": Fold("max", F.col("hit"), inclusive=True), "later": Fold("min", F.col("hit"), after=True, inclusive=True)})

    def candidate(side: str) -> Column:
        gap = F.abs(F.col(f"{side}._us") - F.col("_us"))
        return F.when(gap < width, F.struct(gap.alias("gap"), F.col(f"{side}.ord").alias("ord"),
                                            F.col(f"{side}.item_id").alias("item_id"), F.col(f"{side}.dt").alias("dt")))

    best = answered.where("ask").withColumn("_best", F.least(candidate("before"), candidate("later")))
    return _answers(_timed(left), best, [*keys, "_us"], left.columns)


def first_within_days(left: DataFrame, right: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Adds `match_id`, `match_dt`: the first `right` scene in `ord` order whose whole-day gap is at most `days`.

    All of the same bucket is in reach, of the previous one its tail and of the next one its head. Neighbors are moved by
    one width onto the bucket's own time line: a previous scene at u is in reach iff u + width > now, a next one iff
    u - width < now, so both are running minima.
    """
    width = (days + 1) * DAY
    stops = (_bucketed(right, keys, width).groupBy(*keys, "_bucket", "_us")
             .agg(F.min(F.struct("ord", "item_id", "dt")).alias("s")))
    same = stops.groupBy(*keys, "_bucket").agg(F.min("s").alias("same"))
    prev = stops.select(*keys, (F.col("_bucket") + 1).alias("_bucket"), (F.col("_us") + width).alias("_us"), F.col("s").alias("prev"))
    head = stops.select(*keys, (F.col("_bucket") - 1).alias("_bucket"), (F.col("_us") - width).alias("_us"), F.col("s").alias("head"))
    neighbors = prev.unionByName(head, allowMissingColumns=True).withColumn("ask", F.lit(False))
    # one row per time, so that exclusive running minima leave out exactly the scenes at the same moment
    line = (neighbors.unionByName(_questions(left, keys, width), allowMissingColumns=True)
            .groupBy(*keys, "_bucket", "_us").agg(F.min("prev").alias("prev"), F.min("head").alias("head"), F.max("ask").alias("ask")))
    answered = running_folds(line, [*keys, "_bucket"], _parts(width, (10, 20)), F.col("_us"), {
        "tail_min": Fold("min", F.col("prev"), after=True), "head_min": Fold("min", F.col("head"))}).where("ask")
    best = answered.join(same, [*keys, "_bucket"], "left").withColumn("_best", F.least("same", "tail_min", "head_min"))
    return _answers(_bucketed(left, keys, width), best, [*keys, "_bucket", "_us"], left.columns)


def _questions(left: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Distinct times to be answered; scenes of the same moment share the answer."""
    return _bucketed(left, keys, width).select(*keys, "_bucket", "_us").distinct().withColumn("ask", F.lit(True))


def _answers(left: DataFrame, best: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    found = best.where(F.col("_best").isNotNull()).select(
        *on, F.col("_best.item_id").alias("match_id"), F.col("_best.dt").alias("match_dt"))
    return left.join(found, on).select(*columns, "match_id", "match_dt")
