"""Global running sums, running extremes, ranks and medians without a single-task window.

A window without partition columns sorts the whole table in one task, and one with a hot key sorts that key in one task.
Here the order column is cut into nested buckets. Each level's buckets are folded to one row, so the fold of everything
before a row is the fold of the earlier buckets plus the fold inside its own finest bucket. No task sees more rows than
one finest bucket or one parent's children, whatever share of the table a key or a bucket holds.
"""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilerain.functions.keys import key_levels

Level = tuple[str, Column]
#: Rows of a key whose median is taken in one group, and larger keys that are broadcast; more are joined like any table.
GROUP_ROWS, BROADCAST_KEYS = 100_000, 50_000


class Fold(NamedTuple):
    """`op` (sum, max, min) of `value` over the rows before (or after) each row in the order."""

    op: str
    value: Column
    after: bool = False
    inclusive: bool = False


_OPS = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(op: str, *parts: Column) -> Column:
    if op == "sum":
        return sum(F.coalesce(p, F.lit(0)) for p in parts)
    return F.greatest(*parts) if op == "max" else F.least(*parts)


def running_folds(df: DataFrame, keys: Sequence[str], levels: Sequence[Level], order: Column,
                  folds: dict[str, Fold], totals: Sequence[str] = ()) -> DataFrame:
    """Adds one column per fold, and `<name>_total` over the whole key for the folds listed in `totals`.

    `levels` are bucket columns from coarse to fine, each a non-decreasing function of `order`. Rows with a NULL key
    drop out.
    """
    names = [name for name, _ in levels]
    # Non-null levels and keys keep the joins below from adding filters of their own to each branch; the branches then
    # share the exchange that feeds them.
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    work = present.select("*", order.alias("_order"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in levels],
                          *[f.value.alias(f"_m_{m}") for m, f in folds.items()])
    reduce = [_OPS[f.op](f"_m_{m}").alias(f"_m_{m}") for m, f in folds.items()]

    per_level: dict[int, DataFrame] = {len(names): work.groupBy(*keys, *names).agg(*reduce)}
    for depth in range(len(names) - 1, 0, -1):
        per_level[depth] = per_level[depth + 1].groupBy(*keys, *names[:depth]).agg(*reduce)

    def sided(parent: Sequence[str], by: str, after: bool, inclusive: bool):
        line = Window.partitionBy(*parent).orderBy(F.col(by).desc() if after else F.col(by).asc())
        return line.rangeBetween(Window.unboundedPreceding, Window.currentRow) if inclusive else (
            line.rowsBetween(Window.unboundedPreceding, -1))

    kept = [f"{m}_total" for m in totals]
    offsets = None
    for depth in range(1, len(names) + 1):
        parent, here = [*keys, *names[:depth - 1]], names[depth - 1]
        edge = [_OPS[f.op](f"_m_{m}").over(sided(parent, here, f.after, False)).alias(f"_e_{m}") for m, f in folds.items()]
        if offsets is None:
            whole = [_OPS[folds[m].op](f"_m_{m}").over(Window.partitionBy(*parent)).alias(f"{m}_total") for m in totals]
            offsets = per_level[depth].select(*keys, *names[:depth], *edge, *whole)
        else:
            outer = offsets.select(*parent, *kept, *[F.col(f"_e_{m}").alias(f"_o_{m}") for m in folds])
            joined = per_level[depth].select(*keys, *names[:depth], *edge).join(outer, parent)
            offsets = joined.select(*keys, *names[:depth], *kept, *[
                _merge(f.op, F.col(f"_e_{m}"), F.col(f"_o_{m}")).alias(f"_e_{m}") for m, f in folds.items()])

    bucket = [*keys, *names]
    local = work.select(*df.columns, *names, *[
        _OPS[f.op](f"_m_{m}").over(sided(bucket, "_order", f.after, f.inclusive)).alias(f"_l_{m}") for m, f in folds.items()])
    return local.join(offsets, bucket).select(*df.columns, *kept, *[
        _merge(f.op, F.col(f"_l_{m}"), F.col(f"_e_{m}")).alias(m) for m, f in folds.items()])


def ranked(df: DataFrame, keys: Sequence[str], levels: Sequence[Level], order: Column) -> DataFrame:
    """Adds 1-based `rank` and the group's `rank_total`; `order` must be unique within `keys`."""
    one = Fold("sum", F.lit(1).cast("bigint"))
    return (running_folds(df, keys, levels, order, {"_before": one}, ["_before"])
            .withColumn("rank", F.col("_before") + 1).withColumnRenamed("_before_total", "rank_total").drop("_before"))


def ranked_by_key(df: DataFrame, keys: Sequence[str], key: Column, ties: Sequence[str]) -> DataFrame:
    """`ranked` on a random key; `ties` make the order total."""
    keyed = df.withColumn("_key", key)
    return ranked(keyed, keys, key_levels(F.col("_key")), F.struct("_key", *ties)).drop("_key")


def integer_levels(value: Column) -> list[Level]:
    """Nested buckets of any unique bigint: at most 2^20 coarse ones, 2^15 children of each, 2^14 rows."""
    return [(f"_i{b}", F.shiftright(value.cast("bigint"), b)) for b in (44, 29, 14)]


def value_levels(value: Column) -> list[Level]:
    """Nested buckets of any double by sign and base-2 logarithm, so tiny and huge values spread out alike; NaN comes last.

    512 coarse buckets per octave, 32,768 children each: a finest bucket is about one single-precision value wide.
    """
    spread = F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * (F.log2(F.abs(value)) + 1100))
    last = F.lit((1 << 63) - 1)
    return [(f"_v{b}", F.when(F.isnan(value), last).otherwise(F.floor(spread * F.lit(float(1 << b))))) for b in (9, 24)]


def exact_median(df: DataFrame, keys: Sequence[str], value: str, how: str = "average", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Exact median per key as `median`, see `exact_medians`; one NULL row without `keys` and without any value."""
    return exact_medians(df, keys, [value], how, group_rows).withColumnRenamed(value, "median")


def exact_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str], how: str = "average", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Exact medians per key under the columns' names; `lower` takes the lower middle value, `average` the mean of both.

    NULL values don't count, NaN ranks above all numbers. Rows with a NULL key drop out, and keys without any value give no
    row. Keys of at most `group_rows` rows are aggregated as groups, all columns at once. Larger ones, and the whole table
    without `keys`, go through nested buckets, so no task holds a long value list.
    """
    if how not in ("lower", "average"):
        raise ValueError(f"unknown median {how!r}")
    rows = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values])
    rows = rows.where(" AND ".join(["(" + " OR ".join(f"`{v}` IS NOT NULL" for v in values) + ")", *[f"`{k}` IS NOT NULL" for k in keys]]))
    if not keys:
        return _bucketed_medians(rows, keys, values, how)
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_rows).select(*keys)
    first = large.limit(BROADCAST_KEYS + 1).collect()
    if first and len(first) <= BROADCAST_KEYS:
        large = F.broadcast(df.sparkSession.createDataFrame(first, large.schema))
    middle = "percentile_disc(0.5) WITHIN GROUP (ORDER BY `{}`)" if how == "lower" else "percentile(`{}`, 0.5)"
    small = rows.join(large, [*keys], "left_anti") if first else rows
    medians = small.groupBy(*keys).agg(*[F.expr(middle.format(v)).alias(v) for v in values])
    return medians.unionByName(_bucketed_medians(rows.join(large, [*keys], "left_semi"), keys, values, how)) if first else medians


def _bucketed_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str], how: str) -> DataFrame:
    """Equal values collapse to a count; running counts over nested buckets then tell which values hold the middle ranks."""
    if len(values) == 1:
        return _bucketed_median(df, keys, values[0], how).withColumnRenamed("median", values[0])
    each = F.array(*[F.struct(F.lit(i).alias("_of"), F.col(v).alias("_value")) for i, v in enumerate(values)])
    found = _bucketed_median(df.select(*keys, F.inline(each)), [*keys, "_of"], "_value", how)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_of") == i, F.col("median"))).alias(v) for i, v in enumerate(values)])


def _bucketed_median(df: DataFrame, keys: Sequence[str], value: str, how: str) -> DataFrame:
    counts = (df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
              .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    run = running_folds(counts, keys, value_levels(F.col("_v")), F.col("_v"), {"c": Fold("sum", F.col("_c"))}, ["c"])
    low = F.floor((F.col("c_total") + 1) / 2)
    high = low if how == "lower" else F.floor(F.col("c_total") / 2) + 1

    def holds(rank: Column) -> Column:
        return (F.col("c") < rank) & (rank <= F.col("c") + F.col("_c"))

    least, most = F.min("_v"), F.max("_v")
    middle = run.where(holds(low) | holds(high)).groupBy(*keys)
    return middle.agg(F.when(least == most, least).otherwise((least + most) / 2).alias("median"))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join of two aggregates on their keys; without keys both are one row, and those become one."""
    if keys:
        return left.join(right, list(keys))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
