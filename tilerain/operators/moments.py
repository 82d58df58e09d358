"""Statistics kept between runs (K2, E5, E6, E9, A18): partial moments per part that merge without rescanning old tiles.

A part is whatever is added or replaced as a whole: an event, a day, a batch of tiles. The state table has one row per part,
key and channel with count, mean, sum of squared deviations, least and largest value. Writing a part again replaces it, so
a job that is repeated after a lost driver counts nothing twice.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilerain.functions.bands import d
from tilerain.operators.ranking import joined
from tilerain.sources.sinks import exists, pending, write_captures


def partial_moments(df: DataFrame, part: str, channels: Sequence[str], valid: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(part, keys, channel, n, mean, m2, lo, hi) over valid pixels with a value, one pass over the unexploded rows.

    Parts are written as text; a null part is a part of its own. NaN counts as a value and makes mean and m2 NaN.
    """
    aggregates = []
    for i, c in enumerate(channels):
        value = F.when(valid, F.col(f"`{c}`").cast("double"))
        aggregates += [F.count(value).alias(f"_n{i}"), F.avg(value).alias(f"_a{i}"), F.var_pop(value).alias(f"_v{i}"), F.min(value).alias(f"_l{i}"), F.max(value).alias(f"_h{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"_n{i}").alias("n"), F.col(f"_a{i}").alias("mean"), (F.col(f"_v{i}") * F.col(f"_n{i}")).alias("m2"),
                              F.col(f"_l{i}").alias("lo"), F.col(f"_h{i}").alias("hi")) for i, c in enumerate(channels)])
    return df.groupBy(F.col(f"`{part}`").cast("string").alias("part"), *keys).agg(*aggregates).select("part", *keys, F.inline(rows))


def merged_moments(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, channel, n, mean, m2, lo, hi) of the union of parts.

    Deviations are taken from the common mean, so parts with far apart means lose no digits. Parts without values change
    nothing. Folding some parts into one first gives the same result. `keys` are not null.
    """
    by = [*keys, "channel"]
    whole = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 0, F.col("mean") * F.col("n"))).alias("_s"),
                                   F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("mean", F.col("_s") / F.nullif(F.col("n"), F.lit(0)))
    gap = F.col("mean") - F.col("_whole")
    spread = joined(parts.select(*by, "n", "mean", "m2"), whole.select(*by, F.col("mean").alias("_whole")), by).groupBy(*by).agg(
        F.sum(F.when(F.col("n") > 0, F.col("m2") + F.col("n") * gap * gap)).alias("m2"))
    return joined(whole.drop("_s"), spread, by).select(*by, "n", "mean", "m2", "lo", "hi")


def final_moments(merged: DataFrame, constant: Sequence[str] = (), population: bool = False) -> DataFrame:
    """Mean, std, min, max and count as `stats.masked_moments` gives them: mean 0, std 1, infinite ends without values.

    `constant` channels keep mean 0 and std 1; `population` divides by n in place of n - 1.
    """
    fixed = F.col("channel").isin(*constant) if constant else F.lit(False)
    ddof = 0 if population else 1
    std = F.when(F.col("n") <= ddof, d(1)).otherwise(F.sqrt(F.greatest(F.col("m2"), d(0)) / F.nullif(F.col("n") - ddof, F.lit(0))))
    ends = {"mean": F.when(fixed, d(0)).otherwise(F.coalesce("mean", d(0))), "std": F.when(fixed, d(1)).otherwise(std),
            "min": F.coalesce("lo", d(float("inf"))), "max": F.coalesce("hi", d(float("-inf")))}
    others = [c for c in merged.columns if c not in ("n", "mean", "m2", "lo", "hi")]
    return merged.select(*others, "n", *[c.alias(name) for name, c in ends.items()])


def update_state(parts: DataFrame, path: str) -> None:
    """Writes the rows of some parts; parts there before are replaced, all others stay."""
    write_captures(parts, path, ["part"])


def state(spark: SparkSession, path: str, keys: str = "") -> DataFrame:
    """All parts written so far, none before the first; `keys` is the schema of the key columns, as \"eid string\"."""
    schema = f"part string, {keys + ', ' if keys else ''}channel string, n long, mean double, m2 double, lo double, hi double"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def open_parts(tiles: DataFrame, part: str, spark: SparkSession, path: str) -> DataFrame:
    """Tiles whose part the state has not seen; only these have to be read."""
    keyed = tiles.withColumn("part", F.col(f"`{part}`").cast("string"))
    return pending(keyed, state(spark, path).select("part").distinct(), ["part"]).drop("part")
