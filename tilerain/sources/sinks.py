"""Writers and resume rules."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_patches(patches: DataFrame, path: str) -> None:
    """One folder per split. An empty result still leaves the schema behind."""
    patches.write.mode("overwrite").option("maxRecordsPerFile", 4096).partitionBy("split").parquet(path)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in shard order; a shard is one task's sorted output."""
    (sharded.repartition("shard").sortWithinPartitions("shard", "shard_pos")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def write_captures(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One folder per capture. Folders of the captures written are replaced, all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def split_manifest(events: DataFrame, event: str = "eid") -> DataFrame:
    """Ids with the size of their split; one row per event, so no list of ids has to fit in one row."""
    sizes = events.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return events.join(F.broadcast(sizes), "split").select("split", event, "n")


def write_manifest(events: DataFrame, path: str, event: str = "eid") -> None:
    """The manifest as JSON lines in id order, one folder per split."""
    (split_manifest(events, event).repartitionByRange("split", event).sortWithinPartitions("split", event)
     .write.mode("overwrite").partitionBy("split").json(path))


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def metrics_json(metrics: DataFrame, keys: Sequence[str] = ("split", "partition")) -> DataFrame:
    """One nested JSON document per key from (keys, name, value) rows; NaN and NULL become null."""
    value = F.when(~F.isnan("value"), F.col("value"))
    entry = F.struct(F.col("name").alias("key"), value.alias("value"))
    folded = metrics.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("_m"))
    return folded.select(*keys, F.to_json("_m", {"ignoreNullFields": "false"}).alias("json"))


def append_trials(trials: DataFrame, path: str) -> None:
    """Adds finished trials; NaN is written as null."""
    cleaned = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in trials.dtypes]
    trials.select(*cleaned).write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items not in the output or history table."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def pending_trials(spark: SparkSession, trials: DataFrame, path: str) -> DataFrame:
    """Trials not yet in the log; everything when there is no log."""
    return pending(trials, spark.read.parquet(path), ["trial"]) if exists(spark, path) else trials


def record_history(cells: DataFrame, path: str) -> None:
    cells.select("t", "y", "x").write.mode("append").parquet(path)
