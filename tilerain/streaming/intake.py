"""Incremental event intake (J1): new cell-day files -> extreme events not seen before, appended to history.

The history table is the state. A micro-batch that is replayed after a lost driver finds its own rows in the history
folder of the same run and batch id and overwrites them, so a restart neither loses nor repeats events. The run is a name
kept in the checkpoint folder: with a new checkpoint folder batch ids start over, in folders of their own.

`start_keyed_intake` keeps what it has seen as keyed state of the stream instead and never reads events back.
"""

import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilerain.functions.dates import index_to_date
from tilerain.operators.events import CELL_KEY, describe_events, extreme_events
from tilerain.schema import CELL_DAY, CUBE_START


def start_intake(spark: SparkSession, source: str, events_path: str, checkpoint: str, threshold: float,
                 geotransform: tuple[float, ...], start: str = CUBE_START, max_files: int = 1000):
    """Runs over all files that are new since the last run and stops (available-now trigger)."""
    from tilerain.sources.sinks import exists
    name = f"{checkpoint.rstrip('/')}/intake_run"
    if not exists(spark, name):
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(name)
    run = spark.read.text(name).first()["value"]
    cells = (spark.readStream.schema(CELL_DAY).option("maxFilesPerTrigger", max_files).parquet(source)
             .where(F.col("precip") > threshold))

    def take(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.groupBy(*CELL_KEY).agg(F.max("precip").alias("precip"))
        low, high = batch.agg(F.min("t"), F.max("t")).first()
        others = (F.col("run") != run) | (F.col("batch") != batch_id)
        seen = recorded(batch.sparkSession, events_path).where(F.col("t").between(low, high) & others)
        found = describe_events(extreme_events(fresh, threshold, history=seen), geotransform, start)
        found.write.mode("overwrite").parquet(f"{events_path}/run={run}/batch={batch_id}")

    return (cells.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def recorded(spark: SparkSession, events_path: str) -> DataFrame:
    """Events recorded so far; empty before the first batch."""
    from tilerain.sources.sinks import exists
    schema = "eid string, event_date date, t int, y int, x int, precip double, " \
             "bbox struct<minx:double,miny:double,maxx:double,maxy:double>, run string, batch long"
    if not exists(spark, events_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(events_path)


DAY_MS = 86_400_000
#: Side of a block of cells that share a state entry, and the bytes of its bits; a last row and column stand for null.
BLOCK = 64
SEEN_BYTES = -(-(BLOCK + 1) ** 2 // 8)


def start_keyed_intake(spark: SparkSession, source: str, events_path: str, checkpoint: str, threshold: float,
                       geotransform: tuple[float, ...], start: str = CUBE_START, keep_days: int = 3650, max_files: int = 1000):
    """As `start_intake`, with keyed state in place of the history table: an entry per day and block of BLOCK x BLOCK cells, whose
    bits tell which cell-days were extreme. Python is called once per block of a micro-batch, not once per cell-day.

    The first micro-batch that brings a cell-day writes its event, with the largest rain of that batch; later ones are
    known by the state. Entries time out `keep_days` after the newest day seen, and cell-days older than that are late and
    left out. State and written files belong to one checkpoint folder: another one needs an events folder of its own.
    """
    from tilerain.sources.sinks import exists
    if exists(spark, events_path) and not exists(spark, f"{checkpoint.rstrip('/')}/offsets"):
        raise ValueError(f"{events_path} was written by a stream with another checkpoint folder")
    origin = int(datetime.fromisoformat(start).replace(tzinfo=UTC).timestamp() * 1000)

    def once(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = np.unpackbits(np.frombuffer(state.get[0], np.uint8)) if state.exists else np.zeros(8 * SEEN_BYTES, np.uint8)
        cells = pd.concat(list(batches)).groupby("bit", sort=False, dropna=False).agg({"y": "first", "x": "first", "precip": "max"}).reset_index()
        new = cells[seen[cells["bit"].to_numpy()] == 0]
        seen[new["bit"].to_numpy()] = 1
        state.update((np.packbits(seen).tobytes(),))
        t = int(key[0])
        state.setTimeoutTimestamp(origin + (t + 2) * DAY_MS)  # the watermark runs keep_days behind; two days cover any time zone
        if len(new):
            yield pd.DataFrame({"t": t, "y": new["y"].astype("Int32"), "x": new["x"].astype("Int32"), "precip": new["precip"]})

    place = [F.coalesce(F.pmod(c, F.lit(BLOCK)), F.lit(BLOCK)) for c in ("y", "x")]
    block = {f"_b{c}": F.floor(F.col(c) / BLOCK).cast("int") for c in ("y", "x")}
    cells = (spark.readStream.schema(CELL_DAY).option("maxFilesPerTrigger", max_files).parquet(source).where(F.col("precip") > threshold)
             .withColumn("_day", index_to_date(F.col("t"), start).cast("timestamp")).withWatermark("_day", f"{keep_days} days"))
    found = (cells.withColumns({"bit": (place[0] * (BLOCK + 1) + place[1]).cast("int"), **block}).groupBy("t", *block)
             .applyInPandasWithState(once, "t int, y int, x int, precip double", "seen binary", "append", GroupStateTimeout.EventTimeTimeout))
    return (describe_events(found, geotransform, start).writeStream.format("parquet").outputMode("append")
            .option("path", events_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
