"""Helpers shared by the operators of this folder."""

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilerain.session import scratch_folder

#: Rows per Arrow batch that hold whole texts; a batch stays near 30 MB for texts of a few KB.
TEXT_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text of a column, nulls as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """Writes a table once into the folder all executors share and reads it back: lineage ends here, and a lost executor
    costs no recomputation."""
    path = scratch_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spill_file():
    """An unnamed file in Spark's own scratch space for the data of one task; it goes when the task ends."""
    folders = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.path.isdir(d)]
    return tempfile.TemporaryFile(dir=folders[0] if folders else None)


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over batches that are small enough for whole texts."""
    def small(batches):
        def cut():
            for batch in batches:
                for at in range(0, batch.num_rows, TEXT_ROWS):
                    yield batch.slice(at, TEXT_ROWS)
        return fn(cut())
    return df.mapInArrow(small, schema)
