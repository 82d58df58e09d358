"""Session settings used by the jobs and tests; cluster sizes come from spark-submit."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key also where the next step could have reused the join's partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # one tile row is up to about 15 MB, so Arrow batches stay small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def local_session(cpus: int | str = 8, app: str = "tilerain", partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (builder.config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Sets the folder for cut lineage: the cluster's setting, or `fallback` where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if folder is None:
        raise ValueError("spark.checkpoint.dir is not set and no fallback folder was given")
    if spark.sparkContext.getCheckpointDir() is None or not spark.sparkContext.getCheckpointDir().startswith(folder):
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session without one gets a scratch folder of its own."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return checkpoint_dir(spark)
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    local = spark.sparkContext.master.startswith("local")
    return checkpoint_dir(spark, tempfile.mkdtemp(prefix="tilerain-") if local else None)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes an intermediate table once, where several later branches of a plan read it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
