"""Line-based inputs: event lists, cell lists, id lists, FIPS table, CSV tables."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilerain.functions.dates import is_epsg, parse_date
from tilerain.schema import CONTROL_POINT, HOMOGENEOUS_PATCH, SPLIT


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, numbered from 1 in each file, however many splits Spark reads it in.

    Lines are counted within their split while they are read, and a split's first number follows from the line counts of
    the splits before it: a table of one row per split. Lines end at \\n or \\r\\n; nothing after the last end is no line.
    """
    rows = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", r"\r\z", "").alias("line"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"))
    later = counts.select("path", "split", F.sum("n").over(before).alias("before")).where("before > 0")
    counted = rows.mapInArrow(_counted, "path string, split long, n long, line string")
    return counted.join(later, ["path", "split"], "left").select("path", (F.col("n") + F.coalesce("before", F.lit(0))).alias("line_no"), "line")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each split, which reach a task one after another and in order."""
    current, seen = None, 0
    for batch in batches:
        paths, splits, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for key in zip(paths, splits):
            if key != current:
                current, seen = key, 0
            seen += 1
            numbers.append(seen)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), batch.column(2)], ["path", "split", "n", "line"])


def _judged(lines: DataFrame, dated: bool) -> DataFrame:
    text = F.trim(F.col("line"))
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    at = lambda i: F.get(F.col("_parts"), F.lit(i))
    first = 1 if dated else 0
    n = F.size("_parts")
    whole = r"^[+-]?\d+$"
    y, x = at(first), at(first + 1)
    crs = at(first + 2)
    number = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "))
    wanted = f"needs {first + 2} or {first + 3} fields between commas"
    rules = [((n != first + 2) & (n != first + 3), wanted)]
    if dated:
        rules += [(~F.length(at(0)).isin(8, 10), "unreadable date"),
                  (parse_date(at(0)).isNull(), "unreadable date")]
    rules += [((n == first + 3) & ~is_epsg(crs), "unknown CRS code"),
              (~(y.rlike(whole) & x.rlike(whole)), "row or column is no whole number"),
              ((y.try_cast("int") < 0) | (x.try_cast("int") < 0), "row or column below 0")]
    reason = F.lit(None).cast("string")
    for bad, text_ in reversed(rules):
        reason = F.when(bad, F.concat(number, F.lit(text_))).otherwise(reason)
    kept = lines.where((text != "") & ~text.startswith("#")).withColumn("_parts", parts)
    columns = [parse_date(at(0)).alias("event_date")] if dated else []
    return kept.select(*[c for c in lines.columns if c != "line"], *columns, y.try_cast("int").alias("y"),
                       x.try_cast("int").alias("x"), F.when(n == first + 3, crs).alias("crs"), reason.alias("reason"))


def parse_event_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`date, y, x[, crs]` lines -> (events, errors with line number and reason)."""
    return _split_errors(_judged(lines, dated=True))


def parse_cell_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`y, x[, crs]` lines -> (cells, errors)."""
    return _split_errors(_judged(lines, dated=False))


def _split_errors(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    keep = [c for c in judged.columns if c not in ("event_date", "y", "x", "crs")]
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull()).select(*keep)


def strict(valid_and_errors: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Valid rows, failing the job with the first offending line it meets."""
    valid, errors = valid_and_errors
    stop = F.raise_error(F.col("reason")).isNotNull()
    columns = valid.columns
    failing = errors.where(stop).select(*[
        F.col(c) if c in errors.columns else F.lit(None).cast(valid.schema[c].dataType).alias(c) for c in columns])
    return valid.unionByName(failing)


def parse_id_list(lines: DataFrame) -> DataFrame:
    """One id per line, blanks stripped; every non-empty line counts, there is no comment rule."""
    return lines.select(F.trim("line").alias("eid")).where(F.col("eid") != "")


def parse_fips(lines: DataFrame) -> DataFrame:
    """`NN,STATE` lines."""
    parts = F.split("line", ",")
    return lines.where(F.trim("line") != "").select(F.trim(F.get(parts, F.lit(0))).alias("fips"),
                                                    F.upper(F.trim(F.get(parts, F.lit(1)))).alias("state"))


ROAD_FILE = r"tl_rd22_(\d{2})(\d*)"


def roads_by_state(roads: DataFrame, fips: DataFrame, name: str = "file_name") -> DataFrame:
    """Road features with their state by the two-digit prefix in the file name; write partitioned by `state`."""
    prefix = F.regexp_extract(F.col(name), ROAD_FILE, 1)
    return roads.withColumn("fips", prefix).join(F.broadcast(fips), "fips")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SPLIT)


def read_homogeneous_patches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=HOMOGENEOUS_PATCH)


def read_control_points(spark: SparkSession, path: str) -> DataFrame:
    """Control points with the image date and event of their file name. Columns are matched by header name."""
    raw = spark.read.csv(path, header=True, inferSchema=False, comment="#")
    typed = raw.select(*[F.col(f.name).cast("double").alias(f.name) for f in CONTROL_POINT.fields],
                       F.col("_metadata.file_name").alias("file_name"))
    return typed.withColumn("img_date", part_of("file_name", r"(\d{8})_(\d{8}_\d+_\d+)", 1)).withColumn(
        "eid", part_of("file_name", r"(\d{8})_(\d{8}_\d+_\d+)", 2))


def part_of(column: str, pattern: str, group: int) -> Column:
    return F.regexp_extract(F.col(column), pattern, group)
