"""Plan shape: no pairwise join strategies, pushed filters, no shuffle where a stencil or a window cut is narrow."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tilerain.operators import neighborhood as N
from tilerain.operators import patches as G
from tilerain.operators import scenes as S
from tilerain.plans import fixtures as X


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scan(df) -> str:
    jvm = df.sparkSession._jvm
    text = jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return text.replace("\n", " ")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_pairwise_join(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "BroadcastNestedLoopJoin" not in text
    assert "CartesianProduct" not in text


def test_scene_search_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "scene")
    rows = spark.range(100).select(
        F.col("id").alias("item_id"), F.lit("s2").alias("sensor"), F.lit("2024-01-05 10:00:00").cast("timestamp_ntz").alias("dt"),
        F.struct(F.lit(0.0).alias("minx"), F.lit(0.0).alias("miny"), F.lit(1.0).alias("maxx"), F.lit(1.0).alias("maxy")).alias("bbox"),
        F.create_map(F.lit("a"), F.lit("b")).alias("properties"))
    rows.write.parquet(path)
    found = S.search(spark.read.parquet(path), "s2", (0.5, 0.5, 2.0, 2.0), "2024-01-01", "2024-01-09").select("item_id")
    assert found.count() == 100
    pushed = re.search(r"PushedFilters: \[(.*?)\]", scan(found)).group(1)
    assert "sensor" in pushed and "dt" in pushed and "bbox.minx" in pushed
    assert "properties" not in re.search(r"ReadSchema: (\S+)", scan(found)).group(1)


def test_tile_form_does_not_shuffle(spark, sf):
    tiles = X.tile(spark, sf)
    assert "Exchange" not in plan(N.lee_filter_tiles(tiles))
    assert "Exchange" not in plan(G.strided_positions(tiles, 3, 2))


def test_stencils_share_one_shuffle(spark, sf):
    px = X.pixel(spark, sf).select("tile_id", "r", "c", F.col("dn").cast("double").alias("dn"))
    assert plan(N.gradient(px, "dn")).count("Exchange hashpartitioning") == 1
    assert plan(N.laplacian_variance(px, "dn")).count("Exchange hashpartitioning") == 1
    lee = N.lee_filter(X.pixel(spark, sf).select("tile_id", "r", "c", "vv_db"), "vv_db", "vv")
    assert plan(lee).count("Exchange hashpartitioning") == 1


def test_columns_are_pruned(spark, sf):
    text = scan(entry.queries()["cover_percent"](spark, sf))
    assert "label" not in re.search(r"ReadSchema: (\S+)", text).group(1)
