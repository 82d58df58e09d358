"""Operators across tile borders against the same on one large raster."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilerain.operators import neighborhood as N
from tilerain.operators import regrid as R
from tilerain.operators import tilegrid as G
from tilerain.schema import SAR_NODATA

SCHEMA = "raster_id long, ty int, tx int, h int, w int, v array<double>, u array<float>"


def raster(rng, h, w, gaps=0.1):
    return np.array([[SAR_NODATA if rng.random() < gaps else rng.uniform(-30, 0) for _ in range(w)] for _ in range(h)])


def tiled(spark, images, th, tw, skip=()):
    rows = []
    for i, image in images.items():
        for y in range(0, image.shape[0], th):
            for x in range(0, image.shape[1], tw):
                part = image[y:y + th, x:x + tw]
                if (i, y // th, x // tw) not in skip:
                    rows.append((i, y // th, x // tw, *part.shape, part.ravel().tolist(), [float(k) for k in range(part.size)]))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def whole(rows, column, shape, th, tw, drop=0):
    out = np.full(shape, np.nan)
    for r in rows:
        h, w = r["height"] - 2 * drop, r["width"] - 2 * drop
        out[r["ty"] * th:r["ty"] * th + h, r["tx"] * tw:r["tx"] * tw + w] = np.array(r[column]).reshape(h, w)
    return out


@pytest.fixture(scope="module")
def images():
    rng = random.Random(8)
    return {1: raster(rng, 19, 23), 2: raster(rng, 8, 8), 3: raster(rng, 9, 31, 0.0)}


def test_slopes_lee_and_laplacian_equal_the_whole_raster(spark, images):
    tiles = tiled(spark, images, 8, 7)
    slopes = G.slopes_across(G.with_halo(tiles, ["v"], 1), "v").collect()
    lee = G.lee_across(G.with_halo(tiles, ["v"], 1), "v", kernel=3).collect()
    lap = {r["raster_id"]: r["var_laplacian"] for r in G.laplacian_across(G.with_halo(tiles, ["v"], 1, fill=0.0), "v").collect()}
    for i, image in images.items():
        dy, dx = np.gradient(image)
        mine = [r for r in slopes if r["raster_id"] == i]
        assert np.allclose(whole(mine, "slope_y", image.shape, 8, 7, 1), dy) and np.allclose(whole(mine, "slope_x", image.shape, 8, 7, 1), dx)
        got = whole([r for r in lee if r["raster_id"] == i], "filtered", image.shape, 8, 7, 1)
        assert np.allclose(got, N.lee_array(image, 3, N.LEE_DAMPING, N.LEE_CU, N.LEE_CMAX), atol=1e-6)
        f = np.pad(image, 1)
        want = (f[:-2, 1:-1] + f[2:, 1:-1] + f[1:-1, :-2] + f[1:-1, 2:] - 4 * image).var(ddof=1)
        assert abs(lap[i] - want) <= 1e-9 * want


def test_a_wide_halo_and_a_missing_tile(spark, images):
    tiles = tiled(spark, images, 8, 8, skip={(1, 1, 1)})
    out = G.with_halo(tiles.where("h >= 3 AND w >= 3"), ["v", "u"], 3)
    assert out.columns == ["raster_id", "ty", "tx", "height", "width", "sides", "v", "u"]
    gone = images[1].copy()
    gone[8:16, 8:16] = SAR_NODATA
    framed = np.pad(gone, 3, constant_values=SAR_NODATA)
    for r in out.where("raster_id = 1").collect():
        y, x = r["ty"] * 8, r["tx"] * 8
        assert np.array_equal(np.array(r["v"]).reshape(r["height"], r["width"]), framed[y:y + r["height"], x:x + r["width"]])
        there = {s: t in {(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2)}
                 for s, t in ((1, (r["ty"] - 1, r["tx"])), (2, (r["ty"] + 1, r["tx"])), (4, (r["ty"], r["tx"] - 1)), (8, (r["ty"], r["tx"] + 1)))}
        assert r["sides"] == sum(s for s, t in there.items() if t)
    alone = out.where("raster_id = 2").collect()
    assert len(alone) == 1 and alone[0]["sides"] == 0


def test_one_shuffle_and_narrow_tiles_fail(spark, images):
    tiles = tiled(spark, images, 8, 8)
    plan = G.slopes_across(G.with_halo(tiles, ["v"], 1), "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(Exception, match="narrower"):
        G.with_halo(tiles, ["v"], 4).collect()
    with pytest.raises(ValueError):
        G.with_halo(tiles, ["v"], 0)
    with pytest.raises(Exception, match="values"):
        G.with_halo(tiles.withColumn("v", F.slice("v", 1, 5)), ["v"], 1).collect()


def test_windows_equal_slices(spark, images):
    rng = random.Random(5)
    tiles = tiled(spark, images, 8, 8, skip={(3, 0, 2)})
    asked = [(rng.choice([1, 2, 3, 4]), i, rng.randint(-12, 25), rng.randint(-12, 30), rng.randint(1, 20), rng.randint(1, 20), f"n{i}") for i in range(60)]
    asked += [(1, 99, 0, 0, 19, 23, None), (1, 98, 0, 0, 19, 23, "same")]
    frame = spark.createDataFrame(asked, "raster_id long, window_id long, r0 int, c0 int, height int, width int, note string")
    got = {r["window_id"]: r for r in G.read_windows(tiles, frame, ["v"], 8, 8, carried=["note"]).collect()}
    assert len(got) == len(asked)
    for i, w, r0, c0, height, width, note in asked:
        image = images.get(i, np.zeros((0, 0))).copy()
        if i == 3:
            image[:8, 16:24] = SAR_NODATA
        want = np.full((height, width), SAR_NODATA)
        for a in range(height):
            for b in range(width):
                if 0 <= r0 + a < image.shape[0] and 0 <= c0 + b < image.shape[1]:
                    want[a, b] = image[r0 + a, c0 + b]
        assert got[w]["note"] == note and np.array_equal(np.array(got[w]["v"]).reshape(height, width), want)
    assert G.read_windows(tiles, frame.limit(0), ["v"], 8, 8).count() == 0
    assert G.read_windows(tiles.limit(0), frame, ["v"], 8, 8).count() == len(asked)


@pytest.mark.parametrize("method", ["bilinear", "nearest"])
def test_regrid_over_four_tiles_equals_one_raster(spark, method):
    rng = random.Random(6)
    image, src = raster(rng, 16, 16), (100.0, 10.0, 500.0, -10.0)
    four = tiled(spark, {1: image}, 8, 8)
    wanted = [(1, 1, 131.0, 7.0, 470.0, -7.0, 12, 11), (1, 2, 80.0, 25.0, 520.0, -25.0, 9, 9), (1, 3, 250.0, -6.0, 350.0, 6.0, 10, 20), (1, 4, 9000.0, 5.0, 0.0, -5.0, 2, 2)]
    frame = spark.createDataFrame(wanted, "raster_id long, window_id int, ulx double, sx double, uly double, sy double, h int, w int")
    got = {r["window_id"]: r for r in G.regrid_across(four, frame, "v", src, 8, 8, SAR_NODATA, method).collect()}
    for _, k, ulx, sx, uly, sy, h, w in wanted:
        rows, cols = G.axis_places(h, uly, sy, src[2], src[3]), G.axis_places(w, ulx, sx, src[0], src[1])
        want = G.resampled(image, rows, cols, SAR_NODATA, method)
        assert np.allclose(np.array(got[k]["data"]).reshape(h, w), want, atol=1e-12)
        px = spark.createDataFrame([(1, r, c, float(image[r, c])) for r in range(16) for c in range(16)], "tile_id long, r int, c int, v double")
        fn = R.bilinear_regrid if method == "bilinear" else R.nearest_regrid
        pixels = fn(px, spark.createDataFrame([(1,)], "tile_id long"), "v", src, (ulx, sx, uly, sy), h, w, SAR_NODATA).collect()
        assert len(pixels) == h * w and all(abs(p["v"] - want[p["r"], p["c"]]) < 1e-9 for p in pixels)
    assert (np.array(got[4]["data"]) == SAR_NODATA).all() and any(v != SAR_NODATA for v in got[1]["data"])


def test_tile_regrid_is_narrow(spark, images):
    tiles = spark.createDataFrame([(i, *m.shape, m.ravel().tolist()) for i, m in images.items()], "tile_id int, h int, w int, v array<double>")
    out = G.regrid_tiles(tiles, "v", (0.0, 10.0, 0.0, -10.0), (3.0, 4.0, 5.0, -4.0), 30, 28, SAR_NODATA)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.columns == [*tiles.columns, "regridded"]
    for r in out.collect():
        want = G.resampled(images[r["tile_id"]], G.axis_places(30, 5.0, -4.0, 0.0, -10.0), G.axis_places(28, 3.0, 4.0, 0.0, 10.0), SAR_NODATA, "bilinear")
        assert np.allclose(np.array(r["regridded"]).reshape(30, 28), want)
    with pytest.raises(Exception, match="unknown method"):
        G.regrid_tiles(tiles, "v", (0.0, 10.0, 0.0, -10.0), (3.0, 4.0, 5.0, -4.0), 3, 3, SAR_NODATA, "cubic").collect()
