"""Neighborhood, window and loss operators against plain loops on small arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilerain.operators import losses as L
from tilerain.operators import neighborhood as N
from tilerain.operators import patches as G
from tilerain.operators import regrid as R
from tilerain.operators import scoring as W
from tilerain.operators import stacking as K

rng = np.random.default_rng(3)


def tile_frame(spark, arrays, column="data"):
    rows = [(i, a.shape[0], a.shape[1], [float(v) for v in a.ravel()]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, f"tile_id long, h int, w int, {column} array<double>")


def pixel_frame(spark, arrays, column="v"):
    return K.exploded(tile_frame(spark, arrays, column), [column])


def as_array(df, column, shape, tile=0):
    out = np.full(shape, np.nan)
    for row in df.where(F.col("tile_id") == tile).select("r", "c", column).collect():
        out[row[0], row[1]] = row[2]
    return out


def lee_loop(db, k=7, d=1.0, cu=0.523, cmax=1.73):
    power = np.where(db == -9999, 0.0, 10 ** (db / 10))
    out = np.full(db.shape, -9999.0)
    for y in range(db.shape[0]):
        for x in range(db.shape[1]):
            if power[y, x] == 0:
                continue
            win = power[max(0, y - k // 2):y + k // 2 + 1, max(0, x - k // 2):x + k // 2 + 1]
            win = win[win != 0]
            mean, std = win.mean(), win.std(ddof=1) if win.size > 1 else 0.0
            ci = std / mean
            w = 1.0 if ci <= cu else 0.0 if ci >= cmax else math.exp(-d * (ci - cu) / (cmax - ci))
            out[y, x] = 10 * math.log10(mean * w + power[y, x] * (1 - w))
    return out


def speckled(shape):
    db = rng.normal(-12, 6, shape)
    db[rng.random(shape) < 0.1] = -9999
    return db


def test_lee_forms_agree_with_loop(spark):
    arrays = [speckled((17, 13)), np.full((9, 9), -9999.0)]
    arrays[1][4, 4] = -7.0
    tiles = K.exploded(N.lee_filter_tiles(tile_frame(spark, arrays)), ["data"])
    lines = N.lee_filter(pixel_frame(spark, arrays, "db"), "db", "out")
    for i, a in enumerate(arrays):
        want = lee_loop(a)
        np.testing.assert_allclose(as_array(tiles, "data", a.shape, i), want, atol=1e-6)
        np.testing.assert_allclose(as_array(lines, "out", a.shape, i), want, atol=1e-6)


def test_gradient_matches_numpy(spark):
    a = rng.normal(size=(6, 9))
    out = N.gradient(pixel_frame(spark, [a]), "v")
    gy, gx = np.gradient(a)
    np.testing.assert_allclose(as_array(out, "slope_y", a.shape), gy)
    np.testing.assert_allclose(as_array(out, "slope_x", a.shape), gx)


def test_ssim_matches_loop(spark):
    x, y = rng.random((15, 14)), rng.random((15, 14))
    taps = np.exp(-(np.arange(11) - 5) ** 2 / (2 * 1.5 ** 2))
    taps /= taps.sum()
    w = np.outer(taps, taps)
    values = []
    for i in range(5):
        for j in range(4):
            p, q = x[i:i + 11, j:j + 11], y[i:i + 11, j:j + 11]
            mp, mq = (w * p).sum(), (w * q).sum()
            vp, vq, cv = (w * p * p).sum() - mp ** 2, (w * q * q).sum() - mq ** 2, (w * p * q).sum() - mp * mq
            values.append((2 * mp * mq + 1e-4) / (mp ** 2 + mq ** 2 + 1e-4) * (2 * cv + 9e-4) / (vp + vq + 9e-4))
    tiles = tile_frame(spark, [x], "x").join(tile_frame(spark, [y], "y"), ["tile_id", "h", "w"])
    assert N.ssim_tiles(tiles, "x", "y").first()["ssim"] == pytest.approx(np.mean(values), abs=1e-9)


def test_leave_one_out_matches_loop(spark):
    stack = np.array([speckled((4, 4)) for _ in range(5)])
    px = pixel_frame(spark, list(stack)).withColumn("acq", F.col("tile_id")).withColumn("stack_id", F.lit(0))
    out = N.leave_one_out(px, ["v"]).collect()
    for row in out:
        others = np.delete(stack[:, row["r"], row["c"]], row["acq"])
        want = -9999.0 if (others == -9999).any() else others.mean()
        assert row["v_composite"] == pytest.approx(want)
        assert row["union_missing"] == bool((stack[:, row["r"], row["c"]] == -9999).any())


@pytest.mark.parametrize("loss", ["bce", "bce_dice", "tversky", "focal_tversky"])
def test_shift_losses_match_loop(spark, loss):
    logit, label = rng.normal(size=(5, 5)) * 3, (rng.random((8, 8)) < 0.3).astype(int)
    rows = [(0, [float(v) for v in logit.ravel()], [int(v) for v in label.ravel()])]
    df = spark.createDataFrame(rows, "id long, logit array<double>, label array<int>")
    got = {(r["row_shift"], r["col_shift"]): r["loss"] for r in L.shift_losses(df, ["id"], 5, 8, loss, 1.5).collect()}
    p = 1 / (1 + np.exp(-logit))
    assert len(got) == 16
    for (i, j), value in got.items():
        y = label[i:i + 5, j:j + 5]
        bce = -(1.5 * y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        tp = (p * y).sum()
        dice = 1 - (2 * tp + 1) / (p.sum() + y.sum() + 1)
        tv = 1 - (tp + 1) / (tp + 0.3 * ((1 - y) * p).sum() + 0.7 * (y * (1 - p)).sum() + 1)
        want = {"bce": bce, "bce_dice": bce + dice, "tversky": tv, "focal_tversky": tv ** (4 / 3)}[loss]
        assert value == pytest.approx(want, abs=1e-9)


def test_placements_at_full_size_and_with_nulls(spark):
    logit, label = rng.normal(size=(64, 64)) * 3, (rng.random((68, 68)) < 0.3).astype(int)
    flat = ([float(v) for v in logit.ravel()], [int(v) for v in label.ravel()])
    df = spark.createDataFrame([(0, *flat), (1, None, flat[1]), (2, flat[0], None)], "id long, logit array<double>, label array<int>")
    losses = L.shift_losses(df, ["id"], 64, 68, "bce", 2.0)
    rows = losses.collect()
    assert len(rows) == 75 and all((r.loss is None) == (r.id > 0) for r in rows)
    p = 1 / (1 + np.exp(-logit))
    for r in rows[:25]:
        y = label[r.row_shift:r.row_shift + 64, r.col_shift:r.col_shift + 64]
        assert r.loss == pytest.approx(-(2 * y * np.log(p) + (1 - y) * np.log(1 - p)).mean(), abs=1e-9)
    center = L.centered_losses(df, ["id"], 64, 68, "bce", 2.0).where("id = 0").collect()
    assert [(r.row_shift, r.col_shift) for r in center] == [(2, 2)]
    assert center[0].loss == pytest.approx(next(r.loss for r in rows if (r.id, r.row_shift, r.col_shift) == (0, 2, 2)))
    plan = losses._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lambda" not in plan


def test_tied_shift_prefers_center(spark):
    df = spark.createDataFrame([(0, [0.0] * 9, [0] * 25), (1, [1.0] * 9, [1] + [0] * 24)], "id long, logit array<double>, label array<int>")
    best = {r["id"]: (r["row_shift"], r["col_shift"]) for r in L.best_shift(L.shift_losses(df, ["id"], 3, 5), ["id"], 3).collect()}
    assert best[0] == (1, 1)
    assert best[1] == (0, 0)


def test_blend_of_constant_is_constant(spark):
    tiles = tile_frame(spark, [np.full((13, 11), 0.25)])
    constant = lambda: (lambda batch: batch[:, 0])
    for weighting in ("uniform", "hann"):
        cuts = W.scored_windows(W.windows(tiles, ["data"], 8, 6), ["data"], 8, constant)
        got = as_array(W.blended(cuts, 8, weighting), "prob", (13, 11))
        np.testing.assert_allclose(got, 0.25)
        tile_form = K.exploded(W.tile_scores(tiles, ["data"], 8, constant, 6, weighting), ["prob"])
        np.testing.assert_allclose(as_array(tile_form, "prob", (13, 11)), 0.25)


def test_augmentation_matches_numpy(spark):
    a = np.arange(16.0).reshape(4, 4)
    tiles = tile_frame(spark, [a])
    for fh in (False, True):
        for fv in (False, True):
            for turns in range(4):
                want = a[:, ::-1] if fh else a
                want = want[::-1] if fv else want
                want = np.rot90(want, turns)
                got = tiles.select(G.augmented(F.col("data"), 4, F.lit(fh), F.lit(fv), F.lit(turns)).alias("o")).first()["o"]
                assert got == want.ravel().tolist()


def test_polygon_cells_match_loop(spark):
    ring = [(1.2, 0.7), (8.6, 2.1), (6.3, 8.8), (4.1, 4.4), (2.2, 7.9)]
    edges = [(0, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]
    df = spark.createDataFrame([tuple(float(v) if i else v for i, v in enumerate(e)) for e in edges], "id long, x1 double, y1 double, x2 double, y2 double")

    def inside(x, y):
        hit = False
        for _, x1, y1, x2, y2 in edges:
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                hit = not hit
        return hit
    want = {(r, c) for r in range(10) for c in range(10) if inside(c + 0.5, r + 0.5)}
    got = {(r["r"], r["c"]) for r in R.filled_cells(df, ["id"], [], 10, 10).collect()}
    assert got == want
    touched = {(r["r"], r["c"]) for r in R.touched_cells(df, ["id"], 10, 10).collect()}
    for _, x1, y1, x2, y2 in edges:
        for t in np.linspace(0, 1, 501):
            assert (int(y1 + t * (y2 - y1)), int(x1 + t * (x2 - x1))) in touched
    assert {(r["r"], r["c"]) for r in R.region_cells(df, ["id"], [], 10, 10).collect()} == want | touched


def test_shift_zero_is_identity(spark):
    a = rng.normal(size=(5, 5))
    px = pixel_frame(spark, [a])
    shifts = spark.createDataFrame([(0, 0, 0)], "tile_id long, shift_x int, shift_y int")
    out = R.shifted_pair(px, px.withColumnRenamed("v", "u"), shifts)
    assert out.where("v <> u").count() == 0 and out.count() == 25


def test_imputation_of_empty_tile(spark):
    from tilerain.operators.stats import imputed
    px = pixel_frame(spark, [np.full((2, 2), -9999.0)])
    assert [r["v"] for r in imputed(px, ["tile_id"], "v", F.col("v") == -9999.0).collect()] == [0.0] * 4
    with pytest.raises(Exception, match="no value left"):
        imputed(px, ["tile_id"], "v", F.col("v") == -9999.0, "error").collect()
