"""Burning as bit masks against the cell form and a loop over all cells."""

import random

import pytest
from pyspark.sql import functions as F

from tilerain.operators import burning as B
from tilerain.operators import regrid as R

H, W, TILE = 150, 170, 100


def _cells(masks, tiles, h=H, w=W, tile=TILE):
    rows = B.burned_tiles(masks, tiles, ["k"], h, w, tile).collect()
    return {(r.k, r.ty * tile + i // r.w, r.tx * tile + i % r.w) for r in rows for i, v in enumerate(r.burned) if v}, rows


def _segments(spark, seed, n=60):
    rng = random.Random(seed)
    spot = lambda: (rng.uniform(-30, 200), rng.uniform(-30, 180))
    rows = [(rng.randint(0, 2), *spot(), *spot()) for _ in range(n)]
    rows += [(0, 5.0, 5.0, 5.0, 5.0), (0, 20.0, 64.0, 190.0, 64.0), (1, 64.0, -5.0, 64.0, 300.0), (2, -9.0, -9.0, -1.0, -1.0), (2, None, 1.0, 5.0, 5.0)]
    return spark.createDataFrame(rows, "k int, x1 double, y1 double, x2 double, y2 double")


def test_lines_equal_the_cell_form(spark):
    seg = _segments(spark, 1)
    tiles = B.tiles_of(seg, ["k"], H, W, TILE)
    got, rows = _cells(B.line_masks(seg, ["k"], H, W, TILE), tiles)
    assert got == {(r.k, r.r, r.c) for r in R.touched_cells(seg, ["k"], H, W).collect()}
    assert len(rows) == 12 and {(r.h, r.w) for r in rows} == {(100, 100), (100, 70), (50, 100), (50, 70)}
    assert all(len(r.burned) == r.h * r.w for r in rows)


def _rings(spark, seed, n=25):
    """Polygons of any shape, also crossing themselves and the edges, with the right end of each."""
    rng = random.Random(seed)
    rows = []
    for ring in range(n):
        corners = [(rng.uniform(-40, 210), rng.uniform(-40, 190)) for _ in range(rng.randint(3, 7))]
        end = max(x for x, _ in corners)
        rows += [(ring % 3, ring, *p, *q, end) for p, q in zip(corners, corners[1:] + corners[:1])]
    return spark.createDataFrame(rows, "k int, ring int, x1 double, y1 double, x2 double, y2 double, xe double"), rows


@pytest.mark.parametrize("right", [None, "xe"])
def test_rings_equal_the_cell_form_and_a_loop(spark, right):
    seg, rows = _rings(spark, 2)
    tiles = B.tiles_of(seg, ["k"], H, W, TILE)
    got, _ = _cells(B.fill_masks(seg, ["k"], ["ring"], H, W, TILE, right), tiles)
    assert got == {(r.k, r.r, r.c) for r in R.filled_cells(seg, ["k"], ["ring"], H, W).collect()}
    want = set()
    for ring in {r[1] for r in rows}:
        edges = [r for r in rows if r[1] == ring]
        for r in range(H):
            xs = [x1 + (r + 0.5 - y1) / (y2 - y1) * (x2 - x1) for _, _, x1, y1, x2, y2, _ in edges if min(y1, y2) <= r + 0.5 < max(y1, y2)]
            want |= {(ring % 3, r, c) for c in range(W) if sum(x <= c + 0.5 for x in xs) % 2}
    assert got == want


def test_some_tiles_only_and_shares(spark):
    seg, _ = _rings(spark, 3)
    some = spark.createDataFrame([(0, 0, 1), (1, 1, 0), (9, 0, 0)], "k int, ty int, tx int")
    masks = B.united([B.line_masks(seg, ["k"], H, W, TILE, some), B.fill_masks(seg, ["k"], ["ring"], H, W, TILE, "xe", some)], ["k"])
    got, _ = _cells(masks, some)
    whole = {(r.k, r.r, r.c) for r in R.region_cells(seg, ["k"], ["ring"], H, W).collect()}
    assert got == {x for x in whole if (x[0], x[1] // TILE, x[2] // TILE) in {(0, 0, 1), (1, 1, 0)}}
    shares = {(r.k, r.ty, r.tx): (r.n_cells, r.burned) for r in B.burned_shares(masks, some, ["k"], H, W, TILE).collect()}
    assert shares[(9, 0, 0)] == (10000, 0) and shares[(0, 0, 1)] == (7000, sum(x[0] == 0 for x in got))


def test_words_and_not_cells_are_shuffled(spark):
    """A key with many equal segments folds before the exchange: no row per cell, no distinct, no window."""
    seg = spark.range(20000).select(F.lit(1).alias("k"), F.lit(0.5).alias("x1"), F.lit(10.5).alias("y1"), F.lit(149.5).alias("x2"), F.lit(10.5).alias("y2"))
    masks = B.line_masks(seg, ["k"], H, W, TILE)
    assert masks.count() == 3  # two words in the first tile, one in the second
    plan = masks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "partial_bit_or" in plan


def test_no_features(spark):
    seg = _segments(spark, 1).where("false")
    tiles = spark.createDataFrame([(4, 0, 0)], "k int, ty int, tx int")
    assert _cells(B.line_masks(seg, ["k"], H, W, TILE), tiles)[0] == set()
    assert B.fill_masks(seg, ["k"], [], H, W, TILE).count() == 0


def test_segments_of_one_file_are_cut_in_many_tasks(spark, monkeypatch):
    """Segments are dealt out before they become words, and the more of them the more tasks."""
    monkeypatch.setattr(B, "SEGMENTS", 10)
    segments = spark.createDataFrame([(i, 0.0, 0.0, 3.0, 3.0 + i) for i in range(400)], "id int, x1 double, y1 double, x2 double, y2 double").coalesce(1)
    for masks in (B.line_masks(segments, ["id"], 8, 8, 4), B.fill_masks(segments, ["id"], [], 8, 8, 4)):
        plan = masks._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning(40), REPARTITION_BY_NUM" in plan
        assert plan.index("REPARTITION_BY_NUM") > plan.index("partial_bit")
        assert masks.count() > 400
