"""Several maps per window, the joint mask and the despeckling job, against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilerain.operators import scoring as W
from tilerain.plans import despeckle_plan as P
from tilerain.schema import SAR_NODATA

MOMENTS = {"vv": (-14.0, 5.0), "vh": (-20.0, 4.0)}


def tile(rng, h, w):
    def layer():
        return [SAR_NODATA if rng.random() < 0.05 else rng.uniform(-30, 0) for _ in range(h * w)]
    return layer(), layer()


def _uneven():
    def factory():
        """Maps that depend on the place in the window and on both channels."""
        def score(batch):
            rows = np.arange(batch.shape[2]).reshape(1, -1, 1)
            return np.stack([batch[:, 0] * (1 + 0.1 * rows) + batch[:, 1].mean(axis=(1, 2), keepdims=True), batch[:, 1] - 0.3 * batch[:, 0]], axis=1)
        return score
    return factory


uneven = _uneven()  # a nested function, so that it is sent to the workers by value


def looped(vv, vh, h, w, size, stride, weighting):
    image = np.array([vv, vh]).reshape(2, h, w)
    gone = (image == SAR_NODATA).any(axis=0)
    x = image.copy()
    for k, p in enumerate(("vv", "vh")):
        x[k][gone] = MOMENTS[p][0]
        x[k] = (x[k] - MOMENTS[p][0]) / MOMENTS[p][1]
    weight = np.array(W.window_weights(size, weighting)).reshape(size, size)
    total, mass = np.zeros_like(image), np.zeros((h, w))
    spots = [sorted({*range(0, n - size + 1, stride), n - size}) for n in (h, w)]
    for a in spots[0]:
        for b in spots[1]:
            out = uneven()(x[None, :, a:a + size, b:b + size])[0]
            total[:, a:a + size, b:b + size] += out * weight
            mass[a:a + size, b:b + size] += weight
    maps = total / np.maximum(mass, 1e-3)
    for k, p in enumerate(("vv", "vh")):
        maps[k] = maps[k] * MOMENTS[p][1] + MOMENTS[p][0]
    maps[:, gone] = SAR_NODATA
    return maps.reshape(2, -1)


@pytest.mark.parametrize("weighting, stride, batch", [("hann", 3, 128), ("uniform", 4, 2), ("hann", 5, 1)])
def test_two_maps_equal_a_loop(spark, weighting, stride, batch):
    rng = random.Random(1)
    shapes = [(9, 9), (5, 12), (5, 5), (20, 7)]
    rows = [(i, h, w, *tile(rng, h, w)) for i, (h, w) in enumerate(shapes)] + [(9, 6, 6, [SAR_NODATA] * 36, [1.0] * 36)]
    tiles = spark.createDataFrame(rows + [(10, 6, 6, None, [1.0] * 36)], "tile_id int, h int, w int, vv array<double>, vh array<double>")
    out = W.tile_maps(tiles, ["vv", "vh"], {"a": MOMENTS["vv"], "b": MOMENTS["vh"]}, 5, uneven, MOMENTS, stride, weighting, SAR_NODATA, batch)
    got = {r["tile_id"]: r for r in out.collect()}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for i, h, w, vv, vh in rows:
        want = looped(vv, vh, h, w, 5, stride, weighting)
        assert np.allclose([got[i]["a"], got[i]["b"]], want, rtol=0, atol=1e-9)
        assert ((np.array(got[i]["a"]) == SAR_NODATA) == (np.array([vv, vh]) == SAR_NODATA).any(axis=0)).all()
    assert got[10]["a"] is None and got[10]["b"] is None


def test_wrong_sizes_fail(spark):
    for row in ((1, 6, 6, [1.0] * 35, [1.0] * 36), (1, 4, 9, [1.0] * 36, [1.0] * 36)):
        tiles = spark.createDataFrame([row], "tile_id int, h int, w int, vv array<double>, vh array<double>")
        with pytest.raises(Exception, match="values|no patch"):
            W.tile_maps(tiles, ["vv", "vh"], {"a": MOMENTS["vv"], "b": MOMENTS["vh"]}, 5, uneven, MOMENTS).collect()


@pytest.fixture()
def captures(spark):
    rng = random.Random(2)
    rows = []
    for i in range(6):
        vv, vh = tile(rng, 8, 8)
        rows.append((f"2024_{i % 3}_1", "20240101", f"2024010{i}", "vv", 8, 8, vv))
        if i != 4:
            rows.append((f"2024_{i % 3}_1", "20240101", f"2024010{i}", "vh", 8, 8, vh))
    return rows


def test_job_is_taken_up_where_it_ended(spark, tmp_path, captures):
    schema = "eid string, s2_date string, s1_date string, polarization string, h int, w int, data array<double>"
    path = str(tmp_path / "out")
    tiles = spark.createDataFrame(captures, schema)
    assert P.finished(spark, path, "cvae").count() == 0

    def run(some, scorer=uneven, **options):
        P.despeckle(some, path, MOMENTS, 5, scorer, stride=3, **options)
        return {(r["eid"], str(r["s1_date"]), r["polarization"]): r["data"] for r in spark.read.parquet(path).collect()}

    first = run(tiles.where("s1_date < '20240102'"))
    assert len(first) == 4
    both = run(tiles)
    assert len(both) == 10 and all(both[k] == v for k, v in first.items())  # the capture without VH has no output
    for eid, _, s1, polarization, h, w, _ in captures:
        if s1 == "20240104":
            assert (eid, s1, polarization) not in both
            continue
        vv, vh = (next(c[6] for c in captures if c[2] == s1 and c[3] == p) for p in ("vv", "vh"))
        want = looped(vv, vh, h, w, 5, 3, "hann")["vv vh".split().index(polarization)]
        assert np.allclose(both[eid, s1, polarization], want, atol=1e-4)
    shrunk = lambda: W.smoothing_scorer(1.0)()
    assert run(tiles, shrunk) == both  # nothing is open
    again = run(tiles.where("s1_date = '20240100'"), shrunk, replace=True)
    changed = {k for k in both if again[k] != both[k]}
    assert {k[1] for k in changed} == {"20240100"} and len(again) == 10
    left = P.despeckled(tiles, P.finished(spark, path, "enhanced_lee"), MOMENTS, 5, uneven, 3, variant="enhanced_lee")
    assert left.select("s1_date").distinct().count() == 5
    assert P.despeckled(tiles, P.finished(spark, path, "cvae"), MOMENTS, 5, uneven, 3).count() == 0


def test_outputs_do_not_depend_on_the_partitioning(spark, captures):
    schema = "eid string, s2_date string, s1_date string, polarization string, h int, w int, data array<double>"
    tiles = spark.createDataFrame(captures, schema)
    runs = [sorted((r["eid"], r["s1_date"], r["polarization"], tuple(r["data"])) for r in P.despeckled(tiles.repartition(n), None, MOMENTS, 5, uneven, 2).collect())
            for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 10
