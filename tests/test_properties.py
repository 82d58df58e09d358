"""Invariants: independence of partitioning, hot keys, agreement with brute force, sizes and coverage."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilerain.functions import bands as B
from tilerain.operators import events as E
from tilerain.operators import losses as L
from tilerain.operators import metrics as M
from tilerain.operators import pairing as P
from tilerain.operators import patches as G
from tilerain.operators import ranking as K
from tilerain.operators import regrid as R
from tilerain.operators import stacking as C
from tilerain.operators import stats as T

START = datetime(2024, 3, 1)


def hot_scenes(spark, n=400, seed=1):
    """A third of all scenes in one event, many of them within one hour, plus exact copies in time."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else draw.randrange(1, 20)
        if key == 0 and i % 2 == 0:
            when = START + timedelta(microseconds=draw.randrange(3_600_000_000))
        else:
            when = START + timedelta(seconds=draw.randrange(10 * 86400))
        if i % 10 == 0:
            when = START + timedelta(hours=6 * draw.randrange(8))
        rows.append((key, i, "s2" if draw.random() < 0.5 else "s1", when, draw.randrange(10 ** 6) * 1000 + i))
    return rows, spark.createDataFrame(rows, "eid int, item_id int, sensor string, dt timestamp_ntz, ord long")


@pytest.mark.parametrize("partitions", [1, 7])
def test_nearest_matches_brute_force(spark, partitions):
    rows, df = hot_scenes(spark)
    df = df.repartition(partitions)
    got = {r["item_id"]: r["match_id"] for r in P.nearest(df.where("sensor='s1'"), df.where("sensor='s2'"), ["eid"], 5).collect()}
    want = {}
    for e, i, s, t, _ in rows:
        if s != "s1":
            continue
        near = [(abs(t - u), o, j) for f, j, z, u, o in rows if z == "s2" and f == e and abs(t - u) < timedelta(hours=5)]
        if near:
            want[i] = min(near)[2]
    assert got == want


def test_within_hours_matches_brute_force(spark):
    rows, df = hot_scenes(spark, seed=2)
    got = {r["item_id"] for r in P.within_hours(df.where("sensor='s2'"), df.where("sensor='s1'"), ["eid"], 3).collect()}
    want = {i for e, i, s, t, _ in rows if s == "s2" and any(
        z == "s1" and f == e and abs(t - u) < timedelta(hours=3) for f, _, z, u, _ in rows)}
    assert got == want


def test_exact_tolerance_is_excluded(spark):
    rows = [(0, 1, "s2", START, 0), (0, 2, "s1", START + timedelta(hours=6), 0), (0, 3, "s1", START + timedelta(hours=6, microseconds=-1), 0)]
    df = spark.createDataFrame(rows, "eid int, item_id int, sensor string, dt timestamp_ntz, ord long")
    s1, s2 = df.where("sensor='s1'"), df.where("sensor='s2'")
    assert [r["item_id"] for r in P.within_hours(s1, s2, ["eid"], 6).collect()] == [3]
    assert [r["item_id"] for r in P.nearest(s1, s2, ["eid"], 6).collect()] == [3]


def test_first_within_days_matches_brute_force(spark):
    rows, df = hot_scenes(spark, seed=3)
    got = {r["item_id"]: r["match_id"] for r in P.first_within_days(df.where("sensor='s1'"), df.where("sensor='s2'"), ["eid"], 1).collect()}
    want = {}
    for e, i, s, t, _ in rows:
        near = [(o, j) for f, j, z, u, o in rows if z == "s2" and f == e and abs(t - u).days <= 1]
        if s == "s1" and near:
            want[i] = min(near)[1]
    assert got == want


@pytest.mark.parametrize("partitions", [1, 5])
def test_running_folds_match_brute_force(spark, partitions):
    draw = random.Random(5)
    values = [(draw.randrange(2), float(v), draw.randrange(100)) for v in {draw.choice([0, 1e-9, 1, 1e9]) * draw.uniform(-1, 1) for _ in range(300)}]
    df = spark.createDataFrame(values, "k int, v double, m int").repartition(partitions)
    folds = {"s": K.Fold("sum", F.col("m")), "hi": K.Fold("max", F.col("m"), inclusive=True), "lo": K.Fold("min", F.col("m"), after=True)}
    out = K.running_folds(df, ["k"], K.value_levels(F.col("v")), F.col("v"), folds, ["s"]).collect()
    assert len(out) == len(values)
    for r in out:
        same = [x for x in values if x[0] == r["k"]]
        assert r["s"] == sum(x[2] for x in same if x[1] < r["v"])
        assert r["s_total"] == sum(x[2] for x in same)
        assert r["hi"] == max(x[2] for x in same if x[1] <= r["v"])
        after = [x[2] for x in same if x[1] > r["v"]]
        assert r["lo"] == (min(after) if after else None)


def test_medians(spark):
    draw = random.Random(6)
    values = [(k, draw.uniform(-5, 5)) for k in (1, 2) for _ in range(20 + k)] + [(3, 0.0)] * 5
    df = spark.createDataFrame(values, "k int, v double")
    for how in ("lower", "average"):
        got = {r["k"]: r["median"] for r in K.exact_median(df, ["k"], "v", how).collect()}
        for k in (1, 2, 3):
            part = sorted(v for q, v in values if q == k)
            want = part[(len(part) - 1) // 2] if how == "lower" else float(np.median(part))
            assert got[k] == pytest.approx(want)
        part = sorted(v for _, v in values)
        want = part[(len(part) - 1) // 2] if how == "lower" else float(np.median(part))
        assert K.exact_median(df, [], "v", how).first()["median"] == pytest.approx(want)


@pytest.mark.parametrize("how", ["lower", "average"])
def test_medians_of_large_keys_and_several_columns(spark, how):
    """The same medians whether keys are groups, go through buckets or some do; small keys need one shuffle and no window."""
    draw, nan = random.Random(7), float("nan")
    rows = [(k, draw.choice([None, nan, -0.5, draw.uniform(-9, 9)]), draw.choice([None, draw.uniform(0, 1)])) for k in range(12) for _ in range(4 * k)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (99, None, None), (98, None, 2.0)], "k int, a double, b double")
    read = lambda n: sorted(tuple(map(str, r)) for r in K.exact_medians(df, ["k"], ["a", "b"], how, n).collect())
    assert read(10_000) == read(15) == read(0)
    assert ("98", "None", "2.0") in read(15) and len(read(15)) == 12
    plan = K.exact_medians(df, ["k"], ["a", "b"], how)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_median_of_special_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, v) for v in (1.0, 2.0, 3.0, nan, nan, nan)] + [(2, v) for v in (-inf, -1.0, 0.0, 5e-324, inf)] + [(3, None)]
    got = {r["k"]: r["median"] for r in K.exact_median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", "lower").collect()}
    assert got == {1: 3.0, 2: 0.0}


def test_ranks_of_any_bigint(spark):
    values = [-(2 ** 63), -5, 0, 7, 2 ** 44, 2 ** 62, 2 ** 63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = K.ranked(df, [], K.integer_levels(F.col("v")), F.col("v")).orderBy("rank").collect()
    assert [r["v"] for r in got] == values and {r["rank_total"] for r in got} == {7}


def test_summaries_without_keys(spark):
    latents = spark.createDataFrame([([0.1, 2.0], [0.0, -1.0]), ([0.0, 0.5], [0.3, 0.2])], "mu array<double>, log_var array<double>")
    one = L.posterior_summary(latents).collect()
    keyed = L.posterior_summary(latents.withColumn("k", F.lit(1)), ["k"]).drop("k").collect()
    assert len(one) == 1 and one[0].asDict() == keyed[0].asDict()
    recon = spark.createDataFrame([(2.0,)], "recon double")
    row = L.elbo(recon, latents, [], 0.5).first()
    assert row["elbo"] == pytest.approx(2.0 + 0.5 * row["kld"])


def test_half_pixels_round_to_even(spark):
    pixels = spark.range(100).select(F.lit(1).alias("tile_id"), F.floor(F.col("id") / 10).cast("int").alias("r"), (F.col("id") % 10).cast("int").alias("c"), F.col("id").alias("v"))
    bounds = spark.createDataFrame([(1, 0.0, 65.0, 25.0, 100.0)], "tile_id int, west double, south double, east double, north double")
    size = R.crop(pixels, bounds, (0.0, 10.0, 100.0, -10.0), "v").agg(F.max("r") + 1, F.max("c") + 1).first()
    assert tuple(size) == (4, 2)


def test_gaps_keep_later_dry_starts(spark):
    cells = spark.createDataFrame([(t, 0, 0, 1.0) for t in (0, 1, 2, 6, 7, 8, 9)], "t int, y int, x int, precip double")
    assert sorted(r["t"] for r in E.dry_interval_starts(cells, 3, 100.0).collect()) == [0, 1, 2, 6, 7]


def test_indices_alone_see_their_input_bands(spark):
    df = spark.createDataFrame([(0, 5, 0.1), (4, 5, 0.2), (4, 5, -999999.0)], "g int, n int, i double")
    bands = {"green": (F.col("g"), None), "nir": (F.col("n"), None), "ndwi": (None, F.col("i"))}
    assert [r["m"] for r in df.select(B.selected_missing(["ndwi"], bands).alias("m")).collect()] == [True, False, True]
    with pytest.raises(ValueError, match="nir"):
        B.selected_missing(["ndwi"], {"green": bands["green"], "ndwi": bands["ndwi"]})


def test_events_without_files_and_files_without_crs(spark):
    files = spark.createDataFrame([("a", "x_1", 4)], "eid string, name string, size_bytes long")
    got = {r["eid"]: (r["missing"], r["complete"]) for r in C.missing_files(files, {"X": "x_"}, spark.createDataFrame([("a",), ("b",)], "eid string")).collect()}
    assert got == {"a": ([], True), "b": (["X"], False)}
    rasters = spark.createDataFrame([("e", "f1", 4, 4, "EPSG:1", [1.0] * 6), ("e", "f2", 4, 4, None, [1.0] * 6)], "eid string, name string, h int, w int, crs string, transform array<double>")
    assert C.inconsistent_rasters(rasters).first()["reason"] == "crs"


def average_precision(rows):
    total = sum(t for _, t in rows)
    area, tp, n = 0.0, 0, 0
    for s in sorted({p for p, _ in rows}, reverse=True):
        here = [t for p, t in rows if p == s]
        tp, n = tp + sum(here), n + len(here)
        area += sum(here) / total * tp / n
    return area


def test_auprc_ignores_row_order_and_concentration(spark):
    draw = random.Random(7)
    scores = [1e-12 * draw.random() if i % 3 else draw.choice([0.0, 0.5, 1.0, draw.random()]) for i in range(500)]
    rows = [(s, int(draw.random() < 0.3)) for s in scores]
    want = average_precision(rows)
    for seed, parts in ((1, 1), (2, 6)):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, "prob double, target int").repartition(parts)
        assert M.auprc(df).first()["auprc"] == pytest.approx(want, abs=1e-12)
    empty = spark.createDataFrame([(0.5, 0)], "prob double, target int")
    assert M.auprc(empty).first()["auprc"] is None


def test_moments_do_not_depend_on_partitioning(spark):
    base = spark.range(1000).select((F.col("id") * 37 % 101).cast("double").alias("a"), (F.col("id") % 7 != 0).alias("ok"))
    rows = [T.masked_moments(base.repartition(n), ["a"], F.col("ok")).first() for n in (1, 9)]
    assert rows[0]["mean"] == pytest.approx(rows[1]["mean"]) and rows[0]["std"] == pytest.approx(rows[1]["std"])
    lone = T.masked_moments(base.limit(1), ["a"], F.lit(True)).first()
    assert lone["std"] == 1.0
    none = T.masked_moments(base.where("a < 0"), ["a"], F.lit(True)).first()
    assert none["min"] == float("inf") and none["max"] == float("-inf") and none["n"] == 0


def test_group_counts_are_sums_of_classes(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 1000 / 1000).alias("prob"), (F.col("id") % 3 == 0).cast("int").alias("target"),
                                  F.element_at(F.array(*[F.lit(c) for c in (11, 21, 22, 41, 95)]), (F.col("id") % 5 + 1).cast("int")).alias("nlcd"))
    per_class = M.confusion_by_class(df, "nlcd").collect()
    assert len(per_class) == 20
    assert sum(r["tn"] + r["fp"] + r["fn"] + r["tp"] for r in per_class) == 2000
    absent = [r for r in per_class if r["code"] == 12][0]
    assert (absent["tn"], absent["fp"], absent["fn"], absent["tp"]) == (0, 0, 0, 0)
    urban = M.confusion_by_group(df, "nlcd").where("class_group = 'urban'").first()
    assert urban["tp"] == sum(r["tp"] for r in per_class if r["code"] in (21, 22, 23, 24))
    ice = M.confusion_by_group(df, "nlcd").where("class_group = 'ice/snow'").first()
    assert ice["acc"] is None and ice["f1"] is None


def test_strided_windows_cover_and_stay_inside(spark):
    for length, size, stride in ((400, 68, 68), (10, 3, 4), (8, 8, 5)):
        tiles = spark.createDataFrame([(0, length, length)], "tile_id long, h int, w int")
        starts = sorted({r["x0"] for r in G.strided_positions(tiles, size, stride).collect()})
        assert starts[-1] == length - size and starts[0] == 0
        if stride <= size:
            assert all(any(s <= p < s + size for s in starts) for p in range(length))
    assert sorted({r["x0"] for r in G.strided_positions(spark.createDataFrame([(0, 400, 400)], "tile_id long, h int, w int"), 68, 68).collect()}) == [0, 68, 136, 204, 272, 332]


def test_small_tile_is_an_error(spark):
    tiles = spark.createDataFrame([(5, 10, 70)], "tile_id long, h int, w int")
    with pytest.raises(Exception, match="no patch of"):
        G.strided_positions(tiles, 64, 64).collect()
    assert G.too_small(tiles, 64).count() == 1


@pytest.mark.parametrize("drop_last", [True, False])
def test_shard_sizes(spark, drop_last):
    n, k = 103, 8
    rows = spark.range(n).withColumn("p", F.col("id") * 1_000_003 + 17)
    sizes = {r["shard"]: r["count"] for r in G.shards(rows, "p", k, n, drop_last).groupBy("shard").count().collect()}
    want = [n // k + (0 if drop_last else int(i < n % k)) for i in range(k)]
    assert [sizes[i] for i in range(k)] == want
    with pytest.raises(ValueError):
        G.shards(rows, "p", 0, n, drop_last)
    with pytest.raises(ValueError):
        G.shards(rows, "p", n + 1, n, drop_last)


def test_split_is_complete_disjoint_and_stable(spark):
    events = spark.range(500).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("eid"))
    runs = [{r["eid"]: r["split"] for r in G.random_split(events.repartition(n), "eid", 0.1, 0.2, 4).collect()} for n in (1, 6)]
    assert runs[0] == runs[1] and len(runs[0]) == 500
    sizes = {s: sum(v == s for v in runs[0].values()) for s in ("train", "val", "test")}
    held = int(np.ceil(500 * (0.1 + 0.2)))
    tests = int(np.ceil(held * (0.2 / (0.1 + 0.2))))
    assert sizes == {"train": 500 - held, "val": held - tests, "test": tests}
    with pytest.raises(ValueError):
        G.random_split(events, "eid", 0.6, 0.5, 4)


def test_wet_dry_quotas(spark):
    for wet_every, want_wet in ((10, 40), (1000000, None), (1, None)):
        df = spark.range(1, 301).select(F.col("id"), (F.col("id") % wet_every == 0).alias("wet"))
        out = G.wet_dry_sample(df, "id", "wet", 100, 0.4, 3)
        assert out.count() == 100
        if want_wet:
            assert out.where("wet").count() == want_wet
            taken = {r["id"] for r in out.where("wet").collect()}
            assert taken == {i for i in range(1, 301) if i % 10 == 0}


def test_random_patches_stop_at_the_quota(spark):
    flags = [1 if (i // 20) < 10 else 0 for i in range(400)]
    tiles = spark.createDataFrame([(0, 20, 20, flags, [0] * 400), (1, 20, 20, [1] * 400, [0] * 400)], "tile_id long, h int, w int, m array<int>, c array<int>")
    out = G.random_patches(tiles, 5, 6, 9, "m", "c", 0.0, 0.0, 500).collect()
    assert len([r for r in out if r["tile_id"] == 0]) == 6
    assert all(r["x0"] >= 10 for r in out) and all(r["tile_id"] == 0 for r in out)


def test_short_tiles_fail_in_the_strict_draw(spark):
    tiles = spark.createDataFrame([(1, 20, 20, [1] * 400, [0] * 400)], "tile_id long, h int, w int, m array<int>, c array<int>")
    with pytest.raises(Exception, match="too few patches"):
        G.random_patches(tiles, 5, 6, 9, "m", "c", 0.0, 0.0, 50, strict=True).collect()


def test_patches_of_a_tile_of_real_size(spark):
    from tilerain.plans.patch_plan import patches
    n = 400 * 400
    value = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: (p % 9973).cast("float"))
    tiles = spark.range(1).select(
        F.col("id").alias("tile_id"), F.lit("train").alias("split"), F.lit(400).alias("h"), F.lit(400).alias("w"), value.alias("vv"),
        value.alias("vh"), F.array_repeat(F.lit(1), n).alias("red"), F.array_repeat(F.lit(4), n).alias("scl"),
        *[value.alias(f"b{i}") for i in range(14)])
    out = patches(tiles, ["vv", "vh", *[f"b{i}" for i in range(14)]], 64, "strided", stride=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    got = out.select("x0", "y0", F.size("channels").alias("k"), F.element_at(F.col("channels")["b13"], -1).alias("last")).collect()
    assert len({(r["x0"], r["y0"]) for r in got}) == len(got) == 43 * 43
    assert all(r["k"] == 16 and r["last"] == ((r["x0"] + 63) * 400 + r["y0"] + 63) % 9973 for r in got)


def test_cut_windows_keep_nulls_and_skip_tiles_without_spots(spark):
    rows = [(1, 2, 3, [1, None, 3, 4, 5, 6], [(0, 0), (0, 1)]), (2, 2, 3, [0] * 6, []), (3, 2, 3, [0] * 6, None)]
    tiles = spark.createDataFrame(rows, "tile_id long, h int, w int, v array<int>, spots array<struct<x0:int,y0:int>>")
    got = sorted(tuple(r) for r in G.cut_windows(tiles, ["v"], 2).collect())
    assert got == [(1, 0, 0, [1, None, 4, 5]), (1, 0, 1, [None, 3, 5, 6])]


def test_fixed_patches_by_missing_share(spark):
    stack = spark.createDataFrame([(0, 0, 4, 4, [1] * 8 + [0] * 8)], "y int, x int, h int, w int, m array<int>")
    spots = spark.createDataFrame([(0, 0, i, 0) for i in range(4)], "y int, x int, i int, j int")
    assert sorted(r["i"] for r in G.fixed_patches(stack, spots, 2, "m", 0.5).collect()) == [1, 2]


def test_fixed_patches_join_corners_without_lists(spark):
    """Equal corners each count, unusable sizes and corners drop out, arrays stay behind, and no list of a cell's corners is built."""
    stacks = spark.createDataFrame([(1, 0, 0, 4, 5, [7]), (2, 0, 0, 3, 5, [7]), (3, 0, 1, 9, 9, [7]), (4, 0, 0, None, 5, [7]), (5, None, 0, 9, 9, [7])],
                                   "stack int, y int, x int, h int, w int, m array<int>")
    spots = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 2, 3), (0, 0, 2, 3), (0, 0, 2, 4), (0, 0, None, 0), (None, 0, 0, 0), (1, 0, 0, 0)], "y int, x int, i int, j int")
    out = G.fixed_patches(stacks, spots, 2)
    assert out.columns == ["stack", "y", "x", "h", "w", "i", "j"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 0, 4, 5, 0, 0), (1, 0, 0, 4, 5, 2, 3), (1, 0, 0, 4, 5, 2, 3), (2, 0, 0, 3, 5, 0, 0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Generate" not in plan


@pytest.mark.parametrize("listed", [10_000, 0])
def test_fixed_patches_deal_crowded_cells(spark, monkeypatch, listed):
    """A crowded cell's stacks meet its corners in several tasks, and cells aren't put together by the few bytes they have."""
    monkeypatch.setattr(G, "PART_STACKS", 20, raising=False)
    monkeypatch.setattr(G, "BROADCAST_CELLS", listed, raising=False)
    cells = [(0, 0, 4 + k % 3, k) for k in range(200)] + [(y, 1, 5, 200 + y) for y in range(40)] + [(None, 0, 9, 300 + k) for k in range(30)]
    held = [(y, x, h, None if k % 50 == 7 else 6, k) for y, x, h, k in cells] + [(0, 0, 6, 6, 0)] * 2
    corners = [(0, 0, i, j) for i in range(6) for j in (0, 4)] + [(0, 0, 1, 1)] * 2 + [(y, 1, 3, 0) for y in range(0, 40, 2)] + [(None, 0, 0, 0), (7, 7, 0, 0)]
    stacks = spark.createDataFrame(held, "y int, x int, h int, w int, stack long")
    spots = spark.createDataFrame(corners, "y int, x int, i int, j int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = G.fixed_patches(stacks, spots, 2).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wanted = [(y, x, h, w, k, i, j) for y, x, h, w, k in held for b, a, i, j in corners
              if y is not None and w is not None and (y, x) == (b, a) and i + 2 <= h and j + 2 <= w]
    assert sorted(tuple(r)[:-1] for r in found) == sorted(wanted)
    assert len({r["task"] for r in found if r["x"] == 0}) > 1 and len({r["task"] for r in found if r["x"] == 1}) > 1


def test_random_draws_do_not_depend_on_partitioning(spark):
    cells = spark.range(400).select((F.col("id") % 20).cast("int").alias("y"), F.floor(F.col("id") / 20).cast("int").alias("x"), F.lit(0).alias("t"), F.lit(1.0).alias("precip"))
    pool = E.valid_cells(cells)
    runs = [sorted((r["t"], r["y"], r["x"]) for r in E.random_events(pool.repartition(n), cells, 30, 25, 8).collect()) for n in (1, 6)]
    assert runs[0] == runs[1] and len(set((y, x) for _, y, x in runs[0])) == 25


def test_missing_rain_counts_as_dry(spark):
    rows = [(t, 0, 0, None if t in (3, 4) else 500.0 if t == 7 else 1.0) for t in range(12)]
    cells = spark.createDataFrame(rows, "t int, y int, x int, precip double")
    starts = sorted(r["t"] for r in E.dry_interval_starts(cells, 3, 100.0, 1).collect())
    want = [i for i in range(12 - 3 + 1) if all(not (rows[j][3] is not None and rows[j][3] >= 100) for j in range(max(0, i - 1), i + 3))]
    assert starts == want
    assert sorted(r["t"] for r in E.dry_interval_starts(cells, 3, None).collect()) == list(range(9))


def test_early_stopping_matches_loop(spark):
    draw = random.Random(10)
    losses = [round(draw.uniform(0, 1), 2) for _ in range(40)]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(losses)], "run int, epoch int, loss double")
    got = {r["epoch"]: (r["counter"], r["best_epoch"], r["stopped"]) for r in M.early_stopping(df, 4, 0.1).collect()}
    best, counter, epoch, stopped = float("inf"), 0, 0, False
    for i, v in enumerate(losses):
        if v < best:
            best, counter, epoch = v, 0, i
        elif v > best + 0.1:
            counter += 1
        stopped = stopped or counter >= 4
        assert got[i] == (counter, epoch, stopped)


@pytest.mark.parametrize("size", [1, 2, 7, 8, 64])
@pytest.mark.parametrize("kind", ["hash", "mix"])
def test_permutations_need_no_table(size, kind):
    runs = [G.permutation(size, seed, kind) for seed in range(20)]
    assert all(sorted(run.tolist()) == list(range(size * size)) for run in runs)
    if size > 6:
        assert len({run.tobytes() for run in runs}) == 20
        assert all(abs(np.corrcoef(run, np.arange(size * size))[0, 1]) < 0.5 for run in runs)


def test_one_channel_is_permuted_and_the_rest_stays(spark):
    rows = [(i, [float(k) for k in range(9)] if i else None, [k * 10 + i if k != 4 else None for k in range(9)]) for i in range(5)]
    patches = spark.createDataFrame(rows, "id int, a array<double>, b array<int>").repartition(3)
    order = G.permutation(3, 4).tolist()
    got = {r["id"]: r for r in G.permute_channels(patches, ["a", "b"], 3, 4).collect()}
    assert all(got[i]["a"] == (a and [a[k] for k in order]) and got[i]["b"] == [b[k] for k in order] for i, a, b in rows)
    runs = G.permutation_runs(patches, {"first": "a", "second": "b"}, 3, 4)
    assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")
    seen = {(r["id"], r["channel"]): (r["a"], r["b"]) for r in runs.collect()}
    for i, a, b in rows:
        assert seen[i, "none"] == (a, b) and seen[i, "first"] == (a and [a[k] for k in order], b) and seen[i, "second"] == (a, [b[k] for k in order])
    with pytest.raises(Exception, match="not the 16 values"):
        G.permute_channels(patches, ["b"], 4, 1).collect()


def test_holes_and_shape_conflicts_fail(spark):
    px = spark.createDataFrame([(1, r, c, 1.0) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(2, 0, 0, 5.0)], "tile_id int, r int, c int, v double")
    assert [tuple(r) for r in C.collected(px.where("tile_id = 2"), "v").collect()] == [(2, 1, 1, [5.0])]
    for bad in (px, px.where("tile_id = 2").union(px.where("tile_id = 2"))):
        with pytest.raises(Exception, match="not one value for each pixel"):
            C.collected(bad, "v").collect()
    rows = spark.createDataFrame([(1, "vv", 1, 2, [1.0, 2.0]), (1, "vh", 2, 1, [1.0, 2.0]), (2, "vv", 1, 1, [3.0])], "tile_id int, channel string, h int, w int, data array<double>")
    assert C.stacked(rows.where("tile_id = 2"), ["vv", "vh"]).count() == 0
    with pytest.raises(Exception, match="different shapes"):
        C.stacked(rows, ["vv", "vh"]).collect()


def test_draws_in_chunks_equal_all_draws(spark):
    draw = random.Random(7)
    rows = [(i, 12, 12, [int(draw.random() < share) for _ in range(144)], [0] * 144) for i, share in enumerate([0.0, 0.1, 0.3, 0.6, 1.0])]
    tiles = spark.createDataFrame(rows, "tile_id long, h int, w int, miss array<int>, cloud array<int>")

    def found(samples, attempts):
        return {r["tile_id"]: [tuple(s) for s in r["spots"]] for r in G.random_spots(tiles, 4, samples, 3, "miss", "cloud", 0.2, 0.2, attempts).collect()}
    every, few = found(10 ** 6, 700), found(5, 700)
    assert all(few[i] == every[i][:5] for i in every) and len(every[0]) == 700 and not every[4]
    assert all([s[0] for s in v] == sorted(s[0] for s in v) for v in every.values()) and any(0 < len(v) < 700 for v in every.values())
