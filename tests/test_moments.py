"""Statistics kept between runs against one pass over all rows."""

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilerain.operators import moments as P
from tilerain.operators import stats as S


def _pixels(spark, n=3000, seed=5):
    rng = random.Random(seed)
    rows = [(i % 7, None if i % 11 == 0 else rng.gauss(1e6 * (i % 7), 0.5), float(i % 2), i % 13 != 0) for i in range(n)]
    return spark.createDataFrame(rows, "event int, vv double, label double, ok boolean")


def test_parts_merge_to_the_full_pass(spark, tmp_path):
    px, path = _pixels(spark), str(tmp_path / "state")
    assert P.merged_moments(P.state(spark, path)).collect() == []
    for events in ((0, 1, 2), (3,), (4, 5, 6)):
        P.update_state(P.partial_moments(px.where(F.col("event").isin(*events)), "event", ["vv", "label"], F.col("ok")), path)
    got = {r.channel: r for r in P.final_moments(P.merged_moments(P.state(spark, path)), ["label"]).collect()}
    values = np.array([r.vv for r in px.collect() if r.ok and r.vv is not None])
    assert got["vv"].n == len(values)
    assert got["vv"].mean == pytest.approx(values.mean(), rel=1e-12) and got["vv"].std == pytest.approx(values.std(ddof=1), rel=1e-12)
    assert (got["vv"].min, got["vv"].max) == (values.min(), values.max())
    assert (got["label"].mean, got["label"].std) == (0.0, 1.0)


def test_a_part_written_again_is_replaced(spark, tmp_path):
    px, path = _pixels(spark), str(tmp_path / "state")
    P.update_state(P.partial_moments(px, "event", ["vv"], F.col("ok")), path)
    before = P.merged_moments(P.state(spark, path)).collect()
    P.update_state(P.partial_moments(px.where("event = 3"), "event", ["vv"], F.col("ok")), path)
    assert P.merged_moments(P.state(spark, path)).collect()[0].n == before[0].n
    fresh = px.where("event = 3").withColumn("vv", F.lit(2.0))
    P.update_state(P.partial_moments(fresh, "event", ["vv"], F.lit(True)), path)
    want = px.where("event <> 3 AND ok").select("vv").unionByName(fresh.select("vv")).agg(F.count("vv"), F.avg("vv"), F.var_pop("vv")).first()
    got = P.merged_moments(P.state(spark, path)).first()
    assert got.n == want[0] and got.mean == pytest.approx(want[1], rel=1e-12) and got.m2 / got.n == pytest.approx(want[2], rel=1e-12)
    assert P.open_parts(px.withColumn("event", F.col("event") + 5), "event", spark, path).select("event").distinct().count() == 5


def test_far_means_and_order_of_merging(spark):
    """Small spread around 6e6: differences of squares would lose it."""
    parts = P.partial_moments(_pixels(spark).where("event >= 5"), "event", ["vv"], F.col("ok")).withColumn("half", F.col("part"))
    one = P.merged_moments(parts, ["half"]).withColumn("part", F.col("half"))
    direct, stepped = P.merged_moments(parts).first(), P.merged_moments(one).first()
    assert direct.n == stepped.n and direct.m2 == pytest.approx(stepped.m2, rel=1e-12)
    for r in one.collect():
        assert math.sqrt(r.m2 / r.n) == pytest.approx(0.5, rel=0.1)


def test_empty_parts_and_same_form_as_the_full_pass(spark):
    px = _pixels(spark)
    none = P.partial_moments(px.where("event = 1"), "event", ["vv", "label"], F.lit(False))
    some = P.partial_moments(px.where("event = 2"), "event", ["vv", "label"], F.col("ok"))
    empty = {r.channel: r for r in P.final_moments(P.merged_moments(none)).collect()}
    assert (empty["vv"].n, empty["vv"].mean, empty["vv"].std, empty["vv"].min, empty["vv"].max) == (0, 0.0, 1.0, math.inf, -math.inf)
    both = P.final_moments(P.merged_moments(none.unionByName(some))).orderBy("channel").collect()
    assert both == P.final_moments(P.merged_moments(some)).orderBy("channel").collect()
    full = {r.channel: r for r in S.masked_moments(px.where("event = 2 AND vv IS NOT NULL"), ["vv", "label"], F.col("ok")).collect()}
    kept = P.partial_moments(px.where("event = 2 AND vv IS NOT NULL"), "event", ["vv", "label"], F.col("ok"))
    for r in P.final_moments(P.merged_moments(kept)).collect():
        assert (r.n, r.min, r.max) == (full[r.channel].n, full[r.channel].min, full[r.channel].max)
        assert r.mean == pytest.approx(full[r.channel].mean) and r.std == pytest.approx(full[r.channel].std)


def test_parts_named_like_numbers_stay_text(spark, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    px = spark.createDataFrame([("007", 1.0), ("7", 2.0), (None, 3.0)], "eid string, vv double")
    P.update_state(P.partial_moments(px, "eid", ["vv"], F.lit(True)), path)
    assert {r.part for r in P.state(spark, path).collect()} == {"007", "7", None}
    assert P.merged_moments(P.state(spark, path)).first().n == 3
