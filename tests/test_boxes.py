"""Box joins against all pairs: sizes from points to the globe, crowded squares, unusable boxes, further keys."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tilerain.operators import boxes as B
from tilerain.operators import scenes as S
from tilerain.schema import BBOX, SCENE


def frame(spark, rows, key, box):
    return spark.createDataFrame(rows, f"{key} int, day int, a double, b double, c double, d double").select(
        key, "day", F.struct(F.col("a").alias("minx"), F.col("b").alias("miny"), F.col("c").alias("maxx"), F.col("d").alias("maxy")).alias(box))


def drawn(rng, n, sizes, days=1, corner=None):
    out = []
    for i in range(n):
        x, y = corner(rng) if corner else (rng.choice([rng.uniform(-3, 3), float(rng.randrange(-3, 4))]), rng.uniform(-3, 3))
        s = rng.choice(sizes)
        out.append((i, rng.randrange(days), x, y, x + s * rng.choice([0.0, 0.5, 1.0]), y + s * rng.random()))
    return out


def pairs(left, right, strict, on=False):
    def meet(p, q):
        if strict:
            return p[2] < q[4] and p[4] > q[2] and p[3] < q[5] and p[5] > q[3]
        return p[2] <= q[4] and p[4] >= q[2] and p[3] <= q[5] and p[5] >= q[3]
    return sorted((p[0], q[0]) for p in left for q in right if meet(p, q) and (not on or p[1] == q[1]))


def joined(spark, left, right, strict, part_rows=B.PART_ROWS, on=()):
    out = B.box_overlap(frame(spark, left, "i", "bbox"), frame(spark, right, "j", "box").drop(*([] if on else ["day"])), strict, on, part_rows=part_rows)
    return sorted((r["i"], r["j"]) for r in out.select("i", "j").collect())


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("part_rows", [4096, 7])
def test_pairs_of_all_sizes(spark, strict, part_rows):
    rng = random.Random(9)
    left, right = drawn(rng, 70, [0.0, 1e-7, 0.01, 0.5, 4.0, 300.0]), drawn(rng, 60, [0.0, 0.25, 1.0, 60.0])
    assert joined(spark, left, right, strict, part_rows) == pairs(left, right, strict)


def test_further_keys_and_unusable_boxes(spark):
    rng = random.Random(4)
    left, right = drawn(rng, 60, [0.5, 2.0], days=3), drawn(rng, 60, [0.5, 2.0], days=3)
    want = pairs(left, right, False, on=True)
    odd = [(900, 0, None, 0.0, 1.0, 1.0), (901, 0, math.nan, -9.0, 9.0, 9.0), (902, 0, -math.inf, -9.0, math.inf, 9.0), (903, 0, 9.0, 9.0, -9.0, -9.0)]
    assert joined(spark, left + odd, right + odd, False, on=["day"]) == want
    assert joined(spark, left + odd, right, False, part_rows=3, on=["day"]) == want


@pytest.mark.parametrize("left, right", [([], [(1, 0, 0.0, 0.0, 1.0, 1.0)]), ([(1, 0, 0.0, 0.0, 1.0, 1.0)], []), ([], [])])
def test_empty_sides(spark, left, right):
    assert joined(spark, left, right, False) == []


def test_crowded_square_is_dealt_evenly(spark):
    """90 % of the boxes of both sides lie in one square; no part of a join holds over twice the rows of the median part."""
    rng = random.Random(5)
    crowd = lambda r: (r.uniform(0.1, 0.4), r.uniform(0.1, 0.4)) if r.random() < 0.9 else (r.uniform(-40, 40), r.uniform(-40, 40))
    left, right = drawn(rng, 3000, [0.4], corner=crowd), drawn(rng, 600, [0.4], corner=crowd)
    a, b = B._levelled(frame(spark, left, "i", "bbox"), "bbox", B.FINEST), B._levelled(frame(spark, right, "j", "box").drop("day"), "box", B.FINEST)
    mine, theirs = B._levels(a, b)
    rows = [B._listed(a, "bbox", mine, theirs, 0, True), B._listed(b, "box", theirs, mine, 1, False)]
    hot = B._hot_squares(*rows, B._SQUARE, 100)
    dealt = [B._dealt(df, hot, B._SQUARE, own, other, [key, box])
             for df, own, other, key, box in zip(rows, "pq", "qp", "ij", ("bbox", "box"))]
    assert hot is not None and hot.agg(F.max("_p")).first()[0] > 10
    for df in dealt:
        crowded = df.join(hot, B._SQUARE).where("_p > 10 AND _q > 2")
        sizes = sorted(r["count"] for r in crowded.groupBy(*B._SQUARE, "_i", "_j").count().collect())
        assert len(sizes) > 30 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert joined(spark, left, right, False, part_rows=100) == pairs(left, right, False)


def test_a_visitor_never_meets_a_visitor(spark):
    """Small boxes of both sides under one large box of each: they meet on their own level, not all with all on the large one's."""
    small = [(i, 0, i / 100, 0.0, i / 100 + 0.005, 0.005) for i in range(400)]
    large = [(1000, 0, -50.0, -50.0, 50.0, 50.0)]
    a, b = frame(spark, small + large, "i", "bbox"), frame(spark, small + large, "j", "box").drop("day")
    a, b = B._levelled(a, "bbox", B.FINEST), B._levelled(b, "box", B.FINEST)
    mine, theirs = B._levels(a, b)
    met = B._listed(a, "bbox", mine, theirs, 0, True).join(B._listed(b, "box", theirs, mine, 1, False), B._SQUARE).count()
    assert met < 400 * 30
    assert joined(spark, small + large, small + large, False) == pairs(small + large, small + large, False)


def test_event_search_by_box_day_and_mode(spark):
    rng = random.Random(3)
    first = date(2024, 1, 1)
    events = [(f"e{i}", first + timedelta(rng.randrange(20)), *(lambda x, y: (x, y, x + 0.25, y + 0.25))(rng.uniform(0, 5), rng.uniform(0, 5))) for i in range(40)]
    scenes = []
    for i in range(300):
        x, y = rng.uniform(-1, 5), rng.uniform(-1, 5)
        box = (x, y, x + 1.2, y + 1.2) if i % 50 else (None, y, x + 1, y + 1)
        mode = rng.choice(["IW", "EW", None])
        scenes.append((f"s{i}", rng.choice(["s1", "s2", "other"]), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(26 * 24), microseconds=rng.choice([0, -1])),
                       "EPSG:32615", box, {} if mode is None else {"sar:instrument_mode": mode}, {}, i))
    ev = spark.createDataFrame([(e, d, b) for e, d, *b in events], "eid string, event_date date, bbox struct<minx:double,miny:double,maxx:double,maxy:double>")
    assert ev.schema["bbox"].dataType == BBOX
    got = sorted((r["eid"], r["item_id"]) for r in S.search_events(ev, spark.createDataFrame(scenes, SCENE), 2, 3, 30).collect())
    want = []
    for eid, day, *e in events:
        for item, sensor, dt, _, s, props, _, _ in scenes:
            reach = {"s2": 3, "s1": 5}.get(sensor)
            if (reach is not None and None not in s and (sensor == "s2" or props.get("sar:instrument_mode") == "IW")
                    and day - timedelta(2) <= dt.date() <= day + timedelta(reach)
                    and s[0] <= e[2] and s[2] >= e[0] and s[1] <= e[3] and s[3] >= e[1]):
                want.append((eid, item))
    assert got == sorted(want) and len(want) > 50
    none = S.search_events(ev, spark.createDataFrame(scenes, SCENE), 2, 3, where={"s1": {"sar:instrument_mode": ("eq", "XX")}})
    assert none.count() == 0


@pytest.mark.parametrize("part_rows, slab_rows", [(1 << 18, 1 << 16), (40, 20), (7, 100), (1000, 3)])
def test_overlap_totals_equal_all_pairs(spark, part_rows, slab_rows):
    rng = random.Random(part_rows)
    left = drawn(rng, 150, [0.0, 0.25, 1.0, 4.0]) + drawn(rng, 60, [0.0, 0.5], corner=lambda r: (1.0, 2.0))
    right = drawn(rng, 130, [0.0, 0.25, 1.0, 7.0]) + drawn(rng, 50, [0.0, 0.5], corner=lambda r: (1.0, float(r.randrange(3))))
    for bad in ((None, 0.0, 1.0, 1.0), (0.0, 0.0, math.inf, 1.0), (1.0, 0.0, -1.0, 1.0), (math.nan, 0.0, 1.0, 1.0)):
        left.append((900, 0, *bad))
        right.append((901, 0, *bad))
    big = {i: rng.choice([None, (1 << 62) - i, -(1 << 62) + i, i]) for i in range(130)}  # sums of all overflow
    asked = frame(spark, left, "i", "bbox").select((F.col("i") % 90).alias("eid"), "bbox")
    held = frame(spark, right, "j", "box").join(spark.createDataFrame(list(big.items()), "j int, v long"), "j", "left")
    pairs = B.box_overlap(asked, held, strict=False).groupBy("eid").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    want = {r.eid: (r.n, None if r.s is None else int(r.s)) for r in pairs}
    small = held.withColumn("v", F.when(F.abs("v") > 1000, F.floor(F.col("v") / 1000000)).otherwise(F.col("v")))
    want_small = {r.eid: (r.n, r.s) for r in B.box_overlap(asked, small, strict=False).groupBy("eid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()}
    got = {r.eid: (r.n, r.total) for r in B.overlap_totals(asked, small, ["eid"], "v", part_rows, slab_rows).collect()}
    assert got == want_small and len(got) > 50
    fits = [e for e, (_, s) in want.items() if s is None or abs(s) < 1 << 63]
    some = asked.where(F.col("eid").isin(fits))
    assert {r.eid: (r.n, r.total) for r in B.overlap_totals(some, held, ["eid"], "v", part_rows, slab_rows).collect()} == {e: want[e] for e in fits}


def test_overlap_totals_make_no_pairs(spark):
    """4,000 x 4,000 boxes of one square: the rows of the plan grow with the boxes, not with their 16 million pairs."""
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("minx", 0.0), ("miny", 0.0), ("maxx", 1.0), ("maxy", 1.0))])
    ids = spark.range(4000)
    found = B.box_overlap(ids.select("id", box.alias("bbox")), ids.select(F.col("id").alias("v"), box.alias("box")), False, per=["id"], total="v")
    assert found.agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.min("total"), F.max("total")).first() == (4000, 4000, 4000, 7998000, 7998000)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    empty = ids.select("id", box.alias("bbox")).limit(0)
    assert not B.overlap_totals(empty, ids.select(F.col("id").alias("v"), box.alias("box")), ["id"], "v").collect()
    with pytest.raises(ValueError):
        B.box_overlap(empty, ids.select(box.alias("box")), True, per=["id"], total="id")
