"""Registered queries on patches, sampling, shards, windows and blending."""

from pyspark.sql import functions as F

from tilerain.operators import neighborhood as N
from tilerain.operators import patches as G
from tilerain.operators import scoring as W
from tilerain.operators import stacking as K
from tilerain.plans import fixtures as X
from tilerain.plans.registry import query, r6, rounded

MIX = "(({k})::bigint*2654435761) % 4294967296"
POS = ", ps AS (SELECT unnest([0,2,4,5]) x0), qs AS (SELECT unnest([0,2,4,5]) y0)"


def _flag_tiles(spark, sf):
    """8 x 8 tiles with a missing flag and a cloud flag array."""
    tiles = X.tile(spark, sf)
    dn = lambda v: F.floor((v + 1) * 5000).cast("int")
    return tiles.withColumns({
        "missing": F.transform(F.col("data"), lambda v, p: F.when((F.col("tile_id") * 64 + p) % 29 == 0, 1).otherwise(0)),
        "clouds": F.transform(F.col("data"), lambda v: F.when((dn(v) % 12).isin(8, 9), 1).otherwise(0))})


FLAGS = ", fl AS (SELECT tile_id, r, c, CASE WHEN (tile_id*64+pos) % 29 = 0 THEN 1 ELSE 0 END ms, CASE WHEN scl IN (8,9) THEN 1 ELSE 0 END cl, v FROM pixel_ext)"


@query("strided_positions", ", t AS (SELECT vec_id tile_id FROM embeddings), ps AS (SELECT unnest([0,2,4,5]) x0), qs AS (SELECT unnest([0,2,4,5]) y0) SELECT tile_id, x0, y0 FROM t CROSS JOIN ps CROSS JOIN qs".replace(", t AS", "WITH t AS", 1))
def strided_positions(spark, sf):
    return G.strided_positions(X.tile(spark, sf).select("tile_id", "h", "w"), 3, 2).drop("h", "w")


@query("strided_patches", FLAGS + POS + """ SELECT tile_id, x0, y0 FROM fl, ps, qs WHERE r BETWEEN x0 AND x0+2 AND c BETWEEN y0 AND y0+2
GROUP BY ALL HAVING sum(ms)/9.0::double <= 0.12 AND sum(cl)/9.0::double <= 0.2""", "pixel_ext")
def strided_patches(spark, sf):
    return G.strided_patches(_flag_tiles(spark, sf), 3, 2, "missing", "clouds", 0.12, 0.2).select("tile_id", "x0", "y0")


@query("patch_pixels", FLAGS + POS + """, ok AS (SELECT tile_id, x0, y0 FROM fl, ps, qs WHERE r BETWEEN x0 AND x0+2 AND c BETWEEN y0 AND y0+2 GROUP BY ALL HAVING sum(ms) = 0 AND sum(cl)/9.0::double <= 0.2)
SELECT ok.tile_id, x0, y0, cast((r-x0)*3 + c-y0 AS int) pos, v FROM ok JOIN fl ON fl.tile_id=ok.tile_id AND r BETWEEN x0 AND x0+2 AND c BETWEEN y0 AND y0+2""", "pixel_ext")
def patch_pixels(spark, sf):
    kept = G.cut_windows(G.strided_spots(_flag_tiles(spark, sf), 3, 2, "missing", "clouds", 0.0, 0.2), ["data"], 3)
    return kept.select("tile_id", "x0", "y0", F.posexplode("data").alias("pos", "v"))


@query("random_patches", FLAGS + f""", tries AS (SELECT vec_id tile_id, cast(k AS int) attempt, cast(floor({MIX.format(k='vec_id*1000 + k + 21')}*5/4294967296.0::double) AS int) x0, cast(floor({MIX.format(k='vec_id*1000 + k + 22')}*5/4294967296.0::double) AS int) y0 FROM embeddings, (SELECT range k FROM range(1, 20001))),
ok AS (SELECT tile_id, x0, y0 FROM fl, (SELECT unnest(range(5)) x0), (SELECT unnest(range(5)) y0) WHERE r BETWEEN x0 AND x0+2 AND c BETWEEN y0 AND y0+2 GROUP BY ALL HAVING sum(ms) = 0 AND sum(cl)/9.0::double <= 0.25),
ta AS (SELECT t.* FROM tries t JOIN ok ON ok.tile_id=t.tile_id AND ok.x0=t.x0 AND ok.y0=t.y0)
SELECT tile_id, attempt, x0, y0 FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY attempt) rn FROM ta) WHERE rn <= 4""", "pixel_ext")
def random_patches(spark, sf):
    return G.random_patches(_flag_tiles(spark, sf), 3, 4, 21, "missing", "clouds", 0.0, 0.25, kind="mix").select("tile_id", "attempt", "x0", "y0")


@query("grid_patches", "SELECT tile_id, r//4 br, c//4 bc, count(*) n FROM pixel_ext GROUP BY ALL HAVING count(*) = 16 AND NOT bool_or(vv_db = -9999)", "pixel_ext")
def grid_patches(spark, sf):
    return G.grid_patches(X.pixel_ext(spark, sf), 4, F.col("vv_db") == -9999.0)


@query("complete_patches", "SELECT tile_id FROM pixel_ext GROUP BY 1 HAVING NOT bool_or(b04 < 20)", "pixel_ext")
def complete_patches(spark, sf):
    return G.no_missing(X.pixel_ext(spark, sf), ["tile_id"], F.col("b04") < 20)


@query("fixed_patches", """SELECT o_orderkey stack, cast(o_orderkey % 50 AS int) y, cast(o_custkey % 40 AS int) x, l.i, l.j FROM orders JOIN (SELECT DISTINCT cast(l_orderkey % 50 AS int) y, cast(l_partkey % 40 AS int) x, cast(l_suppkey*7 % 400 AS int) i, cast(l_linenumber*61 % 400 AS int) j FROM lineitem) l
ON l.y = o_orderkey % 50 AND l.x = o_custkey % 40 WHERE i + 64 <= 380 + o_orderkey % 30 AND j + 64 <= 400""")
def fixed_patches(spark, sf):
    k = F.col("o_orderkey")
    stacks = X.table(spark, sf, "orders").select(k.alias("stack"), (k % 50).cast("int").alias("y"), (F.col("o_custkey") % 40).cast("int").alias("x"), (380 + k % 30).alias("h"), F.lit(400).alias("w"))
    spots = X.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 50).cast("int").alias("y"), (F.col("l_partkey") % 40).cast("int").alias("x"),
        (F.col("l_suppkey") * 7 % 400).cast("int").alias("i"), (F.col("l_linenumber") * 61 % 400).cast("int").alias("j")).distinct()
    return G.fixed_patches(stacks, spots, 64).select("stack", "y", "x", "i", "j")


@query("wet_dry_sample", f""", s AS (SELECT c_custkey k, c_custkey % 10 = 0 wet, row_number() OVER (PARTITION BY c_custkey % 10 = 0 ORDER BY {MIX.format(k='c_custkey + 13')}, c_custkey) rk FROM customer), z AS (SELECT count(*) FILTER (wet) nw, count(*) FILTER (NOT wet) nd FROM s),
sl AS (SELECT range id, range < 400 wet, CASE WHEN range < 400 THEN range ELSE range - 400 END pl, CASE WHEN range < 400 THEN nw ELSE nd END n FROM range(1000), z),
dr AS (SELECT id, wet, CASE WHEN pl < n THEN pl + 1 ELSE ({MIX.format(k='id + 20')}) % n + 1 END rk FROM sl)
SELECT dr.id slot, s.k c_custkey, dr.wet FROM dr JOIN s ON s.wet=dr.wet AND s.rk=dr.rk""".replace(", s AS", "WITH s AS", 1))
def wet_dry_sample(spark, sf):
    rows = X.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 10 == 0).alias("is_wet"))
    return G.wet_dry_sample(rows, "c_custkey", "is_wet", 1000, 0.4, 13, "mix")


@query("random_batch", f"SELECT c_custkey FROM customer ORDER BY {MIX.format(k='c_custkey + 3')}, c_custkey LIMIT 50")
def random_batch(spark, sf):
    return G.random_batch(X.table(spark, sf, "customer").select("c_custkey"), "c_custkey", 50, 3, "mix")


def _shards(spark, sf, drop_last=False):
    rows = X.table(spark, sf, "customer").select("c_custkey")
    return G.shards(rows, "c_custkey", 13, rows.count(), drop_last)


SH = """, q AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 i, count(*) OVER () n FROM customer), w AS (SELECT *, n//13 b, n%13 e FROM q),
sh AS (SELECT c_custkey, cast(CASE WHEN i < e*(b+1) THEN i//(b+1) ELSE (i - e*(b+1))//b + e END AS int) shard, i, b, e FROM w),
sp AS (SELECT c_custkey, shard, i - (shard*b + least(shard, e)) shard_pos FROM sh)""".replace(", q AS", "WITH q AS", 1)


@query("even_shards", SH + " SELECT c_custkey, shard, shard_pos FROM sp")
def even_shards(spark, sf):
    return _shards(spark, sf)


@query("equal_shards", SH + " SELECT c_custkey, cast(i//b AS int) shard, i - (i//b)*b shard_pos FROM w WHERE i < b*13")
def equal_shards(spark, sf):
    return _shards(spark, sf, drop_last=True)


@query("reader_order", SH + f""", tn AS (SELECT cast(range AS int) shard, row_number() OVER (ORDER BY {MIX.format(k='range + 7')}, range) - 1 o FROM range(13)), tt AS (SELECT shard, cast(o//4 AS int) "rank", cast((o%4)%2 AS int) worker, cast((o%4)//2 AS int) turn FROM tn WHERE o < 12)
SELECT c_custkey, sp.shard, shard_pos, "rank", worker, turn, cast(shard_pos//16 AS int) block, cast(row_number() OVER (PARTITION BY sp.shard, shard_pos//16 ORDER BY {MIX.format(k='shard_pos + 8')}, shard_pos) - 1 AS int) pos FROM sp JOIN tt ON tt.shard=sp.shard""")
def reader_order(spark, sf):
    return G.reader_order(_shards(spark, sf), 13, 3, 2, 16, 5, 2, "mix")


WIN = ", ps AS (SELECT unnest([0,3,4]) x0), qs AS (SELECT unnest([0,3,4]) y0), sw AS (SELECT tile_id, x0, y0, r, c, 1/(1+exp(-10*(v - 0.01::double*(r-x0)))) s FROM pixel_ext, ps, qs WHERE r BETWEEN x0 AND x0+3 AND c BETWEEN y0 AND y0+3)"


def _position_scorer():
    """Score that depends on the place inside the window, so that blending matters."""
    import numpy as np

    def factory():
        def score(batch):
            rows = np.arange(batch.shape[2]).reshape(1, -1, 1)
            return 1.0 / (1.0 + np.exp(-10 * (batch[:, 0] - 0.01 * rows)))
        return score
    return factory


@query("window_scores", WIN + " SELECT tile_id, r, c, round(avg(s), 6) prob FROM sw GROUP BY ALL", "pixel_ext")
def window_scores(spark, sf):
    cuts = W.windows(X.tile(spark, sf), ["data"], 4, 3)
    return rounded(W.blended(W.scored_windows(cuts, ["data"], 4, _position_scorer()), 4))


@query("hann_blend", WIN + """, hw AS (SELECT *, greatest((0.5::double-0.5::double*cos(2*pi()*(r-x0)/3))*(0.5::double-0.5::double*cos(2*pi()*(c-y0)/3)), 0.001::double) w FROM sw)
SELECT tile_id, r, c, round(sum(s*w)/greatest(sum(w), 0.001), 6) prob FROM hw GROUP BY ALL""", "pixel_ext")
def hann_blend(spark, sf):
    cuts = W.windows(X.tile(spark, sf), ["data"], 4, 3)
    return rounded(W.blended(W.scored_windows(cuts, ["data"], 4, _position_scorer()), 4, "hann"))


@query("tile_scores", WIN + ", m AS (SELECT tile_id, r, c, avg(s) p FROM sw GROUP BY ALL) SELECT m.tile_id, m.r, m.c, round(p, 6) prob, CASE WHEN (m.tile_id*64+m.r*8+m.c) % 97 = 0 THEN 0 WHEN p >= 0.5 THEN 1 ELSE 0 END water FROM m", "pixel_ext")
def tile_scores(spark, sf):
    maps = W.tile_scores(X.tile(spark, sf), ["data"], 4, _position_scorer())
    px = K.exploded(maps, ["prob"])
    missing = (F.col("tile_id") * 64 + F.col("r") * 8 + F.col("c")) % 97 == 0
    return rounded(W.final_map(px, missing, 0.5))


DESPECKLED = """, ins AS (SELECT tile_id, r, c, vv_db = -9999 OR vh_db = -9999 gone, CASE WHEN vv_db = -9999 OR vh_db = -9999 THEN 0.0 ELSE (vv_db + 14.5)/5.0::double END vv,
CASE WHEN vv_db = -9999 OR vh_db = -9999 THEN 0.0 ELSE (vh_db + 20.0)/4.0::double END vh FROM pixel_ext WHERE tile_id % 5 <> 0 AND tile_id % 7 <> 3),
xs AS (SELECT unnest([0,3,4]) x0), ys AS (SELECT unnest([0,3,4]) y0),
wi AS (SELECT *, avg(vv) OVER w mvv, avg(vh) OVER w mvh, greatest((0.5::double-0.5::double*cos(2*pi()*(r-x0)/3))*(0.5::double-0.5::double*cos(2*pi()*(c-y0)/3)), 0.001::double) k
FROM ins, xs, ys WHERE r BETWEEN x0 AND x0+3 AND c BETWEEN y0 AND y0+3 WINDOW w AS (PARTITION BY tile_id, x0, y0)),
bl AS (SELECT tile_id, r, c, any_value(gone) gone, sum((0.75::double*vv + 0.25::double*mvv)*k)/greatest(sum(k), 0.001) vv, sum((0.75::double*vh + 0.25::double*mvh)*k)/greatest(sum(k), 0.001) vh FROM wi GROUP BY 1, 2, 3)
SELECT tile_id, r, c, CASE WHEN gone THEN -9999.0::double ELSE round(vv*5 - 14.5, 6) END vv, CASE WHEN gone THEN -9999.0::double ELSE round(vh*4 - 20, 6) END vh FROM bl"""


@query("despeckled_captures", DESPECKLED, "pixel_ext")
def despeckled_captures(spark, sf):
    """Two-channel despeckling of the captures that have both polarizations and are not done."""
    from tilerain.plans.despeckle_plan import despeckled
    t = F.col("tile_id")
    capture = [F.concat(F.lit("20240101_0_"), t.cast("string")).alias("eid"), F.lit("20240101").alias("s2_date"), F.lit("20240102").alias("s1_date")]
    radar = _radar_tiles(spark, sf)
    tiles = radar.select(*capture, "h", "w", F.lit("vv").alias("polarization"), F.col("vv").alias("data")).unionByName(
        radar.where(t % 5 != 0).select(*capture, "h", "w", F.lit("vh").alias("polarization"), F.col("vh").alias("data")))
    done = radar.where(t % 7 == 3).select(*capture)
    maps = despeckled(tiles, done, {"vv": (-14.5, 5.0), "vh": (-20.0, 4.0)}, 4, W.smoothing_scorer(0.25), 3)
    wide = K.stacked(maps.withColumnRenamed("polarization", "channel"), ["vv", "vh"], ["eid"])
    px = K.exploded(wide, ["vv", "vh"], ["eid"])
    return px.select(F.element_at(F.split("eid", "_"), 3).cast("bigint").alias("tile_id"), "r", "c", *[r6(p).alias(p) for p in ("vv", "vh")])


@query("stacked_channels", "SELECT tile_id, r, c, v vv, v*2 vh FROM pixel WHERE tile_id % 11 <> 0", "pixel")
def stacked_channels(spark, sf):
    t = X.tile(spark, sf)
    rows = t.withColumn("channel", F.lit("vv")).unionByName(
        t.where("tile_id % 11 <> 0").withColumn("data", F.transform("data", lambda v: v * 2)).withColumn("channel", F.lit("vh")))
    return K.exploded(K.stacked(rows, ["vv", "vh"]), ["vv", "vh"])


@query("pixels_to_tiles", "SELECT tile_id, 8 h, 8 w, round(sum(dn*(r*8+c+1))::double, 0) checksum FROM pixel GROUP BY 1", "pixel")
def pixels_to_tiles(spark, sf):
    tiles = K.collected(X.pixel(spark, sf).select("tile_id", "r", "c", "dn"), "dn")
    total = F.aggregate(F.transform("dn", lambda v, i: v * (i + 1)), F.lit(0), lambda a, v: a + v)
    return tiles.select("tile_id", "h", "w", F.round(total.cast("double"), 0).alias("checksum"))


@query("mean_filled_windows", "SELECT tile_id, cast(pos AS int) pos, round(CASE WHEN vv_db = -9999 THEN -14.5 ELSE vv_db END, 6) vv FROM pixel", "pixel")
def mean_filled_windows(spark, sf):
    t = X.tile(spark, sf)
    db = F.transform(F.col("data"), lambda v, p: F.when((F.col("tile_id") * 64 + p) % 97 == 0, F.lit(-9999.0)).otherwise(v * 20 - 15))
    return t.select("tile_id", F.posexplode(W.mean_filled(db, -14.5, -9999.0)).alias("pos", "vv")).select("tile_id", "pos", r6("vv").alias("vv"))


RADAR = ", rt AS (SELECT tile_id, CASE WHEN tile_id % 5 = 0 THEN 'val' ELSE 'train' END split, r, c, pos, vv_db vv, vh_db vh, b04 red, scl, target label FROM pixel_ext)"
GONE = "(vv = -9999 OR vh = -9999 OR red = 0)"


def _radar_tiles(spark, sf):
    """Stacked radar tiles in tile form with a split by tile."""
    tiles = X.tile(spark, sf)
    t = F.col("tile_id")
    dn = lambda v: F.floor((v + 1) * 5000).cast("int")
    data = F.col("data")
    return tiles.select(
        t, F.when(t % 5 == 0, "val").otherwise("train").alias("split"), "h", "w",
        F.transform(data, lambda v, p: F.when((t * 64 + p) % 97 == 0, F.lit(-9999.0)).otherwise(v * 20 - 15)).alias("vv"),
        F.transform(data, lambda v, p: F.when((t * 64 + p) % 89 == 0, F.lit(-9999.0)).otherwise(v * 15 - 20)).alias("vh"),
        F.transform(data, lambda v, p: ((dn(v) * 13 + p * 29) % 10000).cast("double")).alias("red"),
        F.transform(data, lambda v: dn(v) % 12).alias("scl"), F.transform(data, lambda v: F.when((dn(v) * 7) % 11 < 3, 1).otherwise(0)).alias("label"))


@query("training_patches", RADAR + POS.replace("[0,2,4,5]", "[0,3,4]") + f""", ok AS (SELECT tile_id, x0, y0 FROM rt, ps, qs WHERE r BETWEEN x0 AND x0+3 AND c BETWEEN y0 AND y0+3 GROUP BY ALL HAVING sum({GONE}::int)/16.0::double <= 0.07 AND sum((scl IN (8,9))::int)/16.0::double <= 0.2)
SELECT ok.tile_id, split, x0, y0, round(sum(vv::float), 3) vv_sum, sum(label)::double label_sum, 16 n FROM ok JOIN rt ON rt.tile_id=ok.tile_id AND r BETWEEN x0 AND x0+3 AND c BETWEEN y0 AND y0+3 GROUP BY ALL""", "pixel_ext")
def training_patches(spark, sf):
    from tilerain.plans.patch_plan import patches
    out = patches(_radar_tiles(spark, sf), ["vv", "label"], 4, "strided", stride=3, max_missing=0.07, max_cloud=0.2)
    total = lambda c: F.aggregate(F.element_at("channels", c), F.lit(0.0), lambda a, v: a + v)
    return out.select("tile_id", "split", "x0", "y0", F.round(total("vv"), 3).alias("vv_sum"), total("label").alias("label_sum"), F.size(F.element_at("channels", "vv")).alias("n"))


@query("training_statistics", RADAR + f" SELECT 'vv' channel, count(*) n, round(avg(vv),6) mean, round(stddev_samp(vv),6) std, round(min(vv),6) min, round(max(vv),6) max FROM rt WHERE split='train' AND NOT {GONE} UNION ALL SELECT 'label', count(*), 0, 1, 0, 1 FROM rt WHERE split='train' AND NOT {GONE}", "pixel_ext")
def training_statistics(spark, sf):
    from tilerain.plans.patch_plan import training_statistics as run
    return rounded(run(_radar_tiles(spark, sf), ["vv", "label"], ["label"]))


@query("scored_tiles", RADAR + """, m AS (SELECT tile_id, avg(vv) mv FROM rt WHERE vv <> -9999 GROUP BY 1), z AS (SELECT rt.*, (CASE WHEN vv = -9999 THEN coalesce(mv, 0) ELSE vv END + 14.0::double)/3.5::double x FROM rt LEFT JOIN m ON m.tile_id=rt.tile_id),
sc AS (SELECT tile_id, r, c, avg(1/(1+exp(-10*(x - 0.01::double*(r-x0))))) p FROM z, (SELECT unnest([0,3,4]) x0), (SELECT unnest([0,3,4]) y0) WHERE r BETWEEN x0 AND x0+3 AND c BETWEEN y0 AND y0+3 GROUP BY ALL)
SELECT sc.tile_id, sc.r, sc.c, round(p, 6) prob, vv = -9999 OR vh = -9999 missing, scl FROM sc JOIN rt ON rt.tile_id=sc.tile_id AND rt.r=sc.r AND rt.c=sc.c""", "pixel_ext")
def scored_tiles(spark, sf):
    from tilerain.plans.score_plan import prepared, scored_pixels
    ready = prepared(_radar_tiles(spark, sf), {"vv": (-14.0, 3.5)}, ["vv", "vh"], -9999.0)
    return rounded(scored_pixels(ready, ["vv"], 4, _position_scorer(), ["scl"]))
