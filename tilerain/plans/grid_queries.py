"""Registered queries on neighborhoods, composites, regridding and vector burning."""

from pyspark.sql import functions as F

from tilerain.operators import burning as B
from tilerain.operators import neighborhood as N
from tilerain.operators import regrid as R
from tilerain.operators import stacking as K
from tilerain.operators import tilegrid as H
from tilerain.plans import fixtures as X
from tilerain.plans.registry import ORACLES, query, r6, rounded

KEY = ["tile_id", "r", "c"]
LINE_WINDOWS = "WINDOW d AS (PARTITION BY tile_id, c ORDER BY r), e AS (PARTITION BY tile_id, r ORDER BY c)"


def _slope(w: str) -> str:
    return f"CASE WHEN lead(dn) OVER {w} IS NULL THEN dn - lag(dn) OVER {w} WHEN lag(dn) OVER {w} IS NULL THEN lead(dn) OVER {w} - dn ELSE (lead(dn) OVER {w} - lag(dn) OVER {w})/2 END::double"


@query("terrain_slope", f"SELECT tile_id, r, c, {_slope('d')} slope_y, {_slope('e')} slope_x FROM pixel {LINE_WINDOWS}", "pixel")
def terrain_slope(spark, sf):
    return N.gradient(X.pixel(spark, sf).select(*KEY, F.col("dn").cast("double").alias("dn")), "dn").select(*KEY, "slope_y", "slope_x")


@query("leave_one_out_composite", """, w AS (SELECT *, count(*) OVER s n, sum(vv_db) OVER s sv, sum(vh_db) OVER s sh, sum((vv_db=-9999)::int) OVER s mv, sum((vh_db=-9999)::int) OVER s mh FROM pixel_ext WINDOW s AS (PARTITION BY stack_id, r, c))
SELECT stack_id, r, c, acq, round(CASE WHEN mv - (vv_db=-9999)::int > 0 THEN -9999 ELSE (sv - vv_db)/(n-1) END, 6) vv_db_composite, round(CASE WHEN mh - (vh_db=-9999)::int > 0 THEN -9999 ELSE (sh - vh_db)/(n-1) END, 6) vh_db_composite, mv + mh > 0 union_missing FROM w""", "pixel_ext")
def leave_one_out_composite(spark, sf):
    px = N.complete_stacks(X.pixel_ext(spark, sf).select("stack_id", "acq", "r", "c", "vv_db", "vh_db"), 5)
    return rounded(N.leave_one_out(px, ["vv_db", "vh_db"]).drop("vv_db", "vh_db"))


@query("full_stacks", "SELECT o_custkey stack_id, count(*) n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 7) = 5", "")
def full_stacks(spark, sf):
    rows = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("stack_id"), (F.col("o_orderkey") % 7).alias("acq"))
    return N.complete_stacks(rows, 5).groupBy("stack_id").agg(F.count(F.lit(1)).alias("n"))


LEE = """, p AS (SELECT tile_id, r, c, CASE WHEN vv_db = -9999 THEN 0 ELSE pow(10, vv_db/10) END p FROM pixel),
w AS (SELECT a.tile_id, a.r, a.c, a.p, count(*) n, avg(b.p) m, sum(b.p*b.p) q FROM p a JOIN p b ON b.tile_id=a.tile_id AND abs(b.r-a.r) <= 3 AND abs(b.c-a.c) <= 3 AND b.p <> 0 GROUP BY ALL),
s AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE sqrt(greatest(0, (q/n - m*m)*n/(n-1))) END sd FROM w), k AS (SELECT *, CASE WHEN m <> 0 THEN sd/m ELSE 0 END ci FROM s),
z AS (SELECT *, CASE WHEN ci <= 0.523::double THEN 1 WHEN ci >= 1.73::double THEN 0 ELSE exp(-(ci-0.523::double)/(1.73::double-ci)) END wt FROM k)
SELECT tile_id, r, c, round(CASE WHEN p = 0 THEN -9999 ELSE 10*log10(m*wt + p*(1-wt)) END, 6) vv FROM z"""


@query("lee_filter", LEE, "pixel")
def lee_filter(spark, sf):
    return N.lee_filter(X.pixel(spark, sf).select(*KEY, "vv_db"), "vv_db", "vv").select(*KEY, r6("vv").alias("vv"))


def _db_tiles(spark, sf):
    return X.tile(spark, sf).withColumn("data", F.transform("data", lambda v, p: F.when((F.col("tile_id") * 64 + p) % 97 == 0, F.lit(-9999.0)).otherwise(v * 20 - 15)))


@query("lee_filter_tiles", LEE, "pixel")
def lee_filter_tiles(spark, sf):
    return K.exploded(N.lee_filter_tiles(_db_tiles(spark, sf)), ["data"]).select(*KEY, r6("data").alias("vv"))


SSIM = """, q0 AS (SELECT tile_id//4 patch, (tile_id%4//2)*8 + r r, (tile_id%4%2)*8 + c c, least(greatest(v+0.5::double,0),1) x, least(greatest(prob,0),1) y FROM pixel_ext),
q AS (SELECT p.patch, a.range r, b.range c, coalesce(x, 0) x, coalesce(y, 0) y FROM (SELECT DISTINCT patch FROM q0) p CROSS JOIN range(16) a CROSS JOIN range(16) b LEFT JOIN q0 ON q0.patch=p.patch AND q0.r=a.range AND q0.c=b.range), g AS (SELECT range i, exp(-(range-5)*(range-5)/4.5::double) g FROM range(11)), gn AS (SELECT i, g/(SELECT sum(g) FROM g) w FROM g),
o AS (SELECT a.range r0, b.range c0 FROM range(6) a, range(6) b),
m AS (SELECT q.patch, r0, c0, sum(u.w*t.w*x) mx, sum(u.w*t.w*y) my, sum(u.w*t.w*x*x) xx, sum(u.w*t.w*y*y) yy, sum(u.w*t.w*x*y) xy FROM q JOIN o ON q.r BETWEEN r0 AND r0+10 AND q.c BETWEEN c0 AND c0+10 JOIN gn u ON u.i=q.r-r0 JOIN gn t ON t.i=q.c-c0 GROUP BY ALL)
SELECT patch, round(avg(((2*mx*my+0.0001::double)/(mx*mx+my*my+0.0001::double))*((2*(xy-mx*my)+0.0009::double)/(xx-mx*mx+yy-my*my+0.0009::double))), 6) ssim FROM m GROUP BY patch"""


@query("structural_similarity", SSIM, "pixel_ext")
def structural_similarity(spark, sf):
    t = F.col("tile_id")
    quarter = t % 4
    px = X.pixel_ext(spark, sf).select(
        F.floor(t / 4).alias("tile_id"), (F.floor(quarter / 2) * 8 + F.col("r")).alias("r"), (quarter % 2 * 8 + F.col("c")).alias("c"),
        F.least(F.greatest(F.col("v") + 0.5, F.lit(0.0)), F.lit(1.0)).alias("x"), F.col("prob").alias("y"))
    # a group of fewer than four tiles is zero where it has none
    full = R.dense_grid(px.select("tile_id").distinct(), 16, 16).join(px, ["tile_id", "r", "c"], "left").fillna(0.0, ["x", "y"])
    tiles = K.collected(full.withColumn("xy", F.struct("x", "y")), "xy")
    arrays = tiles.select(F.col("tile_id").alias("patch"), F.lit(16).alias("h"), F.lit(16).alias("w"), F.transform("xy", lambda s: s["x"]).alias("x"), F.transform("xy", lambda s: s["y"]).alias("y"))
    return rounded(N.ssim_tiles(arrays, "x", "y").select("patch", "ssim"))


UNIT = lambda c, lo, hi: f"least(greatest(({c} - ({lo}))/(({hi}) - ({lo})), 0), 1)"
REPORT = f""", lp AS ({LEE.replace(', p AS', 'WITH p AS', 1).replace('round(CASE WHEN p = 0 THEN -9999 ELSE 10*log10(m*wt + p*(1-wt)) END, 6)', 'CASE WHEN p = 0 THEN -9999 ELSE 10*log10(m*wt + p*(1-wt)) END')}),
u AS (SELECT 'raw' modality, tile_id, r, c, vv_db db FROM pixel UNION ALL SELECT 'enhanced_lee', tile_id, r, c, vv FROM lp UNION ALL SELECT 'model', tile_id, r, c, v*10-15 FROM pixel),
a AS (SELECT u.*, {UNIT('sqrt(pow(10,db/10))', 'pow(10,-1.5)', '1')} x, {UNIT('sqrt(pow(10,(v*18-15)/10))', 'pow(10,-1.5)', '1')} y, {UNIT('db', '-30', '0')} n FROM u JOIN pixel p ON p.tile_id=u.tile_id AND p.r=u.r AND p.c=u.c),
l AS (SELECT *, coalesce(lag(n) OVER d,0)+coalesce(lead(n) OVER d,0)+coalesce(lag(n) OVER e,0)+coalesce(lead(n) OVER e,0)-4*n l FROM a WINDOW d AS (PARTITION BY modality, tile_id, c ORDER BY r), e AS (PARTITION BY modality, tile_id, r ORDER BY c)),
t AS (SELECT modality, tile_id, 10*log10(1/(avg((x-y)*(x-y))+1e-10)) psnr, avg((2*x*y+0.0001::double)/(x*x+y*y+0.0001::double)) ssim, var_samp(l) var_lap, avg(pow(10,db/10))*avg(pow(10,db/10))/var_samp(pow(10,db/10)) enl FROM l GROUP BY ALL)
SELECT modality, round(avg(psnr),6) psnr_vv, round(avg(ssim),6) ssim_vv, round(avg(var_lap),6) var_lap_vv, round(avg(enl) FILTER (tile_id % 3 = 0),5) enl_vv FROM t GROUP BY modality"""


@query("despeckling_report", REPORT, "pixel")
def despeckling_report(spark, sf):
    px = X.pixel(spark, sf)
    lee = N.lee_filter(px.select(*KEY, "vv_db"), "vv_db", "db").select(*KEY, "db")
    rows = [px.select(*KEY, F.col("vv_db").alias("db")).withColumn("modality", F.lit("raw")), lee.withColumn("modality", F.lit("enhanced_lee")),
            px.select(*KEY, (F.col("v") * 10 - 15).alias("db")).withColumn("modality", F.lit("model"))]
    clean = px.select(*KEY, (F.col("v") * 18 - 15).alias("clean_db"))
    joined = rows[0].unionByName(rows[1]).unionByName(rows[2]).join(clean, KEY)
    table = N.despeckling_table({"vv": N.despeckling_report(joined, "vv", homogeneous=joined.where("tile_id % 3 = 0"))})
    return table.select("modality", *[r6(f"{m}_vv").alias(f"{m}_vv") for m in ("psnr", "ssim", "var_lap")], r6("enl_vv", 5).alias("enl_vv"))


@query("crop_to_bounds", """, b AS (SELECT vec_id tile_id, cast(vec_id % 5 - 2 AS int) c0, cast(vec_id % 4 - 1 AS int) r0 FROM embeddings), g AS (SELECT b.*, cast(x.range AS int) r, cast(y.range AS int) c FROM b, range(6) x, range(5) y)
SELECT g.tile_id, g.r, g.c, coalesce(p.dn, 0) dn FROM g LEFT JOIN pixel p ON p.tile_id=g.tile_id AND p.r=g.r+g.r0 AND p.c=g.c+g.c0""", "pixel")
def crop_to_bounds(spark, sf):
    t = F.col("tile_id")
    west, north = 100.0 + (t % 5 - 2) * 10.0 + 2.0, 500.0 - (t % 4 - 1) * 10.0 - 3.0
    bounds = X.tile(spark, sf).select(t, west.alias("west"), (north - 60.0).alias("south"), (west + 50.0).alias("east"), north.alias("north"))
    return R.crop(X.pixel(spark, sf).select(*KEY, "dn"), bounds, (100.0, 10.0, 500.0, -10.0), "dn", 0)


@query("nearest_regrid", """, g AS (SELECT vec_id tile_id, cast(x.range AS int) r, cast(y.range AS int) c FROM embeddings, range(5) x, range(5) y)
SELECT g.tile_id, g.r, g.c, coalesce(nlcd, 250) nlcd FROM g LEFT JOIN pixel_ext p ON p.tile_id=g.tile_id AND p.r=cast(floor((g.r+0.5::double)*2 - 0.5::double) AS int) AND p.c=cast(floor((g.c+0.5::double)*2 - 0.5::double) AS int)""", "pixel_ext")
def nearest_regrid(spark, sf):
    tiles, px = X.tile(spark, sf), X.pixel_ext(spark, sf).select(*KEY, "nlcd")
    return R.nearest_regrid(px, tiles, "nlcd", (0.0, 10.0, 0.0, -10.0), (-5.0, 20.0, 5.0, -20.0), 5, 5, 250)


@query("bilinear_regrid", """, g AS (SELECT vec_id tile_id, cast(x.range AS int) r, cast(y.range AS int) c, (x.range+0.5::double)*0.75::double - 1 sr, (y.range+0.5::double)*0.75::double - 0.5::double + 0.3::double sc FROM embeddings, range(10) x, range(10) y),
k AS (SELECT g.*, floor(sr) + i rr, floor(sc) + j cc, abs(1 - i - (sr - floor(sr)))*abs(1 - j - (sc - floor(sc))) w FROM g, (SELECT unnest([0,1]) i), (SELECT unnest([0,1]) j))
SELECT k.tile_id, k.r, k.c, round(CASE WHEN sum(CASE WHEN p.vv_db IS NOT NULL THEN w END) > 0 THEN sum(w*vv_db)/sum(CASE WHEN p.vv_db IS NOT NULL THEN w END) ELSE -9999 END, 5) vv_db FROM k LEFT JOIN pixel p ON p.tile_id=k.tile_id AND p.r=rr AND p.c=cc AND p.vv_db <> -9999 GROUP BY 1, 2, 3""", "pixel")
def bilinear_regrid(spark, sf):
    tiles, px = X.tile(spark, sf), X.pixel(spark, sf).select(*KEY, "vv_db")
    out = R.bilinear_regrid(px, tiles, "vv_db", (0.0, 10.0, 0.0, -10.0), (3.0, 7.5, 5.0, -7.5), 10, 10, -9999.0)
    return rounded(out, 5)


@query("padded_window", "SELECT tile_id, r, c, nlcd FROM pixel_ext WHERE r BETWEEN 1 AND 6 AND c BETWEEN 2 AND 6", "pixel_ext")
def padded_window(spark, sf):
    return R.halo(X.pixel_ext(spark, sf).select(*KEY, "nlcd"), 2, 3, 4, 3, 1)


@query("mosaic", "SELECT stack_id, r, c, coalesce(arg_min(vv_db, acq) FILTER (vv_db <> -9999), -9999) vv_db FROM pixel_ext GROUP BY 1, 2, 3", "pixel_ext")
def mosaic(spark, sf):
    px = X.pixel_ext(spark, sf).select("stack_id", "r", "c", F.col("acq").alias("file_ord"), "vv_db")
    return R.mosaic(px, "vv_db", -9999.0, ["stack_id", "r", "c"])


@query("mixed_sources", "SELECT y, x, count(DISTINCT crs) n_crs, count(DISTINCT item_id % 2) n_nodata FROM scene GROUP BY 1, 2 HAVING count(DISTINCT crs) > 1 OR count(DISTINCT item_id % 2) > 1", "scene")
def mixed_sources(spark, sf):
    return R.mixed_sources(X.scene(spark, sf).select("y", "x", "crs", (F.col("item_id") % 2).alias("nodata")), ["y", "x"])


SEG = ", sg AS (SELECT feature_id, fcode, minx*4 x1, miny*4 y1, maxx*4 x2, maxy*4 y2 FROM feature)"
CELLS = """, gr AS (SELECT cast(a.range AS int) r, cast(b.range AS int) c FROM range(32) a, range(32) b)"""


def _segments(spark, sf):
    return X.feature(spark, sf).select("feature_id", "fcode", *[(F.col(a) * 4).alias(b) for a, b in (("minx", "x1"), ("miny", "y1"), ("maxx", "x2"), ("maxy", "y2"))])


@query("burned_lines", SEG + CELLS + """, sl AS (SELECT sg.*, r, c, greatest(0, (r-y1)/nullif(y2-y1,0)) t0, least(1, (r+1-y1)/nullif(y2-y1,0)) t1 FROM sg JOIN gr ON r >= floor(y1) AND r <= floor(y2) AND c >= floor(x1) AND c <= floor(x2)),
h AS (SELECT DISTINCT fcode, r, c FROM sl WHERE c >= floor(x1 + coalesce(t0,0)*(x2-x1)) AND c <= floor(x1 + coalesce(t1,1)*(x2-x1)))
SELECT f.fcode, gr.r, gr.c, CASE WHEN h.r IS NULL THEN 0 ELSE 1 END burned FROM (SELECT DISTINCT fcode FROM feature) f CROSS JOIN gr LEFT JOIN h ON h.fcode=f.fcode AND h.r=gr.r AND h.c=gr.c""", "feature")
def burned_lines(spark, sf):
    seg = _segments(spark, sf)
    cells = R.touched_cells(seg, ["fcode"], 32, 32)
    return R.burned(cells, seg.select("fcode").distinct(), ["fcode"], 32, 32)


TRI = ", tr AS (SELECT feature_id, minx*4+0.0123::double ax, miny*4+0.0171::double ay, maxx*4+3.1357::double bx, miny*4+1.7213::double by_, minx*4+1.3171::double cx, maxy*4+4.2931::double cy FROM feature WHERE fcode <> 49300)"


def _triangles(spark, sf):
    f = X.feature(spark, sf).where("fcode <> 49300")
    a = (F.col("minx") * 4 + 0.0123, F.col("miny") * 4 + 0.0171)
    b = (F.col("maxx") * 4 + 3.1357, F.col("miny") * 4 + 1.7213)
    c = (F.col("minx") * 4 + 1.3171, F.col("maxy") * 4 + 4.2931)
    edges = F.array(*[F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")) for p, q in ((a, b), (b, c), (c, a))])
    return f.select("feature_id", F.inline(edges))


FILLED = """ SELECT feature_id, r, c FROM tr JOIN gr ON r + 0.5 >= ay AND r + 0.5 < cy AND c >= floor(ax) - 1 AND c <= bx + 1
WHERE (bx-ax)*(r+0.5::double-ay) - (by_-ay)*(c+0.5::double-ax) > 0 AND (cx-bx)*(r+0.5::double-by_) - (cy-by_)*(c+0.5::double-bx) > 0 AND (ax-cx)*(r+0.5::double-cy) - (ay-cy)*(c+0.5::double-cx) > 0"""


@query("filled_polygons", TRI + CELLS + FILLED, "feature")
def filled_polygons(spark, sf):
    return R.filled_cells(_triangles(spark, sf), ["feature_id"], [], 32, 32)


def _burned_pixels(masks, tiles, keys, side, tile):
    out = B.burned_tiles(masks, tiles, keys, side, side, tile)
    px = K.exploded(out, ["burned"], [*keys, "ty", "tx"])
    return px.select(*keys, (F.col("ty") * tile + F.col("r")).cast("int").alias("r"), (F.col("tx") * tile + F.col("c")).cast("int").alias("c"), F.col("burned").cast("int").alias("burned"))


@query("burned_line_tiles")
def burned_line_tiles(spark, sf):
    seg = _segments(spark, sf)
    return _burned_pixels(B.line_masks(seg, ["fcode"], 32, 32, 20), B.tiles_of(seg, ["fcode"], 32, 32, 20), ["fcode"], 32, 20)


ORACLES["burned_line_tiles"] = ORACLES["burned_lines"]


@query("filled_shares", TRI + CELLS + ", f AS (" + FILLED + """) SELECT g.feature_id, ty, tx, cast(least(20, 32-ty*20)*least(20, 32-tx*20) AS bigint) n_cells, count(f.r) burned, count(f.r)/(least(20, 32-ty*20)*least(20, 32-tx*20)) share
FROM (SELECT feature_id, ty, tx FROM (SELECT DISTINCT feature_id FROM tr), (SELECT cast(unnest([0,1]) AS int) ty), (SELECT cast(unnest([0,1]) AS int) tx)) g LEFT JOIN f ON f.feature_id=g.feature_id AND f.r//20=ty AND f.c//20=tx GROUP BY 1, 2, 3""", "feature")
def filled_shares(spark, sf):
    seg = _triangles(spark, sf)
    return B.burned_shares(B.fill_masks(seg, ["feature_id"], [], 32, 32, 20), B.tiles_of(seg, ["feature_id"], 32, 32, 20), ["feature_id"], 32, 32, 20)


def _diamonds(spark, sf):
    box = X.feature(spark, sf).groupBy("fcode").agg((F.min("minx") * 2).alias("x0"), (F.max("maxx") * 2).alias("xe"), (F.min("miny") * 2).alias("y0"), (F.max("maxy") * 2).alias("ye"))
    mx, my = (F.col("x0") + F.col("xe")) / 2, (F.col("y0") + F.col("ye")) / 2
    corner = [(F.col("x0"), my), (mx, F.col("y0")), (F.col("xe"), my), (mx, F.col("ye"))]
    edges = F.array(*[F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")) for p, q in zip(corner, corner[1:] + corner[:1])])
    return box.select("fcode", F.inline(edges))


@query("region_cells", """, d AS (SELECT fcode, min(minx)*2 x0, max(maxx)*2 x1, min(miny)*2 y0, max(maxy)*2 y1 FROM feature GROUP BY fcode), gr AS (SELECT cast(a.range AS int) r, cast(b.range AS int) c FROM range(20) a, range(20) b)
SELECT fcode, r, c FROM d, gr WHERE greatest(0, greatest(c - (x0+x1)/2, (x0+x1)/2 - (c+1)))/((x1-x0)/2) + greatest(0, greatest(r - (y0+y1)/2, (y0+y1)/2 - (r+1)))/((y1-y0)/2) <= 1""", "feature")
def region_cells(spark, sf):
    return R.region_cells(_diamonds(spark, sf), ["fcode"], [], 20, 20)


@query("region_cell_tiles")
def region_cell_tiles(spark, sf):
    edges = _diamonds(spark, sf)
    masks = B.united([B.line_masks(edges, ["fcode"], 20, 20, 16), B.fill_masks(edges, ["fcode"], [], 20, 20, 16)], ["fcode"])
    return _burned_pixels(masks, masks.select("fcode", "ty", "tx").distinct(), ["fcode"], 20, 16).where("burned = 1").drop("burned")


ORACLES["region_cell_tiles"] = ORACLES["region_cells"]


@query("shifted_pair", """, sh AS (SELECT vec_id tile_id, cast(vec_id % 5 - 2 AS int) sx, cast(vec_id % 3 - 1 AS int) sy FROM embeddings)
SELECT o.tile_id, q.r - greatest(0, sy) r, q.c - greatest(0, -sx) c, o.target, q.vv_db FROM sh JOIN pixel_ext o ON o.tile_id=sh.tile_id JOIN pixel_ext q ON q.tile_id=o.tile_id AND q.r=o.r+sy AND q.c=o.c-sx""", "pixel_ext")
def shifted_pair(spark, sf):
    px, t = X.pixel_ext(spark, sf), F.col("tile_id")
    shifts = X.tile(spark, sf).select(t, (t % 5 - 2).cast("int").alias("shift_x"), (t % 3 - 1).cast("int").alias("shift_y"))
    return R.shifted_pair(px.select(*KEY, "target"), px.select(*KEY, "vv_db"), shifts)


@query("terrain_slope_tiles", f"SELECT tile_id, r, c, {_slope('d')} slope_y, {_slope('e')} slope_x FROM pixel {LINE_WINDOWS}", "pixel")
def terrain_slope_tiles(spark, sf):
    dem = X.tile(spark, sf).withColumn("data", F.transform("data", lambda v: F.floor((v + 1) * 5000).cast("double")))
    return K.exploded(N.gradient_tiles(dem), ["slope_y", "slope_x"])


@query("laplacian_variance_tiles", """, l AS (SELECT tile_id, coalesce(lag(v) OVER d,0)+coalesce(lead(v) OVER d,0)+coalesce(lag(v) OVER e,0)+coalesce(lead(v) OVER e,0)-4*v l FROM pixel
WINDOW d AS (PARTITION BY tile_id, c ORDER BY r), e AS (PARTITION BY tile_id, r ORDER BY c)) SELECT tile_id, round(var_samp(l),6) var_laplacian FROM l GROUP BY 1""", "pixel")
def laplacian_variance_tiles(spark, sf):
    return rounded(N.laplacian_variance_tiles(X.tile(spark, sf)).select("tile_id", "var_laplacian"))


@query("leave_one_out_tiles", """, w AS (SELECT *, count(*) OVER s n, sum(vv_db) OVER s sv, sum((vv_db=-9999)::int) OVER s mv FROM pixel WINDOW s AS (PARTITION BY stack_id, r, c))
SELECT stack_id, r, c, acq, round(CASE WHEN mv - (vv_db=-9999)::int > 0 THEN -9999 ELSE (sv - vv_db)/(n-1) END, 6) composite FROM w""", "pixel")
def leave_one_out_tiles(spark, sf):
    t = F.col("tile_id")
    tiles = _db_tiles(spark, sf).withColumn("stack_id", F.floor(t / 5).cast("int")).withColumn("acq", (t % 5).cast("int"))
    out = N.leave_one_out_tiles(tiles, 5)
    return rounded(K.exploded(out, ["composite"], ["stack_id", "acq"]))


RASTER = """, ra AS (SELECT cast(tile_id//6 AS bigint) raster_id, cast(tile_id % 6 // 3 AS int) ty, cast(tile_id % 3 AS int) tx, r, c,
cast(tile_id % 6 // 3 * 8 + r AS int) gr, cast(tile_id % 3 * 8 + c AS int) gc, v, vv_db FROM pixel)"""


def _raster_tiles(spark, sf):
    """Rasters of two by three tiles; the last raster has fewer."""
    t, data = F.col("tile_id"), F.col("data")
    db = F.transform(data, lambda v, p: F.when((t * 64 + p) % 97 == 0, F.lit(-9999.0)).otherwise(v * 20 - 15))
    return X.tile(spark, sf).select(F.floor(t / 6).alias("raster_id"), F.floor(t % 6 / 3).cast("int").alias("ty"), (t % 3).cast("int").alias("tx"),
                                    "h", "w", data.alias("v"), db.alias("vv_db"))


@query("slopes_across_tiles", RASTER + """ SELECT a.raster_id, a.ty, a.tx, a.r, a.c,
round(CASE WHEN n.v IS NULL THEN a.v - s.v WHEN s.v IS NULL THEN n.v - a.v ELSE (n.v - s.v)/2 END, 6) slope_y,
round(CASE WHEN e.v IS NULL THEN a.v - w.v WHEN w.v IS NULL THEN e.v - a.v ELSE (e.v - w.v)/2 END, 6) slope_x FROM ra a
LEFT JOIN ra n ON n.raster_id=a.raster_id AND n.gr=a.gr+1 AND n.gc=a.gc LEFT JOIN ra s ON s.raster_id=a.raster_id AND s.gr=a.gr-1 AND s.gc=a.gc
LEFT JOIN ra e ON e.raster_id=a.raster_id AND e.gr=a.gr AND e.gc=a.gc+1 LEFT JOIN ra w ON w.raster_id=a.raster_id AND w.gr=a.gr AND w.gc=a.gc-1""", "pixel")
def slopes_across_tiles(spark, sf):
    slopes = H.slopes_across(H.with_halo(_raster_tiles(spark, sf), ["v"], 1), "v")
    px = K.exploded(slopes.withColumn("w", F.col("width") - 2), ["slope_y", "slope_x"], ["raster_id", "ty", "tx"])
    return px.select("raster_id", "ty", "tx", "r", "c", r6("slope_y").alias("slope_y"), r6("slope_x").alias("slope_x"))


@query("laplacian_across_tiles", RASTER + """, l AS (SELECT a.raster_id, coalesce(n.v,0)+coalesce(s.v,0)+coalesce(e.v,0)+coalesce(w.v,0)-4*a.v l FROM ra a
LEFT JOIN ra n ON n.raster_id=a.raster_id AND n.gr=a.gr+1 AND n.gc=a.gc LEFT JOIN ra s ON s.raster_id=a.raster_id AND s.gr=a.gr-1 AND s.gc=a.gc
LEFT JOIN ra e ON e.raster_id=a.raster_id AND e.gr=a.gr AND e.gc=a.gc+1 LEFT JOIN ra w ON w.raster_id=a.raster_id AND w.gr=a.gr AND w.gc=a.gc-1)
SELECT raster_id, round(var_samp(l), 6) var_laplacian FROM l GROUP BY 1""", "pixel")
def laplacian_across_tiles(spark, sf):
    return rounded(H.laplacian_across(H.with_halo(_raster_tiles(spark, sf), ["v"], 1, fill=0.0), "v"))


@query("crop_across_tiles", RASTER + """, b AS (SELECT cast(vec_id//6 AS bigint) raster_id, vec_id window_id, cast(vec_id % 20 - 3 AS int) r0, cast(vec_id % 23 - 2 AS int) c0 FROM embeddings),
g AS (SELECT b.*, cast(x.range AS int) r, cast(y.range AS int) c FROM b, range(6) x, range(9) y)
SELECT g.raster_id, g.window_id, g.r, g.c, round(coalesce(v, -9999.0), 6) v FROM g LEFT JOIN ra ON ra.raster_id=g.raster_id AND gr=g.r+r0 AND gc=g.c+c0""", "pixel")
def crop_across_tiles(spark, sf):
    t = F.col("tile_id")
    windows = X.tile(spark, sf).select(F.floor(t / 6).alias("raster_id"), t.alias("window_id"), (t % 20 - 3).cast("int").alias("r0"),
                                       (t % 23 - 2).cast("int").alias("c0"), F.lit(6).alias("height"), F.lit(9).alias("width"))
    cut = H.read_windows(_raster_tiles(spark, sf), windows, ["v"], 8, 8)
    px = K.exploded(cut.withColumnRenamed("width", "w"), ["v"], ["raster_id", "window_id"])
    return px.select("raster_id", "window_id", "r", "c", r6("v").alias("v"))


@query("regrid_across_tiles", RASTER + """, b AS (SELECT cast(vec_id//6 AS bigint) raster_id, vec_id window_id, vec_id % 7 * 20.0::double + 3 ulx, -(vec_id % 5) * 20.0::double - 5 uly FROM embeddings),
g AS (SELECT b.*, cast(x.range AS int) r, cast(y.range AS int) c, (uly - (x.range+0.5::double)*7.5::double)/(-10.0::double) - 0.5::double sr, (ulx + (y.range+0.5::double)*7.5::double)/10.0::double - 0.5::double sc FROM b, range(7) x, range(9) y),
k AS (SELECT g.*, floor(sr) + i rr, floor(sc) + j cc, abs(1 - i - (sr - floor(sr)))*abs(1 - j - (sc - floor(sc))) wt FROM g, (SELECT unnest([0,1]) i), (SELECT unnest([0,1]) j))
SELECT k.raster_id, k.window_id, k.r, k.c, round(CASE WHEN sum(CASE WHEN p.vv_db IS NOT NULL THEN wt END) > 0 THEN sum(wt*vv_db)/sum(CASE WHEN p.vv_db IS NOT NULL THEN wt END) ELSE -9999 END, 5) vv_db
FROM k LEFT JOIN ra p ON p.raster_id=k.raster_id AND p.gr=rr AND p.gc=cc AND p.vv_db <> -9999 GROUP BY 1, 2, 3, 4""", "pixel")
def regrid_across_tiles(spark, sf):
    t = F.col("tile_id")
    wanted = X.tile(spark, sf).select(F.floor(t / 6).alias("raster_id"), t.alias("window_id"), (t % 7 * F.lit(20.0) + 3).alias("ulx"), F.lit(7.5).alias("sx"),
                                      (-(t % 5) * F.lit(20.0) - 5).alias("uly"), F.lit(-7.5).alias("sy"), F.lit(7).alias("h"), F.lit(9).alias("w"))
    out = H.regrid_across(_raster_tiles(spark, sf), wanted, "vv_db", (0.0, 10.0, 0.0, -10.0), 8, 8, -9999.0)
    return rounded(K.exploded(out, ["data"], ["raster_id", "window_id"]).withColumnRenamed("data", "vv_db"), 5)


@query("bilinear_regrid_tiles", ORACLES["bilinear_regrid"])
def bilinear_regrid_tiles(spark, sf):
    t, data = F.col("tile_id"), F.col("data")
    db = F.transform(data, lambda v, p: F.when((t * 64 + p) % 97 == 0, F.lit(-9999.0)).otherwise(v * 20 - 15))
    tiles = X.tile(spark, sf).withColumn("db", db)
    out = H.regrid_tiles(tiles, "db", (0.0, 10.0, 0.0, -10.0), (3.0, 7.5, 5.0, -7.5), 10, 10, -9999.0)
    return rounded(K.exploded(out.withColumn("w", F.lit(10)), ["regridded"]).withColumnRenamed("regridded", "vv_db"), 5)
