"""Registered queries on band math, masks and pixel statistics."""

from pyspark.sql import functions as F

from tilerain.functions import bands as B
from tilerain.operators import metrics as M
from tilerain.operators import moments as P
from tilerain.operators import patches as G
from tilerain.operators import regrid as R
from tilerain.operators import stacking as K
from tilerain.operators import stats as S
from tilerain.plans import fixtures as X
from tilerain.plans.registry import query, r6, rounded
from tilerain.schema import NLCD_NODATA, class_rgb
from tilerain.session import scratch_folder

KEY = ["tile_id", "r", "c"]
REFL = "least(greatest(({b} + CASE WHEN img_date >= date '2022-01-25' THEN -1000.0::double ELSE 0.0::double END)/10000.0::double, 0.0::double), 1.0::double)"
RB = {b: REFL.format(b=b) for b in ("b02", "b03", "b04", "b08", "b11", "b12")}
BANDS_SQL = f""", refl AS (SELECT tile_id, r, c, scl, img_date, b02 d02, b03 d03, b04 d04, b08 d08, b11 d11, b12 d12, vv_db, vh_db, {', '.join(f'{e} {b}' for b, e in RB.items())} FROM pixel_ext),
idx AS (SELECT *, CASE WHEN b03+b08 <> 0 THEN (b03-b08)/(b03+b08) ELSE -999999.0::double END ndwi, CASE WHEN b03+b11 <> 0 THEN (b03-b11)/(b03+b11) ELSE -999999.0::double END mndwi,
b02 + 2.5::double*b03 - 1.5::double*(b08+b11) - 0.25::double*b12 awei_sh, 4.0::double*(b03-b11) - (0.25::double*b08 + 2.75::double*b12) awei_nsh FROM refl)"""


def _indices(spark, sf):
    px = X.pixel_ext(spark, sf)
    px = px.withColumns({f"d{b[1:]}": F.col(b) for b in RB}).withColumns({b: B.reflectance(F.col(b), F.col("img_date")) for b in RB})
    c = F.col
    return px.withColumns({"ndwi": B.ndwi(c("b03"), c("b08")), "mndwi": B.mndwi(c("b03"), c("b11")),
                           "awei_sh": B.awei_sh(c("b02"), c("b03"), c("b08"), c("b11"), c("b12")),
                           "awei_nsh": B.awei_nsh(c("b03"), c("b08"), c("b11"), c("b12"))})


@query("water_indices", BANDS_SQL + " SELECT tile_id, r, c, round(b04, 6) red, round(ndwi, 6) ndwi, round(mndwi, 6) mndwi, round(awei_sh, 6) awei_sh, round(awei_nsh, 6) awei_nsh FROM idx", "pixel_ext")
def water_indices(spark, sf):
    return _indices(spark, sf).select(*KEY, r6("b04").alias("red"), *[r6(n).alias(n) for n in ("ndwi", "mndwi", "awei_sh", "awei_nsh")])


@query("missing_masks", BANDS_SQL + """ SELECT tile_id, r, c, d04 = 0 OR ndwi = -999999 OR mndwi = -999999 OR awei_sh = -999999 OR awei_nsh = -999999 optical,
vv_db = -9999 OR vh_db = -9999 OR d04 = 0 radar, d03 = 0 OR d08 = 0 OR ndwi = -999999 selected,
d02 = 0 OR d03 = 0 OR d08 = 0 OR d11 = 0 OR d12 = 0 OR awei_sh = -999999 indices_only FROM idx""", "pixel_ext")
def missing_masks(spark, sf):
    c = F.col
    numbers = {"blue": "d02", "green": "d03", "red": "d04", "nir": "d08", "swir1": "d11", "swir2": "d12"}
    bands = {**{b: (c(n), None) for b, n in numbers.items()}, "ndwi": (None, c("ndwi")), "awei_sh": (None, c("awei_sh"))}
    picked, alone = (B.selected_missing(s, bands) for s in (["green", "nir", "ndwi", "dem"], ["awei_sh", "dem"]))
    return _indices(spark, sf).select(*KEY, B.optical_missing(c("d04"), c("ndwi"), c("mndwi"), c("awei_sh"), c("awei_nsh")).alias("optical"),
                                      B.radar_missing(c("vv_db"), c("vh_db"), c("d04")).alias("radar"), picked.alias("selected"), alone.alias("indices_only"))


@query("exported_indices", BANDS_SQL + " SELECT tile_id, r, c, " + ", ".join(f"round(CASE WHEN d04 = 0 THEN -999999.0::double ELSE {n} END, 6) {n}" for n in ("ndwi", "mndwi", "awei_sh", "awei_nsh")) + " FROM idx", "pixel_ext")
def exported_indices(spark, sf):
    return _indices(spark, sf).select(*KEY, *[r6(B.blanked(F.col(n), F.col("d04"))).alias(n) for n in ("ndwi", "mndwi", "awei_sh", "awei_nsh")])


@query("download_ndwi", f""" SELECT tile_id, r, c, round(CASE WHEN b03=0 OR b08=0 THEN -999999.0::double WHEN img_date >= date '2022-01-25' THEN
CASE WHEN {RB['b03']}+{RB['b08']} <> 0 THEN ({RB['b03']}-{RB['b08']})/({RB['b03']}+{RB['b08']}) ELSE -999999.0::double END
ELSE CASE WHEN b03+b08 <> 0 THEN (b03-b08)/(b03+b08)::double ELSE -999999.0::double END END, 6) ndwi FROM pixel_ext""", "pixel_ext")
def download_ndwi(spark, sf):
    c = F.col
    return X.pixel_ext(spark, sf).select(*KEY, r6(B.download_ndwi(c("b03"), c("b08"), c("img_date"))).alias("ndwi"))


@query("radar_scales", """SELECT tile_id, r, c, round(CASE WHEN vv_db <> -9999 THEN pow(10, vv_db/10) ELSE 0 END, 9) power, round(sqrt(pow(10, vh_db/10)), 9) amplitude,
round(CASE WHEN v > 0 THEN 10*log10(v) ELSE -9999 END, 6) db, round(least(greatest((vv_db+30)/30, 0), 1), 6) unit FROM pixel_ext""", "pixel_ext")
def radar_scales(spark, sf):
    c = F.col
    return X.pixel_ext(spark, sf).select(*KEY, r6(B.db_to_power(c("vv_db")), 9).alias("power"), r6(B.db_to_amplitude(c("vh_db")), 9).alias("amplitude"),
                                         r6(B.db_scale(c("v"))).alias("db"), r6(B.clip_normalize(c("vv_db"), -30, 0)).alias("unit"))


@query("label_and_color", """SELECT tile_id, r, c, CASE WHEN scl <> 0 THEN 1 ELSE 0 END label, round((dn % 256)/255.0::double, 6) tci FROM pixel_ext""", "pixel_ext")
def label_and_color(spark, sf):
    return X.pixel_ext(spark, sf).select(*KEY, B.binarize(F.col("scl")).alias("label"), r6(B.unit_byte(F.col("dn") % 256)).alias("tci"))


LONG = """, long AS (SELECT tile_id, r, c, 'vv' channel, vv_db value FROM pixel_ext UNION ALL SELECT tile_id, r, c, 'vh', vh_db FROM pixel_ext UNION ALL SELECT tile_id, r, c, 'dem', dn::double FROM pixel_ext),
ok AS (SELECT * FROM pixel_ext WHERE NOT (vv_db = -9999 OR vh_db = -9999 OR b04 = 0)),
st AS (SELECT 'vv' channel, count(*) n, avg(vv_db) mean, stddev_samp(vv_db) std, min(vv_db) lo, max(vv_db) hi FROM ok UNION ALL SELECT 'vh', count(*), avg(vh_db), stddev_samp(vh_db), min(vh_db), max(vh_db) FROM ok
UNION ALL SELECT 'dem', count(*), avg(dn), stddev_samp(dn), min(dn)::double, max(dn)::double FROM ok UNION ALL SELECT 'target', count(*), 0, 1, min(target)::double, max(target)::double FROM ok)"""


def _radar_ok():
    return ~B.radar_missing(F.col("vv_db"), F.col("vh_db"), F.col("b04"))


def _stats(spark, sf):
    px = X.pixel_ext(spark, sf).withColumns({"vv": F.col("vv_db"), "vh": F.col("vh_db"), "dem": F.col("dn")})
    return px, S.masked_moments(px, ["vv", "vh", "dem", "target"], _radar_ok(), ["target"])


@query("channel_statistics", LONG + " SELECT channel, n, round(mean, 6) mean, round(std, 6) std, lo min, hi max FROM st", "pixel_ext")
def channel_statistics(spark, sf):
    st = _stats(spark, sf)[1]
    return st.select("channel", "n", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max")


@query("statistics_by_updates", LONG + " SELECT channel, n, round(mean, 6) mean, round(std, 6) std, lo min, hi max FROM st", "pixel_ext")
def statistics_by_updates(spark, sf):
    """The statistics of all tiles, kept as a state: three updates, the last of which writes parts again that were there."""
    px, path = _stats(spark, sf)[0].withColumn("batch", F.col("tile_id") % 9), scratch_folder(spark)
    for batches in ((0, 1, 2, 3), (4, 5, 6), (3, 6, 7, 8)):
        P.update_state(P.partial_moments(px.where(F.col("batch").isin(*batches)), "batch", ["vv", "vh", "dem", "target"], _radar_ok()), path)
    st = P.final_moments(P.merged_moments(P.state(spark, path)), ["target"])
    return st.select("channel", "n", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max")


@query("standardized_channels", LONG + " SELECT l.tile_id, l.r, l.c, l.channel, round((value - CASE WHEN l.channel='vv' THEN -14.5 ELSE mean END)/CASE WHEN l.channel='vv' THEN 3.0 ELSE std END, 5) value FROM long l JOIN st ON st.channel=l.channel", "pixel_ext")
def standardized_channels(spark, sf):
    px, st = _stats(spark, sf)
    override = st.where("channel = 'vv'").select("channel", F.lit(-14.5).alias("mean"), F.lit(3.0).alias("std"))
    out = S.standardized(S.long_channels(px, KEY, ["vv", "vh", "dem"]), st, "value", override)
    return out.select(*KEY, "channel", r6("value", 5).alias("value"))


@query("denormalized_channels", LONG + " SELECT l.tile_id, l.r, l.c, l.channel, round(value*std + mean, 4) value FROM long l JOIN st ON st.channel=l.channel WHERE l.channel <> 'dem'", "pixel_ext")
def denormalized_channels(spark, sf):
    px, st = _stats(spark, sf)
    rows = S.long_channels(px, KEY, ["vv", "vh"]).join(F.broadcast(st.select("channel", "mean", "std")), "channel")
    return rows.select(*KEY, "channel", r6(B.denormalize(F.col("value"), F.col("mean"), F.col("std")), 4).alias("value"))


@query("population_statistics", "SELECT 'b03' channel, round(avg(b03), 6) mean, round(stddev_pop(b03), 6) std FROM pixel_ext WHERE b04 <> 0 UNION ALL SELECT 'b08', round(avg(b08), 6), round(stddev_pop(b08), 6) FROM pixel_ext WHERE b04 <> 0", "pixel_ext")
def population_statistics(spark, sf):
    return rounded(S.population_moments(X.pixel_ext(spark, sf), ["b03", "b08"], F.col("b04") != 0))


@query("running_mean_var", "SELECT nlcd, round(avg(v), 6) mean, round(var_pop(v), 6) \"var\" FROM pixel_ext GROUP BY nlcd", "pixel_ext")
def running_mean_var(spark, sf):
    return rounded(S.running_mean_var(X.pixel_ext(spark, sf), ["nlcd"], "v"))


@query("imputed_tiles", """, m AS (SELECT tile_id, avg(vv_db) mean FROM pixel_ext WHERE vv_db <> -9999 GROUP BY tile_id) SELECT p.tile_id, r, c, round(CASE WHEN vv_db = -9999 THEN coalesce(mean, 0) ELSE vv_db END, 6) vv_db FROM pixel_ext p LEFT JOIN m ON m.tile_id=p.tile_id""", "pixel_ext")
def imputed_tiles(spark, sf):
    px = X.pixel_ext(spark, sf).select(*KEY, "vv_db")
    return S.imputed(px, ["tile_id"], "vv_db", F.col("vv_db") == -9999.0).select(*KEY, r6("vv_db").alias("vv_db"))


@query("imputed_from_training", LONG + " SELECT l.tile_id, l.r, l.c, l.channel, round(CASE WHEN value = -9999 THEN mean ELSE value END, 5) value FROM long l JOIN st ON st.channel=l.channel", "pixel_ext")
def imputed_from_training(spark, sf):
    px, st = _stats(spark, sf)
    return S.imputed_from_stats(S.long_channels(px, KEY, ["vv", "vh", "dem"]), st, "value", F.col("value") == -9999.0).select(*KEY, "channel", r6("value", 5).alias("value"))


@query("gray_quantized", """, m AS (SELECT tile_id, min(v) lo, max(v) hi FROM pixel_ext GROUP BY tile_id) SELECT p.tile_id, r, c, CASE WHEN lo = hi THEN 0 ELSE cast(round_even(least(greatest((v-lo)/(hi-lo), 0), 1)*63, 0) AS int) END level FROM pixel_ext p JOIN m ON m.tile_id=p.tile_id""", "pixel_ext")
def gray_quantized(spark, sf):
    px = X.pixel_ext(spark, sf)
    span = px.groupBy("tile_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return px.join(span, "tile_id").select(*KEY, B.quantize(F.col("v"), F.col("lo"), F.col("hi"), 64).alias("level"))


@query("gray_colormap", """, m AS (SELECT tile_id, min(vv_db) lo, max(vv_db) hi FROM pixel_ext WHERE vv_db <> -9999 GROUP BY tile_id), u AS (SELECT p.tile_id, r, c, vv_db, CASE WHEN hi=lo THEN 0 ELSE (vv_db-lo)/(hi-lo) END u FROM pixel_ext p JOIN m ON m.tile_id=p.tile_id)
SELECT tile_id, r, c, CASE WHEN vv_db = -9999 THEN 0 ELSE cast(least(greatest(floor(u*256), 0), 255) AS int) END red FROM u""", "pixel_ext")
def gray_colormap(spark, sf):
    return R.gray_levels(X.pixel_ext(spark, sf).select(*KEY, "vv_db"), "vv_db", nodata=-9999.0).select(*KEY, "red")


def _rgb_sql(system, column):
    rgb = class_rgb(system)
    return ", ".join("CASE {} {} ELSE 0 END {}".format(column, " ".join(f"WHEN {k} THEN {v[i]}" for k, v in rgb.items()), f"{column}_{n}") for i, n in enumerate(("red", "green", "blue")))


def class_color_columns(column, system):
    from pyspark.sql import functions as F
    out = []
    for i, n in enumerate(("red", "green", "blue")):
        pairs = [F.lit(v) for code, rgb in class_rgb(system).items() for v in (code, rgb[i])]
        out.append(F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column).cast("int")), F.lit(0)).alias(f"{column}_{n}"))
    return out


@query("class_colors", f"SELECT tile_id, r, c, {_rgb_sql('nlcd', 'nlcd')}, {_rgb_sql('scl', 'scl')} FROM pixel_ext", "pixel_ext")
def class_colors(spark, sf):
    return X.pixel_ext(spark, sf).select(*KEY, *class_color_columns("nlcd", "nlcd"), *class_color_columns("scl", "scl"))


@query("channel_selection", BANDS_SQL + " SELECT tile_id, r, c, round(b04, 6) red, round(b03, 6) green, round(b08, 6) nir, round(ndwi, 6) ndwi FROM idx", "pixel_ext")
def channel_selection(spark, sf):
    px = _indices(spark, sf).withColumns({"red": F.col("b04"), "green": F.col("b03"), "blue": F.col("b02"), "nir": F.col("b08")})
    return rounded(K.select_channels(px, "1101001000000000", "s2", KEY))


MIXD = "(({k} + {s})::bigint*2654435761) % 4294967296"


@query("flip_rotate", f""", dr AS (SELECT vec_id tile_id, {MIXD.format(k='vec_id', s=3)} >= 2147483648 fh, {MIXD.format(k='vec_id', s=4)} >= 2147483648 fv, cast(floor({MIXD.format(k='vec_id', s=5)}*4/4294967296.0::double) AS int) k FROM embeddings),
s AS (SELECT p.tile_id, CASE WHEN fv THEN 7-r ELSE r END r, CASE WHEN fh THEN 7-c ELSE c END c, v, k FROM pixel p JOIN dr ON dr.tile_id=p.tile_id)
SELECT tile_id, cast(CASE k WHEN 0 THEN r*8+c WHEN 1 THEN (7-c)*8+r WHEN 2 THEN (7-r)*8+7-c ELSE c*8+7-r END AS int) pos, v FROM s""", "pixel")
def flip_rotate(spark, sf):
    tiles = X.tile(spark, sf)
    turned = G.augmented(F.col("data"), 8, *G.augmentation_draws(F.col("tile_id"), 3, "mix").values())
    return tiles.select("tile_id", F.posexplode(turned).alias("pos", "v"))


@query("permuted_channels", X.permutation_sql(9) + """ SELECT p.tile_id, p.pos, q.vv_db, q.vh_db, p.dn FROM pixel_ext p JOIN pm ON pm.pos=p.pos JOIN pixel_ext q ON q.tile_id=p.tile_id AND q.pos=pm.src""", "pixel_ext")
def permuted_channels(spark, sf):
    t, data = F.col("tile_id"), F.col("data")
    tiles = X.tile(spark, sf).select(
        t, F.transform(data, lambda v, p: F.when((t * 64 + p) % 97 == 0, F.lit(-9999.0)).otherwise(v * 20 - 15)).alias("vv_db"),
        F.transform(data, lambda v, p: F.when((t * 64 + p) % 89 == 0, F.lit(-9999.0)).otherwise(v * 15 - 20)).alias("vh_db"),
        F.transform(data, lambda v: F.floor((v + 1) * 5000).cast("int")).alias("dn"))
    moved = G.permute_channels(tiles, ["vv_db", "vh_db"], 8, 9, "mix")
    return moved.select(t, F.posexplode(F.arrays_zip("vv_db", "vh_db", "dn")).alias("pos", "_p")).select(t, "pos", "_p.vv_db", "_p.vh_db", "_p.dn")


@query("score_maps", """, s AS (SELECT *, 1/(1+exp(-v*8)) p FROM pixel_ext), t AS (SELECT *, CASE WHEN vv_db = -9999 THEN 0 WHEN p >= 0.55 THEN 1 ELSE 0 END m, CASE WHEN p > 0.5 THEN 1 ELSE 0 END e FROM s)
SELECT tile_id, r, c, round(p, 6) p, m water, cast(m*255 AS smallint) band1, target=0 AND e=1 false_positive, target=1 AND e=0 false_negative FROM t""", "pixel_ext")
def score_maps(spark, sf):
    p = B.sigmoid(F.col("v") * 8)
    rows = X.pixel_ext(spark, sf).withColumn("p", p)
    water = B.masked_prediction(B.predicted(F.col("p"), 0.55, inclusive=True), F.col("vv_db") == -9999.0)
    return rows.withColumn("water", water).select(*KEY, r6("p").alias("p"), "water", B.export_bands(F.col("water"))[0],
                                                  *B.error_maps(F.col("target"), B.predicted(F.col("p"), 0.5)))


@query("control_point_shift", """, o AS (SELECT l_orderkey tile_id, (l_quantity*3 - l_linenumber*11)/10.0::double dx, (l_linenumber*17 - l_quantity*2)/10.0::double dy FROM lineitem) SELECT tile_id, cast(round_even(quantile_cont(dx, 0.5), 0) AS int) shift_x, cast(round_even(quantile_cont(dy, 0.5), 0) AS int) shift_y FROM o GROUP BY tile_id""".replace(", o AS", "WITH o AS", 1))
def control_point_shift(spark, sf):
    points = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tile_id"), (F.col("l_quantity") * 3).alias("mapX"), (F.col("l_linenumber") * 11).cast("double").alias("sourceX"),
        (F.col("l_linenumber") * 17).cast("double").alias("mapY"), (F.col("l_quantity") * 2).alias("sourceY"))
    return K.median_shift(points, ["tile_id"])


@query("cover_percent", "SELECT tile_id, cast(floor(sum(CASE WHEN scl IN (0,8,9) THEN 1 ELSE 0 END)::bigint/count(*)*100) AS int) cover_pct FROM pixel_ext GROUP BY tile_id", "pixel_ext")
def cover_percent(spark, sf):
    return S.cover_percent(X.pixel_ext(spark, sf), ["tile_id"])


@query("radar_missing_percent", "SELECT tile_id, cast(floor(count(*) FILTER (v <= 0)/count(*)*100) AS int) missing_int, round(count(*) FILTER (v <= 0)/count(*)*100, 6) missing_pct FROM pixel_ext GROUP BY tile_id", "pixel_ext")
def radar_missing_percent(spark, sf):
    return rounded(S.radar_missing_percent(X.pixel_ext(spark, sf), ["tile_id"], "v"))


@query("class_percent", "SELECT tile_id, cast(floor(count(*) FILTER (b04 < 500)/count(*)*100) AS int) null_pct, cast(floor(count(*) FILTER (scl IN (4,6))/count(*)*100) AS int) class_pct FROM pixel_ext GROUP BY tile_id", "pixel_ext")
def class_percent(spark, sf):
    px = X.pixel_ext(spark, sf).withColumn("dark", F.when(F.col("b04") < 500, 0).otherwise(F.col("b04") + 1))
    return S.class_percent(px, ["tile_id"], "dark", "scl", [4, 6])


@query("patch_fractions", "SELECT tile_id, avg(CASE WHEN vv_db = -9999 OR vh_db = -9999 OR b04 = 0 THEN 1.0::double ELSE 0 END) missing_fraction, avg(CASE WHEN scl IN (8,9) THEN 1.0::double ELSE 0 END) cloud_fraction FROM pixel_ext GROUP BY tile_id", "pixel_ext")
def patch_fractions(spark, sf):
    return S.patch_fractions(X.pixel_ext(spark, sf), ["tile_id"], ~_radar_ok())


@query("label_pixel_stats", "SELECT nlcd, sum(target)::double pos, greatest(count(*) - sum(target), 1)::double neg, count(*)::double total, round(greatest(1, least(greatest(count(*) - sum(target), 1)/greatest(sum(target), 1), 3)), 6) pos_weight FROM pixel_ext GROUP BY nlcd", "pixel_ext")
def label_pixel_stats(spark, sf):
    return rounded(S.label_pixel_stats(X.pixel_ext(spark, sf), ["nlcd"], "target", 3))


@query("wet_patches", "SELECT tile_id, cast(sum(target) > 17 AS int) wet FROM pixel_ext GROUP BY tile_id", "pixel_ext")
def wet_patches(spark, sf):
    return S.wet_patches(X.pixel_ext(spark, sf), ["tile_id"], "target", 17)


@query("water_share", ", t AS (SELECT tile_id, avg(target)*100 w FROM pixel_ext GROUP BY tile_id) SELECT round(avg(w), 6) water_pct, round(avg(100-w), 6) dry_pct FROM t", "pixel_ext")
def water_share(spark, sf):
    return rounded(S.water_share(X.pixel_ext(spark, sf), "tile_id", "target"))


@query("db_histogram", ", l AS (SELECT 'vv' k, vv_db x FROM pixel_ext UNION ALL SELECT 'vh', vh_db FROM pixel_ext) SELECT k, cast(least(floor((x+30)/0.6::double), 49) AS int) bin, count(*) n FROM l WHERE x BETWEEN -30 AND 0 GROUP BY 1, 2", "pixel_ext")
def db_histogram(spark, sf):
    px = X.pixel_ext(spark, sf)
    rows = px.select(F.lit("vv").alias("k"), F.col("vv_db").alias("x")).unionByName(px.select(F.lit("vh").alias("k"), F.col("vh_db").alias("x")))
    return S.histogram(rows, ["k"], "x", -30, 0)


@query("odd_label_tiles", "SELECT tile_id, count(*) FILTER (v NOT IN (0, 255)) odd_pixels FROM (SELECT tile_id, CASE WHEN dn % 199 = 3 THEN 7 WHEN dn % 2 = 0 THEN 255 ELSE 0 END v FROM pixel_ext) GROUP BY 1 HAVING odd_pixels > 0", "pixel_ext")
def odd_label_tiles(spark, sf):
    rows = X.pixel_ext(spark, sf).select("tile_id", F.when(F.col("dn") % 199 == 3, 7).when(F.col("dn") % 2 == 0, 255).otherwise(0).alias("v"))
    return S.odd_labels(rows, "tile_id", "v")


@query("look_average", "SELECT stack_id, r, c, round(avg(prob), 6) prob, count(*) looks FROM pixel_ext GROUP BY 1, 2, 3", "pixel_ext")
def look_average(spark, sf):
    return rounded(S.look_average(X.pixel_ext(spark, sf), ["stack_id", "r", "c"], "prob"))
