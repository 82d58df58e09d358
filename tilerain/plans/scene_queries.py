"""Registered queries on scenes, pairing and box joins."""

from pyspark.sql import functions as F

from tilerain.functions import dates as D
from tilerain.operators import pairing as P
from tilerain.operators import scenes as S
from tilerain.operators.boxes import box_overlap
from tilerain.operators.events import describe_events
from tilerain.plans import fixtures as X
from tilerain.plans.registry import query

CELL = ["y", "x"]


def _box(y, x):
    return F.struct((x * 1.0).alias("minx"), (y * 1.0).alias("miny"), (x + 1.0).alias("maxx"), (y + 1.0).alias("maxy"))


@query("scene_search", """SELECT item_id, y, x, dt FROM scene WHERE sensor='s2' AND x BETWEEN 2 AND 9 AND y BETWEEN 1 AND 7
AND dt >= timestamp '2024-01-05' AND dt < timestamp '2024-01-13' AND cover_pct <= 50 AND orbit = 'ascending'""", "scene")
def scene_search(spark, sf):
    catalog = X.scene(spark, sf).withColumn("bbox", _box(F.col("y"), F.col("x"))).withColumn("properties", F.create_map(
        F.lit("eo:cloud_cover"), F.col("cover_pct").cast("string"), F.lit("sat:orbit_state"), F.col("orbit")))
    found = S.search(catalog, "s2", (3.0, 2.0, 9.5, 7.0), "2024-01-05", "2024-01-12",
                     {"eo:cloud_cover": ("lte", 50), "sat:orbit_state": ("eq", "ascending")})
    return found.select("item_id", "y", "x", "dt")


@query("scene_assets", """, a AS (SELECT item_id, sensor, CASE item_id % 3 WHEN 0 THEN 'mpc' WHEN 1 THEN 'aws' ELSE 'cdse' END provider,
CASE WHEN sensor='s1' THEN 'vv' ELSE 'B11' END band, CASE WHEN item_id % 2 = 0 THEN NULL ELSE crs END own FROM scene)
SELECT a.item_id, provider, band, CASE WHEN a.sensor='other' THEN NULL WHEN a.sensor='s1' THEN 'vv' WHEN provider='mpc' THEN 'B11' WHEN provider='aws' THEN 'swir16' ELSE 'B11_20m' END asset,
coalesce(own, CASE WHEN a.item_id % 4 = 0 THEN 'EPSG:4326' ELSE crs END) item_crs FROM a JOIN scene s ON s.item_id=a.item_id""", "scene")
def scene_assets(spark, sf):
    i = F.col("item_id")
    rows = X.scene(spark, sf).select(
        i, F.when(i % 3 == 0, "mpc").when(i % 3 == 1, "aws").otherwise("cdse").alias("provider"), "sensor",
        F.when(F.col("sensor") == "s1", "vv").otherwise("B11").alias("band"), F.when(i % 2 != 0, F.col("crs")).alias("own"),
        F.array(F.lit(None).cast("string"), F.when(i % 4 == 0, "EPSG:4326").otherwise(F.col("crs")), F.lit("EPSG:1")).alias("assets"))
    return rows.select("item_id", "provider", "band", S.asset_name(F.col("provider"), F.col("sensor"), F.col("band")).alias("asset"),
                       S.item_crs(F.col("own"), F.col("assets")).alias("item_crs"))


EVENTS_SQL = """, ev AS (SELECT concat(strftime(date '2024-01-01' + t, '%Y%m%d'), '_', y, '_', x) eid,
    cast(date '2024-01-01' + t AS date) event_date, x ex, x*0.25::double - 125 bx, (x+1)*0.25::double - 125 cx,
    (y+1)*(-0.25)::double + 50 by_, y*(-0.25)::double + 50 cy FROM precip_cell_day WHERE precip > 300)"""
SEARCH_SQL = EVENTS_SQL + """, es AS (SELECT e.eid, e.event_date, e.ex, s.* FROM ev e JOIN catalog s
    ON minx <= cx AND maxx >= bx AND miny <= cy AND maxy >= by_ WHERE (sensor='s2' AND cast(dt AS date) BETWEEN event_date - 3 AND event_date + 2)
    OR (sensor='s1' AND imode='IW' AND cast(dt AS date) BETWEEN event_date - 3 AND event_date + 3))"""


def _events(spark, sf):
    cells = X.precip_cell_day(spark, sf).where("precip > 300")
    return describe_events(cells, X.GEOTRANSFORM, X.START)


def _event_scenes(spark, sf):
    return S.search_events(_events(spark, sf).select("eid", "event_date", "bbox"), X.catalog(spark, sf), 3, 2, 12)


@query("scenes_of_events", SEARCH_SQL + " SELECT eid, item_id, sensor, dt FROM es", "precip_cell_day catalog")
def scenes_of_events(spark, sf):
    return _event_scenes(spark, sf).select("eid", "item_id", "sensor", "dt")


@query("clear_scenes", "SELECT item_id, cover_pct FROM scene WHERE NOT cover_pct > 40", "scene")
def clear_scenes(spark, sf):
    return S.below_cover(X.scene(spark, sf), 40).select("item_id", "cover_pct")


@query("class_rich_scenes", """SELECT event_id, cast(event_id*41 % 101 AS int) null_pct, cast(event_id*59 % 101 AS int) class_pct FROM events
WHERE event_id*41 % 101 <= 30 AND event_id*59 % 101 >= 20""")
def class_rich_scenes(spark, sf):
    e = F.col("event_id")
    rows = X.table(spark, sf, "events").select(e, (e * 41 % 101).cast("int").alias("null_pct"), (e * 59 % 101).cast("int").alias("class_pct"))
    return S.class_rich(rows, 30, 20)


@query("events_with_later_scene", SEARCH_SQL + """ SELECT eid FROM es WHERE sensor='s2' GROUP BY eid
HAVING bool_or(dt >= cast(event_date - 1 AS timestamp) + INTERVAL 12 HOUR)
AND bool_or(cast(cast(dt AS date) AS timestamp) >= cast(event_date - 1 AS timestamp) + INTERVAL 12 HOUR AND NOT cover_pct > 30)""", "precip_cell_day catalog")
def events_with_later_scene(spark, sf):
    return S.events_with_scene_after(_event_scenes(spark, sf).where("sensor = 's2'"), 30)


@query("post_event_scenes", SEARCH_SQL + " SELECT eid, item_id FROM es WHERE dt >= cast(event_date - 1 AS timestamp)", "precip_cell_day catalog")
def post_event_scenes(spark, sf):
    return S.post_event_only(_event_scenes(spark, sf)).select("eid", "item_id")


@query("named_products", "SELECT user_id, concat('S2_', event_id, '_', event_type) item_id FROM events WHERE concat('S2_', event_id, '_', event_type) LIKE '%7_click%' OR concat('S2_', event_id, '_', event_type) LIKE '%99%'")
def named_products(spark, sf):
    rows = X.table(spark, sf, "events").select("user_id", F.concat(F.lit("S2_"), F.col("event_id").cast("string"), F.lit("_"), F.col("event_type")).alias("item_id"))
    return S.id_contains_any(rows, ["7_click", "99"])


@query("dual_polarized_scenes", "SELECT item_id FROM scene WHERE sensor='s1' AND item_id % 4 <> 0 AND item_id % 5 <> 0", "scene")
def dual_polarized_scenes(spark, sf):
    i = F.col("item_id")
    rows = X.scene(spark, sf).where("sensor = 's1'").withColumns({
        "polarizations": F.when(i % 4 == 0, F.array(F.lit("VV"))).otherwise(F.array(F.lit("VV"), F.lit("VH"))),
        "assets": F.when(i % 5 == 0, F.create_map(F.lit("vv"), F.lit("a"))).otherwise(
            F.create_map(F.lit("vv"), F.lit("a"), F.lit("vh"), F.lit("b")))})
    return S.dual_polarized(rows).select("item_id")


def _sensors(spark, sf):
    scene = X.scene(spark, sf)
    return scene.where("sensor = 's2'"), scene.where("sensor = 's1'")


SIX = "abs(epoch_us(a.dt)-epoch_us(b.dt)) < 21600000000"


@query("paired_optical_scenes", f"""SELECT a.item_id, a.y, a.x FROM scene a WHERE sensor='s2' AND EXISTS
(SELECT 1 FROM scene b WHERE b.sensor='s1' AND b.y=a.y AND b.x=a.x AND {SIX})""", "scene")
def paired_optical_scenes(spark, sf):
    optical, radar = _sensors(spark, sf)
    return P.mutual_pairs(optical, radar, CELL, 6)[0].select("item_id", "y", "x")


@query("paired_radar_scenes", f"""SELECT a.item_id, a.y, a.x FROM scene a WHERE sensor='s1' AND EXISTS
(SELECT 1 FROM scene b WHERE b.sensor='s2' AND b.y=a.y AND b.x=a.x AND {SIX})""", "scene")
def paired_radar_scenes(spark, sf):
    optical, radar = _sensors(spark, sf)
    return P.mutual_pairs(optical, radar, CELL, 6)[1].select("item_id", "y", "x")


@query("nearest_optical_scene", f"""SELECT item_id, match_id, match_dt FROM (SELECT a.item_id, b.item_id match_id, b.dt match_dt,
row_number() OVER (PARTITION BY a.item_id ORDER BY abs(epoch_us(a.dt)-epoch_us(b.dt)), b.ord) rn
FROM scene a JOIN scene b ON a.sensor='s1' AND b.sensor='s2' AND b.y=a.y AND b.x=a.x AND {SIX}) WHERE rn=1""", "scene")
def nearest_optical_scene(spark, sf):
    optical, radar = _sensors(spark, sf)
    return P.nearest(radar, optical, CELL, 6).select("item_id", "match_id", "match_dt")


@query("first_optical_within_days", """SELECT item_id, match_id, match_dt FROM (SELECT a.item_id, b.item_id match_id, b.dt match_dt,
row_number() OVER (PARTITION BY a.item_id ORDER BY b.ord) rn FROM scene a JOIN scene b ON a.sensor='s1' AND b.sensor='s2' AND b.y=a.y AND b.x=a.x
AND abs(epoch_us(a.dt)-epoch_us(b.dt)) // 86400000000 <= 2) WHERE rn=1""", "scene")
def first_optical_within_days(spark, sf):
    optical, radar = _sensors(spark, sf)
    return P.first_within_days(radar, optical, CELL, 2).select("item_id", "match_id", "match_dt")


@query("primary_scene_per_date", SEARCH_SQL + """ SELECT eid, scene_date, item_id, crs FROM (SELECT *, cast(dt AS date) scene_date, row_number() OVER
(PARTITION BY eid, cast(dt AS date) ORDER BY CASE WHEN crs='EPSG:32615' THEN 0 ELSE 1 END, crs, ord) rn FROM es WHERE sensor='s2') WHERE rn=1""", "precip_cell_day catalog")
def primary_scene_per_date(spark, sf):
    rows = _event_scenes(spark, sf).where("sensor = 's2'")
    return S.primary_per_date(rows, ["eid"], F.lit("EPSG:32615")).select("eid", "scene_date", "item_id", "crs")


@query("event_crs", SEARCH_SQL + """ SELECT eid, CASE WHEN any_value(ex) % 4 = 0 THEN 'EPSG:99999' ELSE min(crs) END crs FROM es GROUP BY eid""", "precip_cell_day catalog")
def event_crs(spark, sf):
    manual = _events(spark, sf).select("eid", F.when(F.col("x") % 4 == 0, "EPSG:99999").alias("crs"))
    return S.event_crs(_event_scenes(spark, sf), manual)


@query("orbit_stacks", """, b AS (SELECT *, cast(dt AS date) scene_date, row_number() OVER (PARTITION BY y, x, orbit, cast(dt AS date) ORDER BY missing_pct, ord) rn
FROM scene WHERE orbit <> ''), k AS (SELECT *, cast(row_number() OVER (PARTITION BY y, x, orbit ORDER BY dt, ord) - 1 AS int) acq_idx,
count(*) OVER (PARTITION BY y, x, orbit) n FROM b WHERE rn=1 AND missing_pct <= 60)
SELECT y, x, orbit, scene_date, item_id, missing_pct, acq_idx FROM k WHERE n >= 7 AND acq_idx < 7""", "scene")
def orbit_stacks(spark, sf):
    rows = S.by_orbit(X.scene(spark, sf).withColumn("orbit", F.upper("orbit")))
    return S.best_per_orbit_date(rows, CELL, 60, 7, require_n=True).select("y", "x", "orbit", "scene_date", "item_id", "missing_pct", "acq_idx")


@query("best_scene_per_date", """SELECT y, x, scene_date, item_id FROM (SELECT *, cast(dt AS date) scene_date, row_number() OVER
(PARTITION BY y, x, cast(dt AS date) ORDER BY missing_pct, ord) rn FROM scene) WHERE rn=1""", "scene")
def best_scene_per_date(spark, sf):
    return S.best_per_date(X.scene(spark, sf), CELL).select("y", "x", "scene_date", "item_id")


@query("scene_dates_and_crs", """SELECT y, x, array_to_string(list_sort(list(DISTINCT strftime(dt, '%Y-%m-%d'))), ',') dates,
array_to_string(list_sort(list(DISTINCT crs)), ',') crs_list FROM scene GROUP BY y, x""", "scene")
def scene_dates_and_crs(spark, sf):
    lists = S.date_and_crs_lists(X.scene(spark, sf), CELL)
    return lists.select("y", "x", F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"),
                        F.array_join("crs_list", ",").alias("crs_list"))


FEATURE_EVENTS = ", ev AS (SELECT o_orderkey eid, (o_orderkey % 83)/10.0::double minx, (o_orderkey % 71)/10.0::double miny, (o_orderkey % 83)/10.0::double+0.25 maxx, (o_orderkey % 71)/10.0::double+0.25 maxy FROM orders)"


def _boxed_orders(spark, sf):
    k = F.col("o_orderkey")
    x, y = (k % 83) / F.lit(10.0), (k % 71) / F.lit(10.0)
    return X.table(spark, sf, "orders").select(k.alias("eid"), F.struct(x.alias("minx"), y.alias("miny"), (x + 0.25).alias("maxx"),
                                                                        (y + 0.25).alias("maxy")).alias("bbox"))


def _features(spark, sf):
    return X.feature(spark, sf).select("feature_id", "fcode", F.struct("minx", "miny", "maxx", "maxy").alias("box"))


@query("overlapping_watersheds", FEATURE_EVENTS + """ SELECT eid, count(*) n, cast(sum(feature_id) AS bigint) id_sum FROM ev JOIN feature f ON ev.minx <= f.maxx AND ev.maxx >= f.minx
AND ev.miny <= f.maxy AND ev.maxy >= f.miny AND fcode <> 49300 GROUP BY eid""", "feature")
def overlapping_watersheds(spark, sf):
    kept = _features(spark, sf).where(F.col("fcode") != 49300)
    return box_overlap(_boxed_orders(spark, sf), kept, strict=False, per=["eid"], total="feature_id").withColumnRenamed("total", "id_sum")


@query("flowline_features", "SELECT feature_id, fcode FROM feature WHERE fcode IN (46000,46003,46006,46007,55800,33600,33601,33603,33400,42801,42802,42805,42806,42809)", "feature")
def flowline_features(spark, sf):
    from tilerain.schema import FLOWLINE_FCODES
    return X.feature(spark, sf).where(F.col("fcode").isin(*FLOWLINE_FCODES)).select("feature_id", "fcode")


@query("elevation_tiles_of_events", """, ev AS (SELECT o_orderkey eid, -100.0::double + (o_orderkey % 160)/10.0::double minx, 30.0::double + (o_orderkey % 140)/10.0::double miny FROM orders),
t AS (SELECT DISTINCT concat('n', 30 + s_suppkey % 13, 'w', 84 + s_suppkey % 17, '.tif') nm, 30 + s_suppkey % 13 lat, 84 + s_suppkey % 17 lon FROM supplier),
p AS (SELECT eid, string_agg(nm, ',' ORDER BY nm) names FROM ev JOIN t ON -lon < minx+0.06 AND 1-lon > minx-0.02 AND lat-1 < miny+0.06 AND lat > miny-0.02 GROUP BY eid)
SELECT ev.eid, coalesce(names, '') names, CASE WHEN names IS NULL THEN 'no elevation tile' END error FROM ev LEFT JOIN p ON p.eid=ev.eid""".replace(", ev AS", "WITH ev AS", 1))
def elevation_tiles_of_events(spark, sf):
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    x, y = F.lit(-100.0) + (k % 160) / F.lit(10.0), F.lit(30.0) + (k % 140) / F.lit(10.0)
    events = X.table(spark, sf, "orders").select(k.alias("eid"), F.struct(x.alias("minx"), y.alias("miny"), (x + 0.04).alias("maxx"), (y + 0.04).alias("maxy")).alias("bbox"))
    name = F.concat(F.lit("n"), (30 + s % 13).cast("string"), F.lit("w"), (84 + s % 17).cast("string"), F.lit(".tif"))
    tiles = X.table(spark, sf, "supplier").select(name.alias("name")).distinct().withColumn("box", D.elevation_bounds(F.col("name")))
    return S.elevation_tiles(events, tiles).withColumn("names", F.array_join("names", ","))


@query("state_of_events", """, ev AS (SELECT o_orderkey eid, (o_orderkey % 83)/10.0::double x0, (o_orderkey % 71)/10.0::double y0 FROM orders),
st AS (SELECT n_nationkey ord, n_name state, (n_nationkey % 5)*2.0::double minx, (n_nationkey // 5)*1.5::double miny, (n_nationkey % 5)*2.0::double + 1.7 maxx, (n_nationkey // 5)*1.5::double + 1.6 maxy FROM nation),
c AS (SELECT eid, 0 i, x0 px, y0 py FROM ev UNION ALL SELECT eid, 1, x0+0.25, y0 FROM ev UNION ALL SELECT eid, 2, x0, y0+0.25 FROM ev UNION ALL SELECT eid, 3, x0+0.25, y0+0.25 FROM ev),
h AS (SELECT eid, state, row_number() OVER (PARTITION BY eid ORDER BY i, ord) rn FROM c JOIN st ON px >= minx AND px <= maxx AND py >= miny AND py <= maxy)
SELECT ev.eid, h.state FROM ev LEFT JOIN h ON h.eid=ev.eid AND rn=1""".replace(", ev AS", "WITH ev AS", 1))
def state_of_events(spark, sf):
    n = F.col("n_nationkey")
    x, y = (n % 5) * F.lit(2.0), F.floor(n / 5) * F.lit(1.5)
    states = X.table(spark, sf, "nation").select(F.col("n_name").alias("state"), n.alias("ord"), F.struct(
        x.alias("minx"), y.alias("miny"), (x + 1.7).alias("maxx"), (y + 1.6).alias("maxy")).alias("box"))
    return S.state_of_box(_boxed_orders(spark, sf), states)


@query("area_scenes", """WITH a AS (SELECT s_nationkey area_id, min(s_suppkey % 30 / 10.0::double) x0, max(s_suppkey % 30 / 10.0::double + 0.3::double) x1, min(s_suppkey % 17 / 10.0::double) y0, max(s_suppkey % 17 / 10.0::double + 0.3::double) y1 FROM supplier GROUP BY 1),
b AS (SELECT area_id, x0 - (x1-x0)*0.2 minx, x1 + (x1-x0)*0.2 maxx, y0 - (y1-y0)*0.2 miny, y1 + (y1-y0)*0.2 maxy, date '2024-01-03' + cast(area_id % 10 AS int) sd, CASE WHEN area_id % 3 = 0 THEN 'EPSG:32618' END crs FROM a),
s AS (SELECT event_id item_id, CASE WHEN event_type IN ('click','view') THEN 's2' ELSE 's1' END sensor, ts dt, concat('EPSG:326', cast(13 + event_id % 5 AS varchar)) scrs, cast(event_id*53 % 101 AS double) ms, user_id % 15 + 0.05::double bx, user_id // 15 + 0.05::double by_ FROM events WHERE event_type NOT IN ('click','view') OR concat('P', event_id) LIKE '%1%' OR concat('P', event_id) LIKE '%8%'),
f AS (SELECT area_id, sensor, sd, crs, scrs, item_id, dt, cast(dt AS date) d, ms FROM b JOIN s ON minx <= bx+0.9 AND maxx >= bx AND miny <= by_+0.9 AND maxy >= by_ AND cast(dt AS date) BETWEEN sd AND sd + 14),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY area_id, sensor, d ORDER BY ms, item_id) rn FROM f) WHERE rn=1),
c AS (SELECT area_id, scrs fc FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY CASE WHEN sensor = 's2' THEN 0 ELSE 1 END, dt, item_id) k FROM r) WHERE k=1)
SELECT r.area_id, sensor, d scene_date, cast(item_id AS varchar) item_id, coalesce(crs, fc) crs, 2021 class_year FROM r JOIN c ON c.area_id=r.area_id""")
def area_scenes(spark, sf):
    from tilerain.plans.area_plan import select_area_scenes
    k = F.col("s_suppkey")
    x, y = k % 30 / F.lit(10.0), k % 17 / F.lit(10.0)
    area = F.col("s_nationkey")
    first = F.date_add(F.lit("2024-01-03").cast("date"), (area % 10).cast("int"))
    areas = X.table(spark, sf, "supplier").select(
        area.alias("area_id"), x.alias("minx"), (x + 0.3).alias("maxx"), y.alias("miny"), (y + 0.3).alias("maxy"), first.alias("start_date"),
        F.date_add(first, 14).alias("end_date"), F.when(area % 3 == 0, "EPSG:32618").alias("crs"))
    e = X._cell(X.table(spark, sf, "events"))
    bx, by = F.col("x") + 0.05, F.col("y") + 0.05
    scenes = e.select(F.concat(F.lit("P"), F.col("event_id").cast("string")).alias("item_id"), F.when(F.col("event_type").isin("click", "view"), "s2").otherwise("s1").alias("sensor"),
                      F.col("ts").alias("dt"), F.concat(F.lit("EPSG:326"), (13 + F.col("event_id") % 5).cast("string")).alias("crs"),
                      F.struct(bx.alias("minx"), by.alias("miny"), (bx + 0.9).alias("maxx"), (by + 0.9).alias("maxy")).alias("bbox"),
                      (F.col("event_id") * 53 % 101).cast("double").alias("missing_pct"), F.col("event_id").alias("ord"))
    out = select_area_scenes(areas, scenes, ["1", "8"], None, 0.2, (1985, 2021))
    return out.withColumn("item_id", F.expr("substring(item_id, 2)"))
