"""Registered queries on list parsing, file catalogs, metadata, labels and splits."""

from pyspark.sql import functions as F

from tilerain.operators import patches as G
from tilerain.operators import stacking as K
from tilerain.operators import scoring as W
from tilerain.plans import fixtures as X
from tilerain.plans.registry import query
from tilerain.sources import catalog as C
from tilerain.sources import sinks as O
from tilerain.sources import text_lists as T

LINES = """WITH l AS (SELECT event_id + 1 line_no, concat(CASE event_id % 2 WHEN 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y%m%d') END,
CASE WHEN event_id % 19 = 0 THEN '0' ELSE '' END, ', ', CASE WHEN event_id % 17 = 0 THEN 'y' WHEN event_id % 23 = 0 THEN '-3' ELSE cast(user_id//15 AS varchar) END,
CASE WHEN event_id % 29 = 0 THEN '' ELSE concat(' ,', user_id % 15) END,
CASE event_id % 5 WHEN 0 THEN concat(', EPSG:326', 10 + event_id % 9) WHEN 1 THEN CASE WHEN event_id % 31 = 0 THEN ', EPSG:abc' ELSE '' END ELSE '' END) line,
event_id, event_id % 13 = 0 comment FROM events)"""
JUDGED = LINES + """, j AS (SELECT line_no, string_split(line, ',') p, event_id FROM l WHERE NOT comment), k AS (
SELECT line_no, trim(p[1]) a, trim(p[2]) b, trim(p[3]) c, trim(p[4]) d, len(p) n FROM j), m AS (SELECT *,
cast(coalesce(CASE WHEN regexp_full_match(a, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN try_strptime(a, '%Y-%m-%d') END,
CASE WHEN regexp_full_match(a, '[0-9]{8}') THEN try_strptime(a, '%Y%m%d') END) AS date) dd FROM k), q AS (SELECT *, CASE
WHEN n NOT IN (3,4) THEN 'needs 3 or 4 fields between commas' WHEN length(a) NOT IN (8,10) OR dd IS NULL THEN 'unreadable date'
WHEN n = 4 AND NOT regexp_full_match(d, 'EPSG:[0-9]+') THEN 'unknown CRS code' WHEN NOT (regexp_full_match(b, '[+-]?[0-9]+') AND regexp_full_match(c, '[+-]?[0-9]+')) THEN 'row or column is no whole number'
WHEN try_cast(b AS int) < 0 OR try_cast(c AS int) < 0 THEN 'row or column below 0' END reason FROM m)"""


def _lines(spark, sf):
    e = F.col("event_id")
    rows = X._cell(X.table(spark, sf, "events"))
    date = F.when(e % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyyMMdd"))
    y = F.when(e % 17 == 0, "y").when(e % 23 == 0, "-3").otherwise(F.col("y").cast("string"))
    crs = F.when(e % 5 == 0, F.concat(F.lit(", EPSG:326"), (10 + e % 9).cast("string"))).when(
        (e % 5 == 1) & (e % 31 == 0), ", EPSG:abc").otherwise("")
    line = F.concat(F.when(e % 13 == 0, "# ").otherwise(""), date, F.when(e % 19 == 0, "0").otherwise(""), F.lit(", "), y,
                    F.when(e % 29 == 0, "").otherwise(F.concat(F.lit(" ,"), F.col("x").cast("string"))), crs)
    return rows.select((e + 1).alias("line_no"), line.alias("line"), e)


@query("event_list", JUDGED + " SELECT line_no, dd event_date, cast(b AS int) y, cast(c AS int) x, CASE WHEN n = 4 THEN d END crs FROM q WHERE reason IS NULL")
def event_list(spark, sf):
    return T.parse_event_list(_lines(spark, sf).drop("event_id"))[0]


@query("event_list_errors", JUDGED + " SELECT line_no, concat('line ', line_no, ': ', reason) reason FROM q WHERE reason IS NOT NULL")
def event_list_errors(spark, sf):
    return T.parse_event_list(_lines(spark, sf).drop("event_id"))[1]


@query("cell_list", """SELECT event_id line_no, cast(user_id//15 AS int) y, cast(user_id % 15 AS int) x, CASE WHEN event_id % 3 = 0 THEN 'EPSG:32614' END crs
FROM events WHERE event_id % 7 <> 0""")
def cell_list(spark, sf):
    e = F.col("event_id")
    rows = X._cell(X.table(spark, sf, "events")).select(e.alias("line_no"), F.concat(
        F.when(e % 7 == 0, "#").otherwise(""), F.col("y").cast("string"), F.lit(", "), F.col("x").cast("string"),
        F.when(e % 3 == 0, ", EPSG:32614").otherwise("")).alias("line"))
    return T.parse_cell_list(rows)[0]


@query("event_id_list", "SELECT concat('#', event_id) eid FROM events WHERE event_id % 10 <> 0")
def event_id_list(spark, sf):
    e = F.col("event_id")
    rows = X.table(spark, sf, "events").select(F.when(e % 10 == 0, "   ").otherwise(F.concat(F.lit("  #"), e.cast("string"), F.lit(" "))).alias("line"))
    return T.parse_id_list(rows)


@query("roads_by_state", """SELECT s.s_suppkey road_id, lpad(cast(s_nationkey AS varchar), 2, '0') fips, upper(n_name) state FROM supplier s JOIN nation ON n_nationkey = s_nationkey""")
def roads_by_state(spark, sf):
    code = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    fips = T.parse_fips(X.table(spark, sf, "nation").select(F.concat(code("n_nationkey"), F.lit(","), F.col("n_name")).alias("line")))
    roads = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("road_id"), F.concat(
        F.lit("tl_rd22_"), code("s_nationkey"), F.lpad((F.col("s_suppkey") % 997).cast("string"), 3, "0"), F.lit("_roads.shp")).alias("file_name"))
    return T.roads_by_state(roads, fips).select("road_id", "fips", "state")


@query("file_catalog", """SELECT name, size_bytes, 'sar' kind, name[5:12] img_date, name[14:21] s1_date, regexp_extract(name, '([0-9]{8}_[0-9]+_[0-9]+)_v[vh]', 1) eid,
regexp_extract(name, '_(v[vh]).tif', 1) polarization FROM raster_file""", "raster_file")
def file_catalog(spark, sf):
    return C.named_files(X.raster_file(spark, sf))


@query("stack_catalog", """SELECT concat('multi_20240101-202402', lpad(cast(1 + o_orderkey % 28 AS varchar), 2, '0'), '_', o_orderkey % 600, '_', o_custkey % 1400, CASE WHEN o_orderkey % 2 = 0 THEN '_vv' ELSE '_vh' END, '.tif') name,
'20240101' start_date, concat('202402', lpad(cast(1 + o_orderkey % 28 AS varchar), 2, '0')) end_date, cast(o_orderkey % 600 AS int) y, cast(o_custkey % 1400 AS int) x,
CASE WHEN o_orderkey % 2 = 0 THEN 'vv' ELSE 'vh' END polarization FROM orders WHERE o_orderkey % 3 <> 0""")
def stack_catalog(spark, sf):
    k = F.col("o_orderkey")
    rows = X.table(spark, sf, "orders").select(F.concat(
        F.when(k % 3 == 0, "old_").otherwise("multi_"), F.lit("20240101-202402"), F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lit("_"),
        (k % 600).cast("string"), F.lit("_"), (F.col("o_custkey") % 1400).cast("string"), F.when(k % 2 == 0, "_vv").otherwise("_vh"),
        F.lit(".tif")).alias("name"))
    return C.named_stacks(rows)


@query("event_metadata", """SELECT cast(event_id AS varchar) eid, cast(ts AS date) event_date, CASE WHEN event_id % 3 > 0 THEN 'EPSG:32614' END crs, event_type state, cast(user_id AS double) minx, cast(user_id AS double) + 0.5 maxx FROM events""")
def event_metadata(spark, sf):
    e = F.col("event_id")
    inner = F.struct(e.cast("string").alias("Sample ID"), F.when(e % 2 == 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("Precipitation Event Date"),
                     F.when(e % 3 > 0, "EPSG:32614").alias("CRS"), F.col("event_type").alias("State"),
                     F.struct(F.col("user_id").cast("double").alias("minx"), (F.col("user_id") + 0.5).alias("maxx")).alias("Bounding Box"))
    rows = X.table(spark, sf, "events").select(F.when(e % 2 == 0, F.to_json(F.struct(inner.alias("metadata")))).otherwise(F.to_json(inner)).alias("json"))
    return C.parse_metadata(rows).select("eid", "event_date", "crs", "state", "bbox.minx", "bbox.maxx")


@query("event_products", """SELECT eid, array_to_string(list_sort(list(concat(strftime(d, '%Y-%m-%d'), '=', item_id)) FILTER (sensor='s2')), ',') s2, array_to_string(list_sort(list(concat(strftime(d, '%Y-%m-%d'), '=', item_id)) FILTER (sensor='s1')), ',') s1
FROM (SELECT concat(y, '_', x) eid, sensor, cast(dt AS date) d, min(item_id) item_id FROM scene GROUP BY ALL) GROUP BY eid""", "scene")
def event_products(spark, sf):
    chosen = X.scene(spark, sf).groupBy(F.concat_ws("_", "y", "x").alias("eid"), "sensor", F.col("dt").cast("date").alias("scene_date")).agg(F.min("item_id").alias("item_id"))
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda s: F.concat(s["key"], F.lit("="), s["value"])), ",")
    return C.products_by_date(chosen).select("eid", flat(F.col("s2_products")).alias("s2"), flat(F.col("s1_products")).alias("s1"))


@query("labeled_events", """SELECT regexp_extract(p, 'label_[0-9]{8}_([0-9]{8}_[0-9]+_[0-9]+).tif', 1) eid, arg_min(dir, rk) dir FROM (SELECT concat('labels/label_20240102_20240101_', o_custkey, '_', o_orderkey % 9, '.tif') p,
concat('set', o_orderkey % 4) dir, cast(o_orderkey % 4 AS int) rk FROM orders WHERE o_orderkey % 6 <> 0) GROUP BY 1""")
def labeled_events(spark, sf):
    k = F.col("o_orderkey")
    paths = X.table(spark, sf, "orders").select(F.concat(F.when(k % 6 == 0, "labels/pred").otherwise("labels/label"), F.lit("_20240102_20240101_"), F.col("o_custkey").cast("string"), F.lit("_"),
                                                         (k % 9).cast("string"), F.lit(".tif")).alias("path"),
                                                F.concat(F.lit("set"), (k % 4).cast("string")).alias("dir"), (k % 4).cast("int").alias("dir_rank"))
    return K.labeled_events(paths)


LABELS = """WITH cap AS (SELECT DISTINCT o_orderkey img_date, o_custkey eid FROM orders), lab AS (SELECT o_orderkey img_date, o_custkey eid, CASE WHEN o_orderkey % 4 = 0 THEN 'manual' ELSE 'machine' END source,
cast(o_orderkey % 7 AS int) dir_rank, concat('a', o_orderkey) path FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_custkey, 'manual', cast(o_orderkey % 3 AS int), concat('b', o_orderkey) FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, o_custkey, 'machine', 0, concat('c', o_orderkey) FROM orders WHERE o_orderkey % 2 = 0)"""


@query("label_choice", LABELS + """ SELECT img_date, eid, source label_source, path label_path FROM (SELECT c.*, source, path, row_number() OVER (PARTITION BY c.img_date, c.eid ORDER BY CASE WHEN source='manual' THEN 0 ELSE 1 END, dir_rank, path) rn
FROM cap c JOIN lab l ON l.img_date=c.img_date AND l.eid=c.eid) WHERE rn=1""")
def label_choice(spark, sf):
    o = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("img_date"), F.col("o_custkey").alias("eid"))
    k = F.col("img_date")
    make = lambda rows, source, rank, tag: rows.select("img_date", "eid", source.alias("source"), rank.cast("int").alias("dir_rank"), F.concat(F.lit(tag), k.cast("string")).alias("path"))
    labels = make(o.where(k % 5 != 0), F.when(k % 4 == 0, "manual").otherwise("machine"), k % 7, "a").unionByName(
        make(o.where(k % 3 == 0), F.lit("manual"), k % 3, "b")).unionByName(make(o.where(k % 2 == 0), F.lit("machine"), F.lit(0), "c"))
    tied = labels.groupBy("img_date", "eid", "source", "dir_rank").agg(F.min("path").alias("path"))
    return K.chosen_labels(o.distinct(), tied)


FOLDERS = ["purchase", "view", "click", "signup", "error"]


@query("first_folder_wins", f"""SELECT user_id, arg_min(event_id, rk::bigint * 1000000000 + event_id) event_id, cast(min(rk) AS int) dir_rank FROM (SELECT user_id, event_id, list_position({FOLDERS}, event_type) - 1 rk FROM events) GROUP BY user_id""")
def first_folder_wins(spark, sf):
    e = X.table(spark, sf, "events")
    part = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return K.union_once([part(kind) for kind in FOLDERS], ["user_id"]).select("user_id", "event_id", "dir_rank")


FILE_PATTERNS = {"VV": r"sar_\d{8}.*_vv\.tif", "VH": r"sar_\d{8}.*_vh\.tif"}


@query("event_completeness", """, f AS (SELECT regexp_extract(name, '([0-9]{8}_[0-9]+_[0-9]+)_v', 1) eid, name, size_bytes FROM raster_file), g AS (
SELECT eid, bool_or(name LIKE '%_vv.tif' AND size_bytes > 0) vv, bool_or(name LIKE '%_vh.tif' AND size_bytes > 0) vh FROM f GROUP BY eid)
SELECT eid, concat_ws(',', CASE WHEN NOT vv THEN 'VV' END, CASE WHEN NOT vh THEN 'VH' END) missing, vv AND vh complete FROM g""", "raster_file")
def event_completeness(spark, sf):
    files = C.named_files(X.raster_file(spark, sf)).select("eid", "name", "size_bytes")
    return K.missing_files(files, FILE_PATTERNS).withColumn("missing", F.array_join("missing", ","))


RASTERS = """WITH r AS (SELECT l_orderkey eid, concat(lpad(cast(l_linenumber AS varchar), 2, '0'), '_', l_partkey, '_', l_suppkey, '_', l_extendedprice) name, CASE WHEN l_partkey % 97 = 0 THEN 399 ELSE 400 END h, 400 w,
CASE WHEN l_suppkey % 50 = 7 THEN 'EPSG:32613' WHEN l_suppkey % 50 = 9 THEN NULL ELSE 'EPSG:32614' END crs, CASE WHEN l_partkey % 61 = 0 THEN 10.5::double ELSE 10.0::double END sx FROM lineitem)"""


@query("listed_event_completeness", """, f AS (SELECT regexp_extract(name, '([0-9]{8}_[0-9]+_[0-9]+)_v', 1) eid, name, size_bytes FROM raster_file), e AS (
SELECT DISTINCT concat('20240101_', o_custkey % 40, '_', o_orderkey % 50) eid FROM orders), g AS (
SELECT eid, coalesce(bool_or(name LIKE '%_vv.tif' AND size_bytes > 0), false) vv, coalesce(bool_or(name LIKE '%_vh.tif' AND size_bytes > 0), false) vh FROM e LEFT JOIN f USING (eid) GROUP BY eid)
SELECT eid, concat_ws(',', CASE WHEN NOT vv THEN 'VV' END, CASE WHEN NOT vh THEN 'VH' END) missing, vv AND vh complete FROM g""", "raster_file")
def listed_event_completeness(spark, sf):
    files = C.named_files(X.raster_file(spark, sf)).select("eid", "name", "size_bytes")
    part = lambda c, n: (F.col(c) % n).cast("string")
    events = X.table(spark, sf, "orders").select(F.concat(F.lit("20240101_"), part("o_custkey", 40), F.lit("_"), part("o_orderkey", 50)).alias("eid")).distinct()
    return K.missing_files(files, FILE_PATTERNS, events).withColumn("missing", F.array_join("missing", ","))


@query("raster_consistency", RASTERS + """, d AS (SELECT DISTINCT * FROM r), f AS (SELECT *, first_value(h) OVER w rh, first_value(crs) OVER w rc, first_value(sx) OVER w rs FROM d WINDOW w AS (PARTITION BY eid ORDER BY name)),
b AS (SELECT *, CASE WHEN h <> rh THEN 'shape' WHEN crs IS DISTINCT FROM rc THEN 'crs' WHEN abs(sx - rs) >= 0.00001 THEN 'transform' END reason FROM f)
SELECT eid, count(*) total_files, min(name) FILTER (reason IS NOT NULL) mismatched_file, arg_min(reason, name) FILTER (reason IS NOT NULL) reason, NOT bool_or(reason IS NOT NULL) is_valid FROM b GROUP BY eid""")
def raster_consistency(spark, sf):
    li = X.table(spark, sf, "lineitem")
    p = F.col("l_partkey")
    rasters = li.select(
        F.col("l_orderkey").alias("eid"), F.concat_ws("_", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), p.cast("string"), F.col("l_suppkey").cast("string"), F.col("l_extendedprice").cast("string")).alias("name"),
        F.when(p % 97 == 0, 399).otherwise(400).alias("h"), F.lit(400).alias("w"),
        F.when(F.col("l_suppkey") % 50 == 7, "EPSG:32613").when(F.col("l_suppkey") % 50 == 9, None).otherwise("EPSG:32614").alias("crs"),
        F.array(F.when(p % 61 == 0, 10.5).otherwise(10.0), *[F.lit(0.0)] * 5).alias("transform")).distinct()
    return K.inconsistent_rasters(rasters)


PAIRS = """WITH f AS (SELECT l_orderkey k, l_suppkey s, CASE WHEN l_linenumber % 2 = 0 THEN 'vv' ELSE 'vh' END pol, CASE WHEN l_partkey % 11 = 0 THEN 399 ELSE 400 END h FROM lineitem),
g AS (SELECT k, s, max(h) FILTER (pol='vv') a, max(h) FILTER (pol='vh') b FROM f GROUP BY k, s)"""


def _pol_files(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"), F.when(F.col("l_linenumber") % 2 == 0, "vv").otherwise("vh").alias("polarization"),
        F.when(F.col("l_partkey") % 11 == 0, 399).otherwise(400).alias("h"), F.lit(400).alias("w"))


@query("polarization_pairs", PAIRS + " SELECT k, s, a h, 400 w FROM g WHERE a = b")
def polarization_pairs(spark, sf):
    return K.polarization_pairs(_pol_files(spark, sf), ["k", "s"])


@query("despeckle_targets", PAIRS + ", d AS (SELECT DISTINCT l_orderkey k, l_suppkey s FROM lineitem WHERE l_partkey % 4 = 0) SELECT g.k eid, g.s s2_date, g.s s1_date FROM g LEFT JOIN d ON d.k=g.k AND d.s=g.s WHERE a IS NOT NULL AND b IS NOT NULL AND d.k IS NULL")
def despeckle_targets(spark, sf):
    files = _pol_files(spark, sf).select(F.col("k").alias("eid"), F.col("s").alias("s2_date"), F.col("s").alias("s1_date"), "polarization")
    done = X.table(spark, sf, "lineitem").where("l_partkey % 4 = 0").select(
        F.col("l_orderkey").alias("eid"), F.col("l_suppkey").alias("s2_date"), F.col("l_suppkey").alias("s1_date"))
    return W.despeckle_targets(files, done)


@query("filter_variants", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 3 = 1")
def filter_variants(spark, sf):
    p = F.col("l_partkey")
    rows = X.table(spark, sf, "lineitem").withColumn("variant", F.when(p % 3 == 0, "sar").when(p % 3 == 1, "enhanced_lee").otherwise("cvae"))
    return W.sar_variant(rows, "enhanced_lee").select("l_orderkey", "l_linenumber", "l_partkey")


@query("pending_cells", "SELECT t, y, x, precip FROM precip_cell_day p WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.t=p.t AND h.y=p.y AND h.x=p.x)", "history")
def pending_cells(spark, sf):
    return O.pending(X.precip_cell_day(spark, sf), X.history(spark, sf), ["t", "y", "x"])


SPLIT = """, n AS (SELECT c_custkey k, row_number() OVER (ORDER BY ((c_custkey + 11)::bigint*2654435761) % 4294967296, c_custkey) rk, count(*) OVER () n FROM customer),
h AS (SELECT k, rk <= ceil(n*(0.1::double+0.2::double)) held FROM n), g AS (SELECT k, row_number() OVER (ORDER BY ((k + 1233)::bigint*2654435761) % 4294967296, k) rk, count(*) OVER () n FROM h WHERE held),
sp AS (SELECT k c_custkey, 'train' split FROM h WHERE NOT held UNION ALL SELECT k, CASE WHEN rk <= ceil(n*(0.2::double/(0.1::double+0.2::double))) THEN 'test' ELSE 'val' END FROM g)""".replace(", n AS", "WITH n AS", 1)


def _split(spark, sf):
    return G.random_split(X.table(spark, sf, "customer").select("c_custkey"), "c_custkey", 0.1, 0.2, 11, "mix")


@query("random_split", SPLIT + " SELECT c_custkey, split FROM sp")
def random_split(spark, sf):
    return _split(spark, sf)


@query("split_manifest", SPLIT + " SELECT split, c_custkey, count(*) OVER (PARTITION BY split) n FROM sp")
def split_manifest(spark, sf):
    return O.split_manifest(_split(spark, sf), "c_custkey")


@query("listed_split", """, sp AS (SELECT DISTINCT y, x, CASE WHEN (y+x) % 3 = 0 THEN 'test' ELSE 'train' END split FROM scene WHERE (y*15+x) % 7 <> 0)
SELECT item_id, split FROM scene s JOIN sp ON sp.y=s.y AND sp.x=s.x""", "scene")
def listed_split(spark, sf):
    scenes = X.scene(spark, sf)
    splits = scenes.select("y", "x").distinct().where("(y*15+x) % 7 <> 0").withColumn("split", F.when((F.col("y") + F.col("x")) % 3 == 0, "test").otherwise("train"))
    return G.listed_split(scenes, splits).select("item_id", "split")


@query("metrics_documents", """SELECT o_orderstatus split, concat('{"loss":', to_json(round(max(o_totalprice), 2)), ',"none":null}') json FROM orders GROUP BY 1""")
def metrics_documents(spark, sf):
    top = X.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("split")).agg(F.round(F.max("o_totalprice"), 2).alias("v"))
    rows = top.select("split", F.lit("loss").alias("name"), F.col("v").alias("value")).unionByName(
        top.select("split", F.lit("none").alias("name"), F.lit(float("nan")).alias("value")))
    return O.metrics_json(rows, ["split"])
