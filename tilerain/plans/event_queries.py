"""Registered queries on rain events and dates."""

from pyspark.sql import functions as F

from tilerain.functions import dates as D
from tilerain.operators import events as E
from tilerain.plans import fixtures as X
from tilerain.plans.event_plan import select_event_scenes
from tilerain.plans.registry import flat_box, query

BOX = """(-125 + x*0.25::double) minx, (50 + (y+1)*(-0.25::double)) miny, (-125 + (x+1)*0.25::double) maxx,
    (50 + y*(-0.25::double)) maxy"""
EID = "concat(strftime(date '2024-01-01' + t, '%Y%m%d'), '_', y, '_', x)"


@query("event_scene_selection", f"""
, ev AS (SELECT {EID} eid, cast(date '2024-01-01' + t AS date) event_date, t, y, x, precip FROM precip_cell_day p
    WHERE precip > 250 AND NOT EXISTS (SELECT 1 FROM history h WHERE h.t=p.t AND h.y=p.y AND h.x=p.x)),
bx AS (SELECT eid, event_date, x*0.25::double - 125 x0, (x+1)*0.25::double - 125 x1, (y+1)*(-0.25)::double + 50 y0, y*(-0.25)::double + 50 y1 FROM ev),
o AS (SELECT e.eid, e.event_date, s.* FROM bx e JOIN catalog s ON minx <= x1 AND maxx >= x0 AND miny <= y1 AND maxy >= y0 WHERE sensor='s2'
    AND cast(dt AS date) BETWEEN event_date - 2 AND event_date + 4),
q AS (SELECT e.eid, e.event_date, s.* FROM bx e JOIN catalog s ON minx <= x1 AND maxx >= x0 AND miny <= y1 AND maxy >= y0 WHERE sensor='s1'
    AND imode='IW' AND cast(dt AS date) BETWEEN event_date - 2 AND event_date + 5),
o1 AS (SELECT * FROM o WHERE EXISTS (SELECT 1 FROM q WHERE q.eid=o.eid AND abs(epoch_us(q.dt)-epoch_us(o.dt)) < 43200000000)),
q1 AS (SELECT * FROM q WHERE EXISTS (SELECT 1 FROM o1 WHERE q.eid=o1.eid AND abs(epoch_us(q.dt)-epoch_us(o1.dt)) < 43200000000)),
o2 AS (SELECT * FROM o1 WHERE NOT cover_pct > 60),
m AS (SELECT eid, min(crs) main_crs FROM o2 GROUP BY 1),
ch AS (SELECT * FROM (SELECT o2.*, main_crs, cast(dt AS date) scene_date, row_number() OVER (PARTITION BY o2.eid, cast(dt AS date)
    ORDER BY CASE WHEN crs=main_crs THEN 0 ELSE 1 END, crs, ord) rn FROM o2 JOIN m ON m.eid=o2.eid) WHERE rn=1),
ma AS (SELECT * FROM (SELECT q1.*, ch.main_crs, ch.scene_date, row_number() OVER (PARTITION BY q1.eid, q1.item_id
    ORDER BY abs(epoch_us(q1.dt)-epoch_us(ch.dt)), ch.ord) rk FROM q1 JOIN ch ON ch.eid=q1.eid
    AND abs(epoch_us(q1.dt)-epoch_us(ch.dt)) < 43200000000) WHERE rk=1 AND NOT missing_pct > 60),
rc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eid, scene_date
    ORDER BY CASE WHEN crs=main_crs THEN 0 ELSE 1 END, crs, ord) rn FROM ma) WHERE rn=1)
SELECT ch.eid, ch.scene_date, ch.main_crs, ch.item_id s2_item, rc.item_id s1_item, rc.dt s1_dt, ev.event_date, ev.precip
FROM ch LEFT JOIN rc ON rc.eid=ch.eid AND rc.scene_date=ch.scene_date JOIN ev ON ev.eid=ch.eid WHERE ch.eid IN (SELECT eid FROM rc)
""", "history catalog")
def event_scene_selection(spark, sf):
    return select_event_scenes(X.precip_cell_day(spark, sf), X.catalog(spark, sf), X.history(spark, sf), 250, 2, 4, 12, 60,
                               X.GEOTRANSFORM, X.START)


@query("extreme_events", f"""SELECT {EID} eid, cast(date '2024-01-01' + t AS date) event_date, t, y, x, precip, {BOX}
FROM precip_cell_day p WHERE precip > 300 AND NOT EXISTS (SELECT 1 FROM history h WHERE h.t=p.t AND h.y=p.y AND h.x=p.x)""",
       "history")
def extreme_events(spark, sf):
    hits = E.extreme_events(X.precip_cell_day(spark, sf), 300, X.history(spark, sf))
    return flat_box(E.describe_events(hits, X.GEOTRANSFORM, X.START))


@query("extreme_events_first", """, region AS (SELECT y, x FROM precip_cell_day GROUP BY y, x HAVING sum(precip) > 4000)
SELECT t, y, x, precip FROM precip_cell_day p WHERE precip > 200 AND t >= 3
AND EXISTS (SELECT 1 FROM region g WHERE g.y=p.y AND g.x=p.x)
AND NOT EXISTS (SELECT 1 FROM history h WHERE h.t=p.t AND h.y=p.y AND h.x=p.x) ORDER BY t, y, x LIMIT 40""", "history")
def extreme_events_first(spark, sf):
    cells = X.precip_cell_day(spark, sf)
    region = cells.groupBy("y", "x").agg(F.sum("precip").alias("s")).where("s > 4000")
    return E.extreme_events(cells, 200, X.history(spark, sf), region, first_day=3, limit=40)


@query("manual_events", """, listed AS (SELECT DISTINCT cast(ts AS date) - 10 event_date, cast(floor(user_id/15) AS int) y,
    cast(user_id % 15 AS int) x FROM events)
SELECT l.t, l.y, l.x, CASE WHEN l.t < 0 THEN 0.0::double ELSE p.precip END precip,
    CASE WHEN l.x % 3 = 0 THEN 'EPSG:32614' END crs
FROM (SELECT cast(date_diff('day', date '2024-01-01', cast(event_date AS date)) AS int) t, y, x FROM listed) l
LEFT JOIN precip_cell_day p ON p.t=l.t AND p.y=l.y AND p.x=l.x
WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.t=l.t AND h.y=l.y AND h.x=l.x)""", "history")
def manual_events(spark, sf):
    listed = (X._cell(X.table(spark, sf, "events")).select(F.date_sub(F.col("ts").cast("date"), 10).alias("event_date"), "y", "x")
              .distinct().withColumn("crs", F.when(F.col("x") % 3 == 0, "EPSG:32614")))
    return E.manual_events(listed, X.precip_cell_day(spark, sf), X.history(spark, sf), X.START)


@query("event_id_round_trip", f"""SELECT {EID} eid, cast(date '2024-01-01' + t AS date) event_date, y, x, t FROM precip_cell_day""",
       "precip_cell_day")
def event_id_round_trip(spark, sf):
    ids = X.precip_cell_day(spark, sf).select(D.event_id(D.index_to_date(F.col("t"), X.START), F.col("y"), F.col("x")).alias("eid"))
    eid = F.col("eid")
    day = D.event_id_part(eid, "date")
    return ids.select("eid", day.alias("event_date"), D.event_id_part(eid, "y").alias("y"), D.event_id_part(eid, "x").alias("x"),
                      D.date_to_index(day, X.START).alias("t"))


@query("random_events", """, pool AS (SELECT DISTINCT y, x FROM precip_cell_day), drawn AS (
    SELECT y, x, ((y*15+x+7)::bigint*2654435761) % 4294967296 k, cast((((y*15+x+8)::bigint*2654435761) % 4294967296) % 30 AS int) t FROM pool)
SELECT c.t, c.y, c.x, p.precip FROM (SELECT * FROM drawn d WHERE NOT EXISTS
    (SELECT 1 FROM history h WHERE h.t=d.t AND h.y=d.y AND h.x=d.x) ORDER BY k, y, x LIMIT 60) c
LEFT JOIN precip_cell_day p ON p.t=c.t AND p.y=c.y AND p.x=c.x""", "history")
def random_events(spark, sf):
    cells = X.precip_cell_day(spark, sf)
    pool = cells.select("y", "x").distinct()
    return E.random_events(pool, cells, 30, 60, 7, X.history(spark, sf), "mix", F.col("y") * 15 + F.col("x"))


@query("dry_interval_starts", """, w AS (SELECT y, x, t, count(*) OVER (PARTITION BY y, x) n,
    sum(CASE WHEN precip >= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING) bad
    FROM precip_dense) SELECT y, x, t FROM w WHERE bad = 0 AND t <= n - 5""", "precip_dense")
def dry_interval_starts(spark, sf):
    return E.dry_interval_starts(X.precip_dense(spark, sf), 5, 150, 2)


@query("all_interval_starts", "SELECT y, x, t FROM precip_dense WHERE t < 30 - 5", "precip_dense")
def all_interval_starts(spark, sf):
    return E.dry_interval_starts(X.precip_dense(spark, sf), 5, None)


@query("sampled_intervals", """, w AS (SELECT y, x, t, count(*) OVER (PARTITION BY y, x) n,
    sum(CASE WHEN precip >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN 1 PRECEDING AND 5 FOLLOWING) bad
    FROM precip_dense), st AS (SELECT y, x, t FROM w WHERE bad = 0 AND t <= n - 6),
tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY ((t+5)::bigint*2654435761) % 4294967296, t) turn FROM st)),
ins AS (SELECT tr.*, s.orbit, s.missing_pct, s.ord, cast(s.dt AS date) d FROM tr JOIN scene s ON s.y=tr.y AND s.x=tr.x
    AND s.orbit <> '' AND s.sensor='s1' AND cast(s.dt AS date) BETWEEN date '2024-01-01' + tr.t AND date '2024-01-01' + tr.t + 6),
best AS (SELECT y, x, t, turn, orbit, d, min(missing_pct) m FROM ins GROUP BY ALL HAVING min(missing_pct) <= 70),
us AS (SELECT y, x, t, turn, orbit, count(*) n_days FROM best GROUP BY ALL HAVING count(*) >= 3),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y, x, t ORDER BY
    ((t*2 + CASE WHEN orbit='ascending' THEN 1 ELSE 0 END + 6)::bigint*2654435761) % 4294967296, orbit) rn FROM us) WHERE rn=1),
j AS (SELECT tr.y, tr.x, tr.t, tr.turn, pk.orbit FROM tr LEFT JOIN pk ON pk.y=tr.y AND pk.x=tr.x AND pk.t=tr.t),
k AS (SELECT *, coalesce(sum(CASE WHEN orbit IS NULL THEN 0 ELSE 1 END) OVER w, 0) won,
    coalesce(sum(CASE WHEN orbit IS NULL THEN 1 ELSE 0 END) OVER w, 0) lost FROM j
    WINDOW w AS (PARTITION BY y, x ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT y, x, t, orbit FROM k WHERE orbit IS NOT NULL AND won < 2 AND lost < 4""", "precip_dense scene")
def sampled_intervals(spark, sf):
    starts = E.dry_interval_starts(X.precip_dense(spark, sf), 6, 200, 1)
    radar = X.scene(spark, sf).where("sensor = 's1'")
    return E.sampled_intervals(starts, radar, 6, 3, 70, 2, 4, 5, X.START, "mix")


@query("date_formats", """, s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y%m%d')
    WHEN 2 THEN strftime(ts, '%d/%m/%Y') ELSE concat(strftime(ts, '%Y%m'), '99') END txt FROM events)
SELECT event_id, txt, cast(coalesce(try_strptime(txt, '%Y-%m-%d'), try_strptime(txt, '%Y%m%d')) AS date) parsed FROM s""".replace(", s AS", "WITH s AS", 1))
def date_formats(spark, sf):
    e = F.col("event_id")
    text = (F.when(e % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(e % 4 == 1, F.date_format("ts", "yyyyMMdd"))
            .when(e % 4 == 2, F.date_format("ts", "dd/MM/yyyy")).otherwise(F.concat(F.date_format("ts", "yyyyMM"), F.lit("99"))))
    return X.table(spark, sf, "events").select("event_id", text.alias("txt")).withColumn("parsed", D.parse_date(F.col("txt")))


@query("date_intervals", """SELECT o_orderkey, concat(strftime(d - 3, '%Y-%m-%d'), '/', strftime(d + 7, '%Y-%m-%d')) around,
strftime(d, '%Y-%m-%d') single, concat(strftime(d - 3, '%Y-%m-%d'), '/', strftime(d + 9, '%Y-%m-%d')) radar,
concat(strftime(d, '%Y-%m-%d'), '/', strftime(d + 12, '%Y-%m-%d')) to_latest, cast(d - 1 AS timestamp) + INTERVAL 12 HOUR rain_start,
cast(d - 1 AS timestamp) scoring_start, least(greatest(cast(year(d) AS int), 1994), 1997) class_year
FROM (SELECT o_orderkey, cast(o_orderdate AS date) d FROM orders)""")
def date_intervals(spark, sf):
    day = F.col("d")
    rows = X.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return rows.select("o_orderkey", D.date_interval(day, 3, 7).alias("around"), D.date_interval(day, 0, 0).alias("single"),
                       D.date_interval(day, 3, D.radar_days_after(7, 36)).alias("radar"),
                       D.interval_to_latest(day, F.date_add(day, 10), 2).alias("to_latest"),
                       D.rain_day_start(day).alias("rain_start"), D.rain_day_start(day, 0).alias("scoring_start"),
                       D.clamped_year(F.year(day), 1994, 1997).alias("class_year"))


@query("area_bounds", """SELECT fcode, round(min(minx) - (max(maxx)-min(minx))*0.2, 6) minx, round(min(miny) - (max(maxy)-min(miny))*0.2, 6) miny,
round(max(maxx) + (max(maxx)-min(minx))*0.2, 6) maxx, round(max(maxy) + (max(maxy)-min(miny))*0.2, 6) maxy FROM feature GROUP BY fcode""", "feature")
def area_bounds(spark, sf):
    total = X.feature(spark, sf).groupBy("fcode").agg(D.buffered_bounds(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).alias("bbox"))
    flat = flat_box(total)
    return flat.select("fcode", *[F.round(c, 6).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


@query("codes_and_names", """WITH n AS (SELECT c_custkey, concat(CASE WHEN c_custkey % 3 = 0 THEN 'EPSG' ELSE 'EPSG:' END, c_custkey) code,
concat(CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE 'n' END, 25 + c_custkey % 25, 'w', 70 + c_custkey % 55, '.tif') nm FROM customer)
SELECT c_custkey, regexp_full_match(code, 'EPSG:[0-9]+') is_epsg,
CASE WHEN c_custkey % 4 <> 0 THEN -(70 + c_custkey % 55)::double END minx, CASE WHEN c_custkey % 4 <> 0 THEN (25 + c_custkey % 25 - 1)::double END miny,
CASE WHEN c_custkey % 4 <> 0 THEN (1 - (70 + c_custkey % 55))::double END maxx, CASE WHEN c_custkey % 4 <> 0 THEN (25 + c_custkey % 25)::double END maxy FROM n""")
def codes_and_names(spark, sf):
    k = F.col("c_custkey")
    rows = X.table(spark, sf, "customer").select(
        k, F.concat(F.when(k % 3 == 0, "EPSG").otherwise("EPSG:"), k.cast("string")).alias("code"),
        F.concat(F.when(k % 4 == 0, "x").otherwise("n"), (25 + k % 25).cast("string"), F.lit("w"), (70 + k % 55).cast("string"),
                 F.lit(".tif")).alias("nm"))
    return flat_box(rows.select(k, D.is_epsg(F.col("code")).alias("is_epsg"), D.elevation_bounds(F.col("nm")).alias("bbox")))


@query("streamed_events", f"""SELECT {EID} eid, t, y, x, precip FROM precip_cell_day WHERE precip > 280""", "precip_cell_day")
def streamed_events(spark, sf):
    """Cell-days written to a landing folder, then taken in by the stream in several micro-batches."""
    from tilerain.session import scratch_folder
    from tilerain.streaming.intake import recorded, start_intake
    base = scratch_folder(spark)
    X.precip_cell_day(spark, sf).repartition("t").write.parquet(f"{base}/landing")
    start_intake(spark, f"{base}/landing", f"{base}/events", f"{base}/offsets", 280, X.GEOTRANSFORM, X.START, 2).awaitTermination()
    return recorded(spark, f"{base}/events").select("eid", "t", "y", "x", "precip")


@query("keyed_intake", f"""SELECT {EID} eid, t, y, x, precip FROM precip_cell_day WHERE precip > 280""", "precip_cell_day")
def keyed_intake(spark, sf):
    """As streamed_events, with every cell-day landed twice and known the second time by the stream's own state."""
    from tilerain.session import scratch_folder
    from tilerain.streaming.intake import start_keyed_intake
    base = scratch_folder(spark)
    for _ in range(2):
        X.precip_cell_day(spark, sf).write.mode("append").parquet(f"{base}/landing")
    start_keyed_intake(spark, f"{base}/landing", f"{base}/events", f"{base}/offsets", 280, X.GEOTRANSFORM, X.START, max_files=8).awaitTermination()
    return spark.read.parquet(f"{base}/events").select("eid", "t", "y", "x", "precip")
