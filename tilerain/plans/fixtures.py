"""Input tables of the registered queries, derived by Spark from the given Parquet tables.

`DUCK` holds the same derivations as SQL views for the comparison run.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilerain.schema import NLCD_CLASSES

START = "2024-01-01"
GEOTRANSFORM = (-125.0, 0.25, 0.0, 50.0, 0.0, -0.25)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cell(df: DataFrame) -> DataFrame:
    return df.withColumn("y", F.floor(F.col("user_id") / 15).cast("int")).withColumn("x", (F.col("user_id") % 15).cast("int"))


def precip_cell_day(spark: SparkSession, sf: str) -> DataFrame:
    return (_cell(table(spark, sf, "events")).withColumn("t", F.dayofmonth("ts") - 1).groupBy("t", "y", "x")
            .agg(F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("precip")))


def history(spark: SparkSession, sf: str) -> DataFrame:
    return precip_cell_day(spark, sf).where((F.col("t") + F.col("y") + F.col("x")) % 4 == 0).select("t", "y", "x")


def precip_dense(spark: SparkSession, sf: str) -> DataFrame:
    rain = precip_cell_day(spark, sf)
    grid = rain.select("y", "x").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(29))))
    return grid.join(rain, ["t", "y", "x"], "left").select("t", "y", "x", "precip")


def scene(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return _cell(table(spark, sf, "events")).select(
        e.alias("item_id"), F.when(F.col("event_type").isin("click", "view"), "s2")
        .when(F.col("event_type").isin("purchase", "signup"), "s1").otherwise("other").alias("sensor"), "y", "x",
        F.col("ts").alias("dt"), F.concat(F.lit("EPSG:326"), (13 + e % 5).cast("string")).alias("crs"),
        F.when(e % 3 == 0, "ascending").when(e % 3 == 1, "descending").otherwise("").alias("orbit"),
        (e * 37 % 101).cast("int").alias("cover_pct"), (e * 53 % 101).cast("double").alias("missing_pct"), e.alias("ord"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes with the columns of `schema.SCENE`, and the measured covers. A footprint lies inside its cell; every third one
    reaches into the next cell as well."""
    s, i = scene(spark, sf), F.col("item_id")
    x, y = F.col("x"), F.col("y")
    return s.select(
        i.cast("string").alias("item_id"), "sensor", "dt", "crs",
        F.struct((x * 0.25 - 124.9375).alias("minx"), ((y + 1) * -0.25 + 50.0625).alias("miny"),
                 ((x + F.when(i % 3 == 0, 2).otherwise(1)) * 0.25 - 125.0625).alias("maxx"), (y * -0.25 + 49.9375).alias("maxy")).alias("bbox"),
        F.create_map(F.lit("eo:cloud_cover"), F.col("cover_pct").cast("string"), F.lit("sat:orbit_state"), F.col("orbit"),
                     F.lit("sar:instrument_mode"), F.when(i % 7 == 0, "EW").otherwise("IW")).alias("properties"),
        F.create_map(F.lit("vv"), F.lit("a")).alias("assets"), "ord", F.col("cover_pct"), F.col("missing_pct"))


def raster_file(spark: SparkSession, sf: str) -> DataFrame:
    day = F.lpad(F.dayofmonth("ts").cast("string"), 2, "0")
    tail = F.when(F.col("event_type").isin("click", "view"), "_vv.tif").otherwise("_vh.tif")
    name = F.concat(F.lit("sar_202401"), day, F.lit("_202401"), day, F.lit("_20240101_"), F.col("y").cast("string"),
                    F.lit("_"), F.col("x").cast("string"), tail)
    return _cell(table(spark, sf, "events")).select(
        name.alias("name"), (F.col("event_id") % 7 * 100).cast("bigint").alias("size_bytes")).distinct()


def feature(spark: SparkSession, sf: str) -> DataFrame:
    k, s, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    x, y = (k % 40).cast("double") / 5, (k % 37).cast("double") / 5
    return table(spark, sf, "part").select(
        k.alias("feature_id"), x.alias("minx"), y.alias("miny"), (x + s / F.lit(40.0)).alias("maxx"),
        (y + s / F.lit(60.0)).alias("maxy"),
        F.when(kind == "ECONOMY", 46006).when(kind == "LARGE", 49300).when(kind == "MEDIUM", 33600).otherwise(55800)
        .alias("fcode"))


def tile(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("tile_id"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.transform("embedding", lambda v: v.cast("double")).alias("data"))


def pixel(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("tile_id"), F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    dn, pos, t = F.col("dn"), F.col("pos"), F.col("tile_id")
    return raw.withColumn("dn", F.floor((F.col("v") + 1) * 5000).cast("int")).select(
        "tile_id", F.floor(pos / 8).cast("int").alias("r"), (pos % 8).cast("int").alias("c"), "pos", "v", "dn",
        ((dn * 3 + pos * 211) % 10000).alias("b03"), ((dn * 7 + pos * 97) % 10000).alias("b08"),
        F.when((t * 64 + pos) % 97 == 0, F.lit(-9999.0)).otherwise(F.col("v") * 20 - 15).alias("vv_db"),
        F.floor(t / 5).cast("int").alias("stack_id"), (t % 5).cast("int").alias("acq"))


def pixel_ext(spark: SparkSession, sf: str) -> DataFrame:
    dn, pos, t = F.col("dn"), F.col("pos"), F.col("tile_id")
    codes = F.array(*[F.lit(c) for c in NLCD_CLASSES])
    return pixel(spark, sf).withColumns({
        "b02": (dn * 11 + pos * 53) % 10000, "b04": (dn * 13 + pos * 29) % 10000, "b11": (dn * 17 + pos * 71) % 10000,
        "b12": (dn * 19 + pos * 37) % 10000,
        "vh_db": F.when((t * 64 + pos) % 89 == 0, F.lit(-9999.0)).otherwise(F.col("v") * 15 - 20), "scl": dn % 12,
        "prob": dn / F.lit(10000.0), "target": F.when((dn * 7) % 11 < 3, 1).otherwise(0),
        "nlcd": F.element_at(codes, (dn % 20 + 1).cast("int")),
        "img_date": F.date_add(F.lit("2022-01-20").cast("date"), (t % 10).cast("int"))})


def latent(spark: SparkSession, sf: str) -> DataFrame:
    """Posterior means and log-variances: 32 + 32 of the 64 values; `run` is the label."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").alias("run"),
        F.transform(F.slice("embedding", 1, 32), lambda v: v.cast("double")).alias("mu"),
        F.transform(F.slice("embedding", 33, 32), lambda v: v.cast("double") * 20).alias("log_var"))


def trial(spark: SparkSession, sf: str) -> DataFrame:
    """Trial log: three metrics per trial, some undefined, grouped by a configuration."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("trial"), (k * 31 % 99991).alias("seed"), F.col("o_orderstatus").alias("config"),
        (F.col("o_totalprice") / 1000000).alias("f1"),
        F.when(k % 5 != 0, (k * 17 % 1000) / F.lit(1000.0)).alias("recall"), ((k * 29 % 997) / F.lit(997.0)).alias("loss"))


DUCK = {
    "precip_cell_day": ("", """SELECT cast(day(ts)-1 AS int) t, cast(floor(user_id/15) AS int) y, cast(user_id % 15 AS int) x,
        cast(sum(cast(value AS decimal(12,2))) AS double) precip FROM events GROUP BY 1,2,3"""),
    "history": ("precip_cell_day", "SELECT t, y, x FROM precip_cell_day WHERE (t+y+x) % 4 = 0"),
    "precip_dense": ("precip_cell_day", """SELECT d.t, g.y, g.x, p.precip FROM (SELECT DISTINCT y, x FROM precip_cell_day) g
        CROSS JOIN (SELECT cast(range AS int) t FROM range(30)) d LEFT JOIN precip_cell_day p ON p.t=d.t AND p.y=g.y AND p.x=g.x"""),
    "scene": ("", """SELECT event_id item_id, CASE WHEN event_type IN ('click','view') THEN 's2'
        WHEN event_type IN ('purchase','signup') THEN 's1' ELSE 'other' END sensor,
        cast(floor(user_id/15) AS int) y, cast(user_id % 15 AS int) x, ts dt,
        concat('EPSG:326', cast(13 + event_id % 5 AS varchar)) crs,
        CASE WHEN event_id % 3 = 0 THEN 'ascending' WHEN event_id % 3 = 1 THEN 'descending' ELSE '' END orbit,
        cast(event_id*37 % 101 AS int) cover_pct, cast(event_id*53 % 101 AS double) missing_pct, event_id ord FROM events"""),
    "catalog": ("scene", """SELECT cast(item_id AS varchar) item_id, sensor, dt, crs, x*0.25::double - 124.9375 minx,
        (y+1)*(-0.25)::double + 50.0625 miny, (x + CASE WHEN item_id % 3 = 0 THEN 2 ELSE 1 END)*0.25::double - 125.0625 maxx,
        y*(-0.25)::double + 49.9375 maxy, CASE WHEN item_id % 7 = 0 THEN 'EW' ELSE 'IW' END imode, cover_pct, missing_pct, ord
        FROM scene"""),
    "raster_file": ("", """SELECT DISTINCT concat('sar_202401', lpad(cast(day(ts) AS varchar),2,'0'), '_202401',
        lpad(cast(day(ts) AS varchar),2,'0'), '_20240101_', cast(cast(floor(user_id/15) AS int) AS varchar), '_',
        cast(user_id % 15 AS varchar), CASE WHEN event_type IN ('click','view') THEN '_vv.tif' ELSE '_vh.tif' END) name,
        cast(event_id % 7 * 100 AS bigint) size_bytes FROM events"""),
    "feature": ("", """SELECT p_partkey feature_id, cast(p_partkey % 40 AS double)/5 minx, cast(p_partkey % 37 AS double)/5 miny,
        cast(p_partkey % 40 AS double)/5 + p_size/cast(40 AS double) maxx,
        cast(p_partkey % 37 AS double)/5 + p_size/cast(60 AS double) maxy,
        CASE WHEN p_type='ECONOMY' THEN 46006 WHEN p_type='LARGE' THEN 49300 WHEN p_type='MEDIUM' THEN 33600 ELSE 55800 END fcode
        FROM part"""),
    "pxraw": ("", """SELECT vec_id tile_id, cast(unnest(range(0,len(embedding))) AS int) pos,
        cast(unnest(embedding) AS double) v FROM embeddings"""),
    "pixel": ("pxraw", """SELECT tile_id, cast(floor(pos/8) AS int) r, cast(pos % 8 AS int) c, pos, v, dn,
        (dn*3 + pos*211) % 10000 b03, (dn*7 + pos*97) % 10000 b08,
        CASE WHEN (tile_id*64+pos) % 97 = 0 THEN -9999.0::double ELSE v*20-15 END vv_db,
        cast(floor(tile_id/5) AS int) stack_id, cast(tile_id % 5 AS int) acq
        FROM (SELECT *, cast(floor((v+1)*5000) AS int) dn FROM pxraw)"""),
    "pixel_ext": ("pixel", f"""SELECT *, (dn*11 + pos*53) % 10000 b02, (dn*13 + pos*29) % 10000 b04, (dn*17 + pos*71) % 10000 b11,
        (dn*19 + pos*37) % 10000 b12, CASE WHEN (tile_id*64+pos) % 89 = 0 THEN -9999.0::double ELSE v*15-20 END vh_db,
        dn % 12 scl, dn/cast(10000 AS double) prob, CASE WHEN (dn*7) % 11 < 3 THEN 1 ELSE 0 END target,
        ({NLCD_CLASSES})[cast(dn % 20 AS int)+1] nlcd,
        cast(date '2022-01-20' + cast(tile_id % 10 AS int) AS date) img_date FROM pixel"""),
    "latent": ("", """SELECT vec_id sample_id, label run, embedding[1:32] mu, embedding[33:64] log_var FROM embeddings"""),
    "trial": ("", """SELECT o_orderkey trial, o_orderkey*31 % 99991 seed, o_orderstatus config, o_totalprice/1000000 f1,
        CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey*17 % 1000)/1000.0::double END recall,
        (o_orderkey*29 % 997)/997.0::double loss FROM orders"""),
}


def with_views(views: str, body: str) -> str:
    """`WITH` clause of the named views and what they build on, followed by the query; a body may go on with `, x AS`."""
    needed: list[str] = []

    def add(name: str) -> None:
        for base in DUCK[name][0].split():
            add(base)
        if name not in needed:
            needed.append(name)
    for name in views.split():
        add(name)
    if not needed:
        return body
    clauses = ", ".join(f"{n} AS ({DUCK[n][1]})" for n in needed)
    glue = "" if body.lstrip().startswith(",") else " "
    return f"WITH {clauses}{glue}{body}"


def permutation_sql(seed: int, size: int = 8) -> str:
    """CTEs that walk the rounds of the position permutation; pm(pos, src) at the end."""
    steps = [f", f0 AS (SELECT cast(range AS bigint) pos, range//{size} a, range % {size} b FROM range({size * size}))"]
    for i in range(6):
        steps.append(f"f{i + 1} AS (SELECT pos, b a, (a + (((b*16 + {i} + {seed})::bigint*2654435761 % 4294967296)*{size})//4294967296) % {size} b FROM f{i})")
    return ", ".join(steps) + f", pm AS (SELECT cast(pos AS int) pos, cast(a*{size} + b AS int) src FROM f6)"
