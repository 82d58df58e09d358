"""Files in, files out, resume rules, negative inputs and the streaming intake."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilerain.operators import stacking as K
from tilerain.operators.events import manual_events
from tilerain.operators.neighborhood import complete_stacks
from tilerain.operators.patches import random_split, shards
from tilerain.sources import catalog as C
from tilerain.sources import grids as R
from tilerain.sources import sinks as O
from tilerain.sources import text_lists as T
from tilerain.streaming.intake import recorded, start_intake, start_keyed_intake


def write_grids(folder, days):
    for i, day in enumerate(days):
        values = np.arange(6, dtype="<f4").reshape(2, 3) + i
        values[1, 2] = -9999
        (folder / f"ppt_stable_{day}_v1.bil").write_bytes(values.tobytes())


def test_grids_become_a_cube(spark, tmp_path):
    write_grids(tmp_path, ["20160801", "20160802", "20160803"])
    cube = R.build_cube(R.read_daily_grids(spark, str(tmp_path), 2, 3))
    rows = {(r["t"], r["y"], r["x"]): r["precip"] for r in cube.collect()}
    assert len(rows) == 18 and rows[(1, 0, 2)] == 3.0 and rows[(2, 1, 2)] is None
    out = str(tmp_path / "cube")
    R.write_cube(cube, out)
    back = spark.read.parquet(out)
    assert back.where("month = '2016-08'").count() == 18 and "month" in back.columns


@pytest.mark.parametrize("days", [["20160801", "20160803"], ["20160802", "20160803"]])
def test_skipped_day_is_an_error(spark, tmp_path, days):
    write_grids(tmp_path, days)
    with pytest.raises(ValueError, match="not contiguous"):
        R.build_cube(R.read_daily_grids(spark, str(tmp_path), 2, 3))


def test_wrong_grid_size_is_an_error(spark, tmp_path):
    write_grids(tmp_path, ["20160801"])
    with pytest.raises(Exception, match="expected 20"):
        R.read_daily_grids(spark, str(tmp_path), 4, 5).collect()


def test_raw_tiles(spark, tmp_path):
    a = np.arange(12, dtype="<f4")
    (tmp_path / "vv_7_3x4.bin").write_bytes(a.tobytes())
    (tmp_path / "notes.txt").write_text("x")
    row = R.read_raw_tiles(spark, str(tmp_path)).first()
    assert (row["tile_id"], row["channel"], row["h"], row["w"]) == (7, "vv", 3, 4) and row["data"] == a.tolist()


EVENT_LIST = """# Texas
2017-08-28, 523, 701
20170829,10,20, EPSG:32614

2017-8-2, 1, 2
20170829,1
20170829,1,2,EPSG:1,9
20170829,-1,2
20170829,1,2,EPSG:abc
20170829,a,2
20171399,1,2
"""


def test_event_list_file(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text(EVENT_LIST)
    events, errors = T.parse_event_list(T.numbered_lines(spark, str(path)))
    got = sorted((r["line_no"], str(r["event_date"]), r["y"], r["x"], r["crs"]) for r in events.collect())
    assert got == [(2, "2017-08-28", 523, 701, None), (3, "2017-08-29", 10, 20, "EPSG:32614"), (5, "2017-08-02", 1, 2, None)]
    reasons = {r["line_no"]: r["reason"] for r in errors.collect()}
    assert sorted(reasons) == [6, 7, 8, 9, 10, 11]
    assert reasons[8].startswith("line 8: row or column") and "CRS" in reasons[9] and "whole number" in reasons[10] and "date" in reasons[11]
    with pytest.raises(Exception, match="line "):
        T.strict((events, errors)).collect()


def test_cell_and_id_lists(spark, tmp_path):
    cells, ids = tmp_path / "cells.txt", tmp_path / "ids.txt"
    cells.write_text("1, 2\n#x\n3,4,EPSG:32610\n5\n")
    ids.write_text(" 20170829_1_2 \n\n#odd\n")
    good, bad = T.parse_cell_list(T.numbered_lines(spark, str(cells)))
    assert sorted((r["y"], r["x"]) for r in good.collect()) == [(1, 2), (3, 4)] and bad.first()["line_no"] == 4
    assert sorted(r["eid"] for r in T.parse_id_list(T.numbered_lines(spark, str(ids))).collect()) == ["#odd", "20170829_1_2"]


def test_line_numbers_over_many_splits(spark, tmp_path):
    rng = random.Random(4)
    want = set()
    for name, end, last in (("a.txt", "\n", ""), ("b.txt", "\r\n", "\r\n"), ("c.txt", "\n", "\n")):
        lines = ["" if rng.random() < 0.2 else "x" * rng.randint(0, 90) + str(i) for i in range(700)] + ["end"]
        (tmp_path / name).write_bytes((end.join(lines) + last).encode())
        want |= {(name, i + 1, line) for i, line in enumerate(lines)}
    (tmp_path / "empty.txt").write_text("")
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        lines = T.numbered_lines(spark, str(tmp_path))
        got = [(r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in lines.collect()]
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(want) and set(got) == want


def test_days_are_pruned_and_checked_by_name(spark, tmp_path):
    """Files outside the days asked for, and any file while days are checked, are never opened: they hold garbage."""
    for day in ("20160731", "20160803"):
        (tmp_path / f"precip_{day}.bil").write_bytes(b"???")
    for day in ("20160801", "20160802"):
        (tmp_path / f"precip_{day}.bil").write_bytes(np.arange(6, dtype="<f4").tobytes())
    assert sorted(str(r[0]) for r in R.grid_days(spark, str(tmp_path)).collect()) == ["2016-07-31", "2016-08-01", "2016-08-02", "2016-08-03"]
    cube = R.cube_of_files(spark, str(tmp_path), 2, 3, "2016-08-01", "20160802")
    assert {(r.t, r.y, r.x, r.precip) for r in cube.collect()} == {(t, i // 3, i % 3, float(i)) for t in (0, 1) for i in range(6)}
    plan = R.read_daily_grids(spark, str(tmp_path), 2, 3, "20160801", "20160802")
    assert plan.select("event_date").distinct().count() == 2
    (tmp_path / "precip_20160805.bil").write_bytes(b"???")
    with pytest.raises(ValueError, match="2016-08-05"):
        R.cube_of_files(spark, str(tmp_path), 2, 3, "2016-08-01")


def test_csv_tables(spark, tmp_path):
    (tmp_path / "split.csv").write_text("y,x,split\n1,2,train\n3,4,val\n")
    (tmp_path / "patch.csv").write_text("y,x,i,j\n1,2,64,128\n")
    points = tmp_path / "points_20240105_20240101_3_4.csv"
    points.write_text("mapX,mapY,sourceX,sourceY,enable\n110,205,100,200,1\n125,200,100,200,1\n")
    assert T.read_splits(spark, str(tmp_path / "split.csv")).count() == 2
    assert T.read_homogeneous_patches(spark, str(tmp_path / "patch.csv")).first()["j"] == 128
    shift = K.median_shift(T.read_control_points(spark, str(points)), ["img_date", "eid"]).first()
    assert (shift["img_date"], shift["eid"], shift["shift_x"], shift["shift_y"]) == ("20240105", "20240101_3_4", 2, 0)


def test_metadata_layouts(spark, tmp_path):
    flat = {"Sample ID": "20240101_3_4", "Precipitation Event Date": "2024-01-01", "CRS": "EPSG:32614", "State": "Texas",
            "Bounding Box": {"minx": 1.0, "miny": 2.0, "maxx": 3.0, "maxy": 4.0}}
    (tmp_path / "a.json").write_text(json.dumps(flat, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"metadata": {**flat, "Precipitation Event Date": "20240101"}}, indent=2))
    rows = C.read_metadata(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and str(rows[0]["event_date"]) == "2024-01-01" and rows[0]["bbox"]["maxy"] == 4.0


def test_metadata_is_written_and_read_back(spark, tmp_path):
    events = spark.sql("""SELECT '20240101_3_4' eid, date'2024-01-01' event_date, 12.5D precip, 'EPSG:32614' crs, 'Texas' state,
        named_struct('minx',1D,'miny',2D,'maxx',3D,'maxy',4D) bbox""")
    chosen = spark.createDataFrame([("20240101_3_4", "s2", "2024-01-02", "A"), ("20240101_3_4", "s1", "2024-01-02", "B")],
                                   "eid string, sensor string, d string, item_id string").withColumn("scene_date", F.to_date("d"))
    out = str(tmp_path / "meta")
    C.write_metadata(C.metadata_json(events, C.products_by_date(chosen), {"S2, S1 Coincident Within (hours)": 12}), out)
    body = json.loads(spark.read.text(out).first()[0])
    assert body["S2 Products"] == {"2024-01-02": "A"} and body["S1 Products"] == {"2024-01-02": "B"}
    assert body["S2, S1 Coincident Within (hours)"] == 12
    assert C.parse_metadata(spark.read.text(out).withColumnRenamed("value", "json")).first()["eid"] == "20240101_3_4"


def test_file_listing(spark, tmp_path):
    d = tmp_path / "20240101_3_4"
    d.mkdir()
    for name, size in (("sar_20240102_20240103_20240101_3_4_vv.tif", 5), ("dem_20240101_3_4.tif", 0), ("tci_20240102_20240101_3_4.tif", 3)):
        (d / name).write_bytes(b"x" * size)
    files = C.named_files(C.list_files(spark, str(tmp_path)))
    kinds = {r["kind"]: (r["eid"], r["img_date"], r["size_bytes"]) for r in files.collect()}
    assert kinds["sar"] == ("20240101_3_4", "20240102", 5) and "dem" not in kinds
    gaps = K.missing_files(files, K.EVENT_FILES).first()
    assert not gaps["complete"] and "DEM" in gaps["missing"] and "SAR" not in gaps["missing"] and "METADATA" in gaps["missing"]


def test_incomplete_stack_drops_out(spark):
    rows = [(s, a, 0, 0) for s, n in ((1, 7), (2, 6)) for a in range(n)]
    px = spark.createDataFrame(rows, "stack_id int, acq int, r int, c int")
    assert {r["stack_id"] for r in complete_stacks(px, 7).collect()} == {1}


def test_vv_without_vh_drops_out(spark):
    files = spark.createDataFrame([(1, "vv", 4, 4), (1, "vh", 4, 4), (2, "vv", 4, 4), (3, "vv", 4, 4), (3, "vh", 4, 5)], "k int, polarization string, h int, w int")
    assert [r["k"] for r in K.polarization_pairs(files, ["k"]).collect()] == [1]


def test_one_differing_transform_is_reported(spark):
    good, bad = [10.0, 0.0, 1.0, 0.0, -10.0, 2.0], [10.0, 0.0, 1.5, 0.0, -10.0, 2.0]
    rows = [("e", "a.tif", 4, 4, "EPSG:1", good), ("e", "b.tif", 4, 4, "EPSG:1", good), ("e", "c.tif", 4, 4, "EPSG:1", bad), ("f", "a.tif", 4, 4, "EPSG:1", good)]
    out = {r["eid"]: r for r in K.inconsistent_rasters(spark.createDataFrame(rows, "eid string, name string, h int, w int, crs string, transform array<double>")).collect()}
    assert out["e"]["mismatched_file"] == "c.tif" and out["e"]["reason"] == "transform" and out["e"]["total_files"] == 3
    assert out["f"]["is_valid"] and out["f"]["mismatched_file"] is None


def test_manual_event_before_the_cube(spark):
    listed = spark.sql("SELECT date'2016-07-01' event_date, 1 y, 2 x, CAST(NULL AS string) crs UNION ALL SELECT date'2016-08-02', 1, 2, 'EPSG:5'")
    cells = spark.createDataFrame([(1, 1, 2, 7.0)], "t int, y int, x int, precip double")
    got = {r["t"]: r["precip"] for r in manual_events(listed, cells).collect()}
    assert got == {-31: 0.0, 1: 7.0}


def test_empty_patches_keep_their_schema(spark, tmp_path):
    from tilerain.schema import PATCH
    out = str(tmp_path / "patches")
    O.write_patches(spark.createDataFrame([], PATCH), out)
    assert O.exists(spark, out)


def test_shards_on_disk(spark, tmp_path):
    out = str(tmp_path / "shards")
    O.write_shards(shards(spark.range(10).withColumnRenamed("id", "p"), "p", 3, 10, False), out)
    back = spark.read.parquet(out)
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 4, 1: 3, 2: 3}


def test_manifest_and_trials(spark, tmp_path):
    split = random_split(spark.range(50).select(F.col("id").cast("string").alias("eid")), "eid", 0.1, 0.1, 1)
    O.write_manifest(split, str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).groupBy("split").count().count() == 3
    log = str(tmp_path / "trials")
    trials = spark.range(6).select(F.col("id").alias("trial"), F.lit(float("nan")).alias("f1"))
    assert O.pending_trials(spark, trials, log).count() == 6
    O.append_trials(trials.where("trial < 4"), log)
    assert spark.read.parquet(log).where("f1 IS NULL").count() == 4
    assert {r["trial"] for r in O.pending_trials(spark, trials, log).collect()} == {4, 5}


def test_streaming_intake_continues_where_it_stopped(spark, tmp_path):
    source, events, ckpt = (str(tmp_path / n) for n in ("in", "events", "ckpt"))
    box = (-125.0, 0.25, 0.0, 50.0, 0.0, -0.25)

    def put(rows):
        spark.createDataFrame(rows, "t int, y int, x int, precip double").write.mode("append").parquet(source)

    put([(0, 1, 1, 500.0), (0, 1, 2, 10.0), (0, 1, 1, 500.0)])
    start_intake(spark, source, events, ckpt, 300.0, box).awaitTermination()
    assert [(r["t"], r["y"], r["x"]) for r in recorded(spark, events).collect()] == [(0, 1, 1)]
    put([(1, 1, 1, 400.0), (0, 1, 1, 500.0), (2, 5, 5, 300.0)])
    start_intake(spark, source, events, ckpt, 300.0, box).awaitTermination()
    start_intake(spark, source, events, ckpt, 300.0, box).awaitTermination()
    got = sorted((r["t"], r["y"], r["x"], r["eid"]) for r in recorded(spark, events).collect())
    assert got == [(0, 1, 1, "20160801_1_1"), (1, 1, 1, "20160802_1_1")]
    # a new checkpoint folder takes everything in again and loses nothing
    put([(3, 2, 2, 450.0), (3, 2, 2, 460.0)])
    start_intake(spark, source, events, str(tmp_path / "other"), 300.0, box).awaitTermination()
    got = sorted((r["t"], r["y"], r["x"], r["precip"]) for r in recorded(spark, events).collect())
    assert got == [(0, 1, 1, 500.0), (1, 1, 1, 400.0), (3, 2, 2, 460.0)]


def test_keyed_intake_restarts_replays_and_forgets(spark, tmp_path):
    source, events, ckpt = (str(tmp_path / n) for n in ("in", "events", "ckpt"))
    box = (-125.0, 0.25, 0.0, 50.0, 0.0, -0.25)

    def put(rows):
        spark.createDataFrame(rows, "t int, y int, x int, precip double").coalesce(1).write.mode("append").parquet(source)

    def run(keep=3650):
        query = start_keyed_intake(spark, source, events, ckpt, 300.0, box, keep_days=keep, max_files=1)
        query.awaitTermination()
        return sorted((r.t, r.y, r.x, r.precip, r.eid) for r in spark.read.parquet(events).collect())

    put([(0, 1, 1, 500.0), (0, 1, 2, 10.0), (0, 1, 1, 510.0)])
    put([(0, 1, 1, 700.0), (5, 1, 1, 301.0), (2, 5, 5, 300.0)])
    first = [(0, 1, 1, 510.0, "20160801_1_1"), (5, 1, 1, 301.0, "20160806_1_1")]
    assert run() in (first, [(0, 1, 1, 700.0, "20160801_1_1"), first[1]])
    put([(5, 1, 1, 900.0), (1, 1, 1, 400.0)])
    got = run()
    assert [r[:3] for r in got] == [(0, 1, 1), (1, 1, 1), (5, 1, 1)] and got[2][3] == 301.0
    # a replayed batch: its commit is lost, so it runs again and is written once
    commits = tmp_path / "ckpt" / "commits"
    newest = max((f for f in commits.iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    for f in (newest, commits / f".{newest.name}.crc"):
        f.unlink(missing_ok=True)
    assert run() == got
    with pytest.raises(ValueError, match="another checkpoint"):
        start_keyed_intake(spark, source, events, str(tmp_path / "other"), 300.0, box)


def test_keyed_intake_keeps_one_state_entry_per_block(spark, tmp_path):
    """Cell-days of a block share an entry, also below zero and beside nulls; a second landing of all adds nothing."""
    source, events, ckpt = (str(tmp_path / n) for n in ("in", "events", "ckpt"))
    cells = [(t, y, x) for t in (0, 3) for y in (-65, -64, -1, 0, 63, 64, None) for x in (-1, 0, 5, 63, 64, None)]
    for more in (0.0, 9.0):
        rows = [(*c, 400.0 + i + more) for i, c in enumerate(cells)] * 2
        spark.createDataFrame(rows, "t int, y int, x int, precip double").coalesce(1).write.mode("append").parquet(source)
        query = start_keyed_intake(spark, source, events, ckpt, 300.0, (-125.0, 0.25, 0.0, 50.0, 0.0, -0.25))
        query.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert max(kept) <= 2 * 5 * 4
    got = [(r.t, r.y, r.x, r.precip) for r in spark.read.parquet(events).collect()]
    assert Counter(got) == Counter((*c, 400.0 + i) for i, c in enumerate(cells))
