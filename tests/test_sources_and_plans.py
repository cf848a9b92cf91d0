"""Files, catalogues, levels of detail, streams and stored plans."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import raster as R
from cloudloom.plans.pipeline import Pipeline, stage
from cloudloom.sources import catalog, las, pcd, points, raster_files, tools, vectors
from cloudloom.sources.files import write_text
from cloudloom.streaming.rasters import read_point_stream, streaming_rasterize


def frame(n=50, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"X": rng.uniform(0, 9, n).round(3), "Y": rng.uniform(0, 9, n).round(3), "Z": rng.uniform(0, 5, n).round(3), "Intensity": rng.integers(0, 99, n).astype(float), "Classification": rng.integers(0, 9, n).astype(float)})


@pytest.mark.parametrize("binary", [True, False])
def test_pcd_round_trip(spark, tmp_path, binary):
    own = frame()
    (tmp_path / "a.pcd").write_bytes(pcd.encode(own, binary))
    got = pcd.read_pcd(spark, str(tmp_path / "a.pcd")).toPandas()
    pd.testing.assert_frame_equal(got[list(own.columns)], own)


def test_pcd_fields_must_begin_with_coordinates():
    with pytest.raises(ValueError):
        pcd.header_of(b"VERSION 0.7\nFIELDS y x z\nDATA ascii\n")
    with pytest.raises(ValueError):
        pcd.header_of(b"VERSION 0.7\n")


def test_pcd_files_by_tile(spark, tmp_path):
    df = spark.createDataFrame(frame()).withColumn("tile", (F.col("X") > 4).cast("int"))
    rows = pcd.write_pcd(df, str(tmp_path / "part_*.pcd"), ["tile"]).collect()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["part_0.pcd", "part_1.pcd"] and sum(r.npoints for r in rows) == 50
    got = pcd.read_pcd(spark, [str(tmp_path / "part_0.pcd"), str(tmp_path / "part_1.pcd")]).orderBy("X", "Y").toPandas()
    assert np.allclose(got[["X", "Y", "Z"]], frame().sort_values(["X", "Y"])[["X", "Y", "Z"]])
    for binary in (True, False):
        pcd.write_pcd(df.drop("tile"), str(tmp_path / "all.pcd"), binary=binary)
        assert pcd.read_pcd(spark, str(tmp_path / "all.pcd")).count() == 50
    with pytest.raises(ValueError):
        pcd.write_pcd(df, str(tmp_path / "all.pcd"), inputs=[str(tmp_path / "all.pcd")])


@pytest.mark.parametrize("fmt,version", [(0, (1, 1)), (3, None), (6, None), (8, (1, 4)), (3, (1, 4))])
def test_las_files_are_written_and_read(spark, tmp_path, fmt, version):
    own = frame(400, 3).assign(ReturnNumber=lambda p: 1.0 + np.arange(len(p)) % 4, NumberOfReturns=4.0, gpstime=7.25, R=300.0, G=4.0, B=5.0, NIR=6.0, ScanAngle=-12.0, Overlap=1.0)
    df = spark.createDataFrame(own).repartition(3)
    one = las.write_las(df, str(tmp_path / "all.las"), conditions="Z > 1", fmt=fmt, version=version)
    row = one.first()
    got = las.read_las(spark, str(tmp_path / "all.las")).orderBy("X", "Y").toPandas()
    want = own[own.Z > 1].sort_values(["X", "Y"]).reset_index(drop=True)
    assert row.npoints == len(want) == len(got) and row.xmax == want.X.max() and np.allclose(got[["X", "Y", "Z"]], want[["X", "Y", "Z"]])
    for c in ("Intensity", "Classification", "ReturnNumber", "NumberOfReturns"):
        assert (got[c] == want[c]).all()
    assert np.allclose(got.ScanAngle, -12.0) and (fmt < 2 or fmt == 6 or (got.R == 300).all()) and (fmt < 6 or (got.Overlap == 1).all())
    top = las.read_headers(spark, str(tmp_path / "all.las")).first()
    assert top.npoints == len(want) and top.xmin == pytest.approx(want.X.min())
    tiles = las.write_las(df.withColumn("tile", F.floor("X")), str(tmp_path / "t_*.las"), ["tile"], fmt=fmt, version=version)
    assert tiles.count() == 9 and las.read_las(spark, str(tmp_path / "t_*.las")).count() == 400
    box = las.read_las(spark, str(tmp_path / "t_*.las"), rectangle=(2, 2, 4, 4), buffer=0.5).count()
    assert box == len(own[own.X.between(1.5, 4.5) & own.Y.between(1.5, 4.5)])
    disc = las.read_las(spark, str(tmp_path / "t_*.las"), circle=(5, 5, 2)).count()
    assert disc == ((own.X - 5) ** 2 + (own.Y - 5) ** 2 <= 4).sum()


def test_las_formats_need_their_version(spark, tmp_path):
    df = spark.createDataFrame(frame(3))
    for bad in ({"fmt": 6, "version": (1, 2)}, {"fmt": 3, "version": (1, 1)}, {"fmt": 4}, {"inputs": [f"{tmp_path}/a.las"]}):
        with pytest.raises(ValueError):
            las.write_las(df, str(tmp_path / "a.las"), **bad)
    with pytest.raises(ValueError):
        las.write_las(df, str(tmp_path / "*.las"))


def test_catalogues_and_octrees_give_points(spark, tmp_path):
    df = spark.createDataFrame(frame(300, 4))
    tiles = las.write_las(df.withColumn("t", F.floor(F.col("X") / 3)), f"{tmp_path}/t_*.las", ["t"])
    files = tiles.select(F.col("path").alias("id"), "*", F.lit(1.2e9).alias("gpstime"))
    catalog.write_vpc(files, f"{tmp_path}/all.vpc", 26917, use_gpstime=True)
    assert catalog.read_vpc_points(spark, f"{tmp_path}/all.vpc").count() == 300
    assert catalog.read_vpc_points(spark, f"{tmp_path}/all.vpc", "Z > 2", rectangle=(0, 0, 2, 9)).count() == df.where("Z > 2 and X <= 2").count()
    assert catalog.gps_date(1.0) == (2011, 257)  # 10^9 s after 6 January 1980
    assert json.loads((tmp_path / "all.vpc").read_text())["features"][0]["properties"]["datetime"].startswith("2049-")
    assert catalog.gps_date(0) is None
    folder = tmp_path / "ept"
    for sub_ in ("ept-hierarchy", "ept-data"):
        (folder / sub_).mkdir(parents=True)
    dims = [{"name": c, "type": "signed", "size": 4, "scale": 0.01, "offset": 100.0} for c in "XYZ"] + [{"name": "Intensity", "type": "unsigned", "size": 2}]
    write_text(spark, f"{folder}/ept.json", json.dumps({"bounds": [100, 100, 100, 108, 108, 108], "dataType": "zstandard", "schema": dims}))
    write_text(spark, f"{folder}/ept-hierarchy/0-0-0-0.json", json.dumps({"0-0-0-0": 5, "1-0-0-0": 7, "1-1-1-1": 0}))
    import zstandard

    for key, n in (("0-0-0-0", 5), ("1-0-0-0", 7)):
        t = np.zeros(n, dtype=[("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("Intensity", "<u2")])
        t["X"], t["Intensity"] = np.arange(n) * 100, 9
        (folder / "ept-data" / f"{key}.zst").write_bytes(zstandard.ZstdCompressor().compress(t.tobytes()))
    got = catalog.read_ept_points(spark, str(folder)).toPandas()
    assert sorted(got.X) == sorted([*(100.0 + np.arange(5)), *(100.0 + np.arange(7))]) and (got.Intensity == 9).all()
    assert catalog.read_ept_points(spark, str(folder), depth=0).count() == 5
    assert catalog.read_ept_points(spark, str(folder), box=(100, 100, 101.5, 101)).count() == 4


def test_geotiff_round_trip(spark, tmp_path):
    df = spark.createDataFrame(frame(200))
    raster = R.rasterize(df, 0.5, ["z_max", "count"]).where("col <> 3 or row <> 3")
    raster_files.write_raster(raster, f"{tmp_path}/r.tif", ["z_max", "count"], 0.5, 26917)
    for band in ("z_max", "count"):
        got = raster_files.load_raster(spark, f"{tmp_path}/r.tif", band).orderBy("col", "row").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in raster.select("col", "row", "x", "y", F.col(band).cast("double")).orderBy("col", "row").collect()]
    near = raster_files.load_raster(spark, f"{tmp_path}/r.tif", 2, window=(2, 2, 4, 4))
    assert near.columns[-1] == "band2" and near.count() == raster.where("x between 2 and 4 and y between 2 and 4").count()
    with pytest.raises(ValueError):
        raster_files.parse_tiff(b"nothing at all like that")


def test_vectors_are_written_as_geojson(spark, tmp_path):
    tops = spark.createDataFrame([(1, 0.5, 1.5, 9.0, "a"), (1, 0.5, 1.5, 9.0, "a"), (2, 3.0, 4.0, 5.0, None)], "fid long, x double, y double, z double, kind string")
    vectors.write_vector(tops, f"{tmp_path}/tops.geojson", 26917)
    doc = json.loads((tmp_path / "tops.geojson").read_text())
    assert sorted((f["properties"]["fid"], f["geometry"]["type"], f["geometry"]["coordinates"]) for f in doc["features"]) == [(1, "Point", [0.5, 1.5, 9.0]), (2, "Point", [3.0, 4.0, 5.0])]
    boxes = spark.createDataFrame([(0.0, 0.0, 2.0, 1.0)], "xmin double, ymin double, xmax double, ymax double")
    vectors.write_vector(boxes, f"{tmp_path}/boxes.geojsonl")
    (line,) = spark.read.text(f"{tmp_path}/boxes.geojsonl").collect()
    assert json.loads(line[0])["geometry"]["coordinates"] == [[[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]]
    with pytest.raises(ValueError):
        vectors.features(spark.range(1))


def test_tables_and_tools(spark, tmp_path):
    own = pd.DataFrame({"x": [1.25, 2.5], "y": [0.001, 3.0], "Z": [1.0, 2.0], "i": [4, 5]})
    got = tools.from_frame(spark, own, (0.1, 0.01, 1.0)).orderBy("X").collect()
    assert [tuple(r) for r in got] == [(1.2, 0.0, 1.0, 4), (2.5, 3.0, 2.0, 5)]
    assert tools.guessed_accuracy(np.array([1.25, 7.31, 2.5, 8.44])) == 0.01 and tools.guessed_accuracy(np.array([3.0, 4.0])) == 1.0
    with pytest.raises(ValueError):
        tools.from_frame(spark, own[["x", "y"]])
    catalog.write_points(spark.createDataFrame(frame()), f"{tmp_path}/cloud", tile=5.0)
    assert tools.is_indexed(f"{tmp_path}/cloud") and tools.available_threads(spark) == 4 and tools.available_memory(spark)["total"] > 0
    assert "%in%" in tools.filter_usage() and "=" in tools.transform_usage()


def test_las_round_trip(spark, tmp_path):
    own = frame().assign(ReturnNumber=1.0, NumberOfReturns=2.0, gpstime=5.5, R=70000.0)
    (tmp_path / "a.las").write_bytes(las.encode(own))
    got = las.read_las(spark, str(tmp_path / "a.las"), "Z >= 0").toPandas()
    assert np.allclose(got[["X", "Y", "Z"]], own[["X", "Y", "Z"]]) and (got.R == 65535).all() and (got.gpstime == 5.5).all()
    assert (got.Classification == own.Classification).all() and (got.NumberOfReturns == 2).all()
    with pytest.raises(ValueError):
        las.header_of(b"nope" + bytes(400))
    with pytest.raises(ValueError):
        las.encode(own, version=(1, 1))


def test_catalogue_round_trip(spark, tmp_path):
    rows = [("t1", f"{tmp_path}/a.las", 10, 0.0, 0.0, 1.0, 5.0, 5.0, 2.0, 26917), ("t2", f"{tmp_path}/b.las", 20, 5.0, 0.0, 1.0, 9.0, 5.0, 2.0, 26917)]
    files = spark.createDataFrame(rows, catalog.CATALOG)
    catalog.write_vpc(files, f"{tmp_path}/all.vpc", 26917)
    assert catalog.read_vpc(spark, f"{tmp_path}/all.vpc").orderBy("id").collect() == files.orderBy("id").collect()
    for path, epsg in ((f"{tmp_path}/all.json", 1), (f"{tmp_path}/b.vpc", 0)):
        with pytest.raises(ValueError):
            catalog.write_vpc(files, path, epsg)
    write_text(spark, f"{tmp_path}/old.vpc", json.dumps({"type": "FeatureCollection", "features": [{"stac_version": "0.9"}]}))
    with pytest.raises(ValueError):
        catalog.read_vpc(spark, f"{tmp_path}/old.vpc")


def test_octree_hierarchy_is_pruned(spark, tmp_path):
    (tmp_path / "ept-hierarchy").mkdir()
    write_text(spark, f"{tmp_path}/ept.json", json.dumps({"bounds": [0, 0, 0, 8, 8, 8], "dataType": "laszip"}))
    write_text(spark, f"{tmp_path}/ept-hierarchy/0-0-0-0.json", json.dumps({"0-0-0-0": 5, "1-0-0-0": 7, "1-1-0-0": -1}))
    write_text(spark, f"{tmp_path}/ept-hierarchy/1-1-0-0.json", json.dumps({"1-1-0-0": 9, "2-3-1-0": 2}))
    assert catalog.read_ept(spark, str(tmp_path)).agg(F.sum("npoints")).first()[0] == 23
    assert {r.key for r in catalog.read_ept(spark, str(tmp_path), depth=1).collect()} == {"0-0-0-0", "1-0-0-0", "1-1-0-0"}
    assert {r.key for r in catalog.read_ept(spark, str(tmp_path), box=(0, 0, 1, 1)).collect()} == {"0-0-0-0", "1-0-0-0"}


def test_levels_of_detail_are_nested(spark, tmp_path):
    df = spark.createDataFrame([(i, *np.random.default_rng(i).uniform(0, 30, 3).tolist()) for i in range(800)], "pid long, X double, Y double, Z double")
    deep = catalog.with_depth(df, 16.0, 3)
    counts = {r.depth: r["count"] for r in deep.groupBy("depth").count().collect()}
    assert sum(counts.values()) == 800 and counts[0] == 8 and counts[0] < counts[1] < counts[2]
    path = str(tmp_path / "lod")
    catalog.write_points(deep, path, levels=True)
    assert points.read_points(spark, path, depth=1).count() == counts[0] + counts[1]
    with pytest.raises(ValueError):
        catalog.write_points(deep, path, inputs=[path + "/"])


def test_raster_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame(frame(200))
    raster = R.rasterize(df, 1.0, ["z_max"]).where("col <> 3 or row <> 3")
    raster_files.write_raster(raster, f"{tmp_path}/r.asc", "z_max", 1.0)
    got = raster_files.load_raster(spark, f"{tmp_path}/r.asc", "z_max").orderBy("col", "row").collect()
    assert got == raster.orderBy("col", "row").collect()


def test_streamed_raster_equals_the_batch(spark, tmp_path):
    df = spark.createDataFrame(frame(300))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streaming_rasterize(read_point_stream(spark, str(tmp_path / "in"), df.schema, 1), 1.0, ["z_max", "count"], "Z > 1")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    want = R.rasterize(df, 1.0, ["z_max", "count"], "Z > 1").orderBy("col", "row").collect()
    assert spark.sql("select * from streamed order by col, row").collect() == want
    with pytest.raises(ValueError):
        streaming_rasterize(df, 1.0, ["z_mean"])


def cloud(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(i, rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0, 9), 2 if i % 3 else 1) for i in range(600)], "pid long, X double, Y double, Z double, Classification int")


def test_pipeline_runs_products_and_points(spark):
    raster = stage("rasterize", res=2.0, operators=["z_max"])
    smooth = stage("focal", {"raster": raster}, size=6.0, res=2.0)
    plan = stage("delete_points", filter="Classification == 1") + raster + smooth + stage("edit_attribute", attribute="Classification", value=7.0)
    out = plan.execute(cloud(spark))
    assert out["points"].where("Classification <> 7").count() == 0 and out["points"].count() == 400
    assert out[smooth.uid].count() >= out[raster.uid].count() > 0


def test_plans_are_stored_and_checked(spark):
    raster = stage("rasterize", res=2.0, operators=["z_max", "count"])
    plan = stage("reader", filter="Z > 3") + raster
    again = Pipeline.from_json(plan.to_json())
    assert again.execute(cloud(spark))[raster.uid].count() == plan.execute(cloud(spark))[raster.uid].count()
    assert plan.info() == {"streamable": True, "read_points": True, "buffer": 2.0, "parallelizable": True}
    assert not (plan + stage("classify_with_sor")).info()["streamable"]
    for bad in (stage("nope") + raster, stage("focal", {"raster": raster}, size=1, res=1) + raster, raster + raster):
        with pytest.raises(ValueError):
            bad.check()


def test_graphs_are_put_in_order():
    node = lambda i, name, before, **data: {"id": i, "name": name, "data": data, "inputs": {"input_1": {"connections": [{"node": str(b)} for b in before]}}}
    graph = {"drawflow": {"Home": {"data": {"1": node(1, "rasterize", [3], res=2.0), "2": node(2, "reader", []), "3": node(3, "delete_points", [2], filter="Z < 1")}}}}
    plan = Pipeline.from_json(json.dumps(graph))
    assert [s.name for s in plan.stages] == ["reader", "delete_points", "rasterize"] and plan[2].params == {"res": 2.0}
    graph["drawflow"]["Home"]["data"]["1"]["data"]["colour"] = "red"
    with pytest.raises(ValueError, match="colour"):
        Pipeline.from_json(json.dumps(graph))


def test_graphs_link_products(spark):
    node = lambda i, name, ports, **data: {"id": i, "name": name, "data": data, "inputs": {f"input_{k + 1}": {"connections": [{"node": b} for b in p]} for k, p in enumerate(ports)}}
    nodes = [node("o", "processing_options", [], files="*.las"), node("r", "reader_las", []), node("m", "rasterize", [["t"]], res="2", method="z_mean"), node("t", "transform_with", [["r"], ["d"]]),
             node("g", "rasterize", [[], ["d"]], res=1), node("d", "triangulate", [["r"]], max_edge=0, use_attribute="Z", filter="Classification == 2")]
    plan = Pipeline.from_json(json.dumps({"drawflow": {"Home": {"data": {n["id"]: n for n in nodes}}}}))
    out = plan.execute(cloud(spark).where("X < 12 and Y < 12"))
    assert {s.uid: s.name for s in plan.stages} == {"r": "reader", "d": "triangulate", "g": "rasterize_triangulation", "t": "transform_with_triangulation", "m": "rasterize"}
    assert out["g"].count() > 0 and out["m"].agg(F.max("z_mean")).first()[0] < 9


def test_plain_plans_are_read(spark, tmp_path):
    entries = [
        {"algoname": "build_catalog", "files": ["a.las"]}, {"algoname": "reader", "uid": "a", "filter": []}, {"algoname": "filter", "uid": "b", "filter": ["Z < 0.5"]},
        {"algoname": "rasterize", "uid": "c", "res": 1, "window": 1, "method": ["max"], "output": f"{tmp_path}/chm.tif", "filter": [""]},
        {"algoname": "pit_fill", "uid": "f", "connect": "c", "lap_size": 3, "thr_lap": 0.1, "med_size": 3, "thr_spk": -0.1, "dil_radius": 0, "output": ""},
        {"algoname": "local_maximum", "uid": "l", "connect": "f", "ws": 3, "min_height": 2, "filter": [], "output": f"{tmp_path}/tops.geojson"},
        {"algoname": "region_growing", "uid": "t", "connect1": "f", "connect2": "l", "th_tree": 2, "th_seed": 0.45, "th_cr": 0.55, "max_cr": 20},
        {"algoname": "classify_with_ivf", "uid": "i", "res_x": 5, "res_y": 5, "res_z": 5, "n": 1, "class": 18}, {"algoname": "load_matrix", "uid": "x", "matrix": [1, 0, 0, 5, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], "check": True},
        {"algoname": "transform_with", "uid": "y", "connect": "x"}, {"algoname": "stop_if", "uid": "s", "condition": "chunk_id_below", "index": 2, "tile": 10.0}, {"algoname": "hulls", "uid": "h"},
        {"algoname": "write_las", "uid": "w", "output": f"{tmp_path}/out.las", "filter": [], "keep_buffer": False}, {"algoname": "write_lax", "uid": "z", "embedded": True, "overwrite": False},
        {"algoname": "set_crs", "uid": "k", "epsg": 26917, "wkt": ""}, {"algoname": "sort", "uid": "o", "spatial": True}, {"algoname": "summarise", "uid": "u", "zwbin": 2, "iwbin": 50, "filter": []},
    ]
    plan = Pipeline.from_json(json.dumps({"processing": {}, "pipeline": entries}))
    points_ = cloud(spark)
    out = plan.execute(points_)
    whole = points_.where("Z >= 0.5")
    assert out["t"].count() > 0 and (tmp_path / "chm.tif").exists() and (tmp_path / "tops.geojson").exists()
    assert 0 < las.read_las(spark, f"{tmp_path}/out.las").count() < whole.count()
    assert raster_files.load_raster(spark, f"{tmp_path}/chm.tif", "max").count() == R.rasterize(whole, 1.0, ["max"]).count()
    again = Pipeline.from_json(plan.to_json())
    assert [s.name for s in again.stages] == [s.name for s in plan.stages]
    doc = json.loads(Pipeline(plan.stages[1:3]).results(points_, 5))
    assert doc["success"] and len(doc["data"][0]["rows"]) == 5
    assert not json.loads((stage("rasterize", res=1.0, operators=["nope"]) + stage("summarise")).results(points_))["success"]
    seen = []
    rows = (stage("rasterize", res=2.0, operators=["z_max"]) + stage("summarise")).profile(points_, f"{tmp_path}/profile.csv", lambda name, share: seen.append((name, share)))
    assert [r[0] for r in rows] == ["rasterize", "summarise", "points"] and seen[-1] == ("points", 1.0) and (tmp_path / "profile.csv").read_text().startswith("name, start, end, thread")
    for bad in ({"algoname": "rasterize", "res": 1, "colour": 2}, {"algoname": "nope"}, {"algoname": "focal", "connect": "q", "size": 3}):
        with pytest.raises(ValueError):
            Pipeline.from_json(json.dumps({"pipeline": [bad]}))


def test_entry_module_lists_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
