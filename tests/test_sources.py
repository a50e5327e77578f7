"""Sources, sinks and geometry."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import geometry as G
from panelweave.sources import shapefile as H
from panelweave.sources import tables as T


def put(path, text):
    path.write_text(text)
    return str(path)


def test_strict_csv_and_types(spark, tmp_path):
    p = put(tmp_path / "a.csv", "i,x,s\n1, 2.5 ,NA\n2,nan, b \n,,\n")
    df = T.parse_types(T.read_csv_strict(spark, p, ["i", "x", "s"]), ["i"], ["x"])
    assert [tuple(r) for r in df.collect()][:2] == [(1, 2.5, None), (2, None, "b")]
    with pytest.raises(ValueError, match="header"):
        T.read_csv_strict(spark, p, ["x", "i", "s"])
    q = put(tmp_path / "b.csv", "i\n1.5\nzz\n9007199254740993\n")
    with pytest.raises(ValueError, match="does not parse"):
        T.parse_types(T.read_csv_strict(spark, q), ["i"], [])
    big = put(tmp_path / "c.csv", "i\n9007199254740993\n")
    assert T.parse_types(T.read_csv_strict(spark, big), ["i"], []).first()[0] == 9007199254740993


def test_discovery_and_lineage(spark, tmp_path):
    for n in ("fam_n.csv", "fam_s.csv", "fam_s_qa.csv", "manifest_n.csv"):
        put(tmp_path / n, f"run_id,v\nr1,{n}\n")
    found = T.discover_family(spark, f"{tmp_path}/*.csv", ["N", "S"])
    assert sorted(found) == ["N", "S"]
    assert T.load_family(spark, found, ["run_id", "v"]).count() == 2
    with pytest.raises(ValueError, match="no file"):
        T.discover_family(spark, f"{tmp_path}/*.csv", ["N", "S", "E"])
    put(tmp_path / "fam_s.csv", "run_id,v\nr1,a\nr2,b\n")
    with pytest.raises(ValueError, match="lineage"):
        T.load_family(spark, found, ["run_id", "v"])
    put(tmp_path / "pts_modis_2001.csv", "a,b\n1,2\n")
    assert T.one_file(spark, f"{tmp_path}/pts*", "modis", 2001).endswith("2001.csv")
    with pytest.raises(ValueError):
        T.one_file(spark, f"{tmp_path}/pts*", "viirs", 2001)
    assert T.read_year_partitions(spark, f"{tmp_path}/pts*", ["b"]).columns == ["b"]


def test_sinks_are_stable(spark, tmp_path):
    df = spark.createDataFrame([(2, None, 1.5), (1, "é", 2.0)], "k int, s string, x double")
    data = T.write_csv_bytes(df, ["k"], ["k", "s", "x"])
    assert data == "k,s,x\n1,é,2.0\n2,,1.5\n".encode() and T.gzip_bytes(data) == T.gzip_bytes(data)
    rec = T.write_output("o/a.csv", data, str(tmp_path))
    assert rec["sha256"] == hashlib.sha256(data).hexdigest()
    for bad, err in (("o/a.csv", FileExistsError), ("../x", ValueError)):
        with pytest.raises(err):
            T.write_output(bad, data, str(tmp_path))
    m = T.manifest(spark, f"{tmp_path}/o/*")
    assert m.first()["sha256"] == rec["sha256"] and T.manifest_problems(m, m).count() == 0
    assert T.manifest_problems(m, m.withColumn("sha256", F.lit("x"))).first()["problem"] == "changed"
    T.write_csv_parts(df, f"{tmp_path}/parts", ["k"], ["k", "s", "x"], ["k"])
    assert spark.read.csv(f"{tmp_path}/parts", header=True).count() == 2
    j = put(tmp_path / "j.json", '{"b": 1, "a": [2]}')
    assert T.stable_json(T.read_json(spark, j)) == '{"a":[2],"b":1}'
    with pytest.raises(ValueError):
        T.read_json(spark, j, "00")
    c = put(tmp_path / "x.csv", "id,share\na,0.5\nb,1.5\n")
    with pytest.raises(ValueError, match="outside"):
        T.read_crosswalk(spark, c, ["id", "share"], "id", "share")
    assert T.first_existing(spark, [f"{tmp_path}/none.csv"], ["a", "b"]).columns == ["a", "b"]
    assert T.check_field_names(["ok", "much_too_long", "OK"]) != []


def sq(x, y, s=1.0):
    return [[{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}, {"x": x, "y": y}]]


def test_shapefile_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "Å", sq(0.0, 0.0)), ("b", None, sq(3.0, 1.0))], f"id string, name string, polygon {G.POLYGON.simpleString()}")
    p = f"{tmp_path}/u.shp"
    H.write_shapefile(df, p, ["id", "name"], "LOCAL")
    back = H.read_shapefile(spark, p, ["id", "name"])
    assert sorted((r["id"], r["name"], r["polygon"][0][2]["x"]) for r in back.collect()) == [("a", "Å", 1.0), ("b", None, 4.0)]
    (tmp_path / "u.prj").unlink()
    with pytest.raises(ValueError, match="prj"):
        H.read_shapefile(spark, p, ["id"])


def test_wkt_area_and_centroid(spark):
    r = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",)], "w string").select(H.polygon_from_wkt("w").alias("p")).select("p", G.polygon_area(F.col("p")).alias("a")).first()
    assert r["a"] == 15.0
    u = [[{"x": 0.0, "y": 0.0}, {"x": 6.0, "y": 0.0}, {"x": 6.0, "y": 6.0}, {"x": 5.0, "y": 6.0}, {"x": 5.0, "y": 1.0}, {"x": 1.0, "y": 1.0}, {"x": 1.0, "y": 6.0}, {"x": 0.0, "y": 6.0}]]
    x, y = G.anchor(u)
    assert G.locate(u, np.array([x]), np.array([y]))[0] == 1
    assert G.overlap_area(u, sq(0.0, 0.0, 6.0)) == pytest.approx(16) and G.overlap_area(u, sq(1.0, 1.0, 4.0)) == pytest.approx(0, abs=1e-9)


def test_boundary_and_tie_break(spark):
    schema = f"unit_id string, polygon {G.POLYGON.simpleString()}"
    units = spark.createDataFrame([("big", sq(0.0, 0.0, 3.0)), ("b", sq(1.0, 1.0)), ("a", sq(2.0, 1.0)), ("far", sq(10.0, 10.0))], schema)
    pts = spark.createDataFrame([(1, 2.0, 1.5), (2, 0.5, 0.5), (3, 3.0, 3.0), (4, 7.0, 7.0), (5, 10.0, 10.5)], "id int, x double, y double")
    got = {r["id"]: r["unit_id"] for r in G.points_in_units(pts, units, "id").collect()}
    assert got == {1: "a", 2: "big", 3: "big", 4: None, 5: "far"}
    inner = {r["id"]: r["unit_id"] for r in G.points_in_units(pts, units, "id", within=True).collect()}
    assert inner == {1: "big", 2: "big", 3: None, 4: None, 5: None}
    edges = G.queen_edges(spark.createDataFrame([("A", sq(0.0, 0.0)), ("B", sq(1.0, 0.0)), ("C", sq(0.0, 1.0)), ("D", sq(1.0, 1.0)), ("I", sq(10.0, 10.0))], schema))
    assert edges.count() == 12 and edges.where("i = 'I'").count() == 0


def test_assignment(spark):
    schema = f"polygon {G.POLYGON.simpleString()}, id string"
    rect = lambda x0, x1: [[{"x": x0, "y": 0.0}, {"x": x1, "y": 0.0}, {"x": x1, "y": 1.0}, {"x": x0, "y": 1.0}]]
    zones = spark.createDataFrame([(rect(0.0, 3.0), "A"), (rect(3.0, 4.0), "B")], schema).withColumnRenamed("id", "zone")
    dist = spark.createDataFrame([(rect(0.0, 4.0), "d"), (rect(2.5, 3.5), "tie"), (rect(50.0, 51.0), "none")], schema).withColumnRenamed("id", "dist")
    got = {r["dist"]: r for r in G.assign_by_share(G.overlay(dist, zones, "dist", "zone"), dist, "dist", "zone").collect()}
    assert (got["d"]["zone"], got["d"]["share"]) == ("A", 0.75)
    assert (got["tie"]["zone"], got["tie"]["tie"]) == ("A", True)
    assert (got["none"]["zone"], got["none"]["share"], got["none"]["method"]) == (None, 0.0, "unassigned_no_overlap")


def test_projections(spark):
    e, n = G.utm(np.array([-3.0]), np.array([0.0]), 30)
    assert (e[0], n[0]) == (pytest.approx(500000), pytest.approx(0))
    e, n = G.utm(np.array([-1.0]), np.array([7.0]), 30)
    assert e[0] == pytest.approx(720900, abs=300) and n[0] == pytest.approx(774200, abs=300)
    cell = [[{"x": a, "y": b} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]]
    assert G.geodesic_area(cell) == pytest.approx(12308.8e6, rel=2e-4)
    whole = 4 * math.pi * 6371007.2**2
    band = [[{"x": a, "y": b} for a, b in ((-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0))]]
    assert G.geodesic_area(band) == pytest.approx(whole, rel=1e-5)
    x, y = G.equal_area(np.array([1.5]), np.array([7.5]), 1.0, 7.0)
    assert abs(x[0]) < 60000 and abs(y[0]) < 60000
    pts = spark.createDataFrame([(-3.0, 0.0)], "lon double, lat double")
    assert G.reproject(pts, 30).first()["east"] == pytest.approx(500000)


def test_stream(spark, tmp_path):
    from panelweave.streaming.windows import daily_metrics, read_events, run_once

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(f"{tmp_path}/ev")
    got = run_once(daily_metrics(read_events(spark, f"{tmp_path}/ev", src.schema), "60 days"), "daily", f"{tmp_path}/cp")
    want = daily_metrics(src)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
