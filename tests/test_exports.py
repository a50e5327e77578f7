"""Exports, validators and bundles."""

import pytest
from pyspark.sql import functions as F

from panelweave import runs
from panelweave.__main__ import main
from panelweave.operators import exports as E
from panelweave.operators import geometry as G


def test_materialise_and_load(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, s string")
    rec = E.materialise({"one": (df, ["k"]), "two": (df.where("k = 1"), ["k"])}, str(tmp_path))
    assert [r["name"] for r in rec] == ["one", "two"]
    assert E.load_materialised(spark, str(tmp_path))["one"].count() == 2
    with pytest.raises(FileExistsError):
        E.materialise({"one": (df, ["k"])}, str(tmp_path))
    (tmp_path / "two.csv").write_text("k,s\n9,z\n")
    with pytest.raises(ValueError, match="digest"):
        E.load_materialised(spark, str(tmp_path))


def test_universe_and_crosswalk(spark, tmp_path):
    z = spark.createDataFrame([("Z", "Zone", 2.0)], "unit_id string, unit_name string, area_sqkm double")
    f = spark.createDataFrame([("b", "B", 1.0, "Z"), ("a", "A", 1.25, "Z")], "unit_id string, unit_name string, area_sqkm double, parent_id string")
    assert [(r["unit_id"], r["area_sqkm"], r["parent_id"]) for r in E.universe_rows(z, f).collect()] == [("Z", "2.000000", None), ("a", "1.250000", "Z"), ("b", "1.000000", "Z")]
    a = spark.createDataFrame([("a", "Z", 0.75), ("b", None, 0.0)], "d string, zone string, share double")
    assert [tuple(r) for r in E.crosswalk_rows(a, spark.createDataFrame([("Z", "ZN")], "zone string, code string"), "d", "zone").collect()] == [("a", "Z", "ZN", 0.75)]
    with pytest.raises(ValueError):
        E.field_crosswalk(spark, {"a": "a_very_long_name"})
    E.write_partitioned(f, f"{tmp_path}/p", ["parent_id"], ["unit_id"])
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    q = E.qa_tables(spark.createDataFrame([(1, "a", True), (2, None, False)], "i int, u string, m boolean"), "u", "m")
    assert (q["unmatched"].count(), q["outside"].count(), q["summary"].first()["matched_rate"]) == (1, 1, 0.5)


def test_validators(spark):
    assert E.validate_manifest({"a": 1}, {"a": 1, "b": 2}) == ["b: None is not 2"]
    audit = spark.createDataFrame([("x", 10, 0), ("y", 9, 2)], "level string, actual_rows int, duplicate_key_rows int")
    assert len(E.validate_audit(audit, {"x": 10, "y": 9, "z": 1})) == 2
    assert E.validate_inputs(0, {"f": "1"}, {"f": "2"}) == {"scientific": "PASS", "bytes": {"f": "DIFFERENT"}}
    assert E.advance("run", "validated") == "validated"
    with pytest.raises(ValueError):
        E.advance("integrated", "run")
    df = spark.createDataFrame([(1, -1.0)], "i int, x double")
    assert E.sample_schema_problems(df, ["i", "x"], [{"name": "x", "dtype": "number", "low": 0}]).first()["rule"] == "x:low"


def test_bundles(spark):
    rows = [(u, y * 100 + m, float((u + 1) * m + y % 7 + (y * 3 + u) % 5), 100.0 + u) for u in range(4) for y in range(2001, 2009) for m in range(1, 13)]
    m = spark.createDataFrame(rows, "unit_id int, yyyymm int, v double, s double")
    b = E.seasonal_bundle(m, ["unit_id"], "v", "s")
    assert b["summary"].count() == 4 and {r["peak_month"] for r in b["seasonality"].collect()} == {12}
    t = E.trend_bundle(b["annual"], ["unit_id"], replications=99)
    assert t.count() == 4
    schema = f"unit_id int, polygon {G.POLYGON.simpleString()}"
    sq = lambda x: [[{"x": x, "y": 0.0}, {"x": x + 1, "y": 0.0}, {"x": x + 1, "y": 1.0}, {"x": x, "y": 1.0}]]
    units = spark.createDataFrame([(i, sq(float(i))) for i in range(4)], schema)
    vals = b["summary"].select("unit_id", F.col("mean_annual_rate").alias("x"))
    sb = E.spatial_bundle(vals, G.queen_edges(units), "unit_id", "x", 49)
    assert sb.count() == 5 and sb.where("record_type = 'global'").first()["moran_i"] is not None
    zones = units.select(F.col("unit_id").alias("zone"), "polygon").where("zone < 3")
    p = E.projection_sensitivity(units, zones, units, zones, "unit_id", "zone")
    assert p.where("same").count() == 4 and p.where("zone is null").count() == 1
    assert E.population_table([{"population_id": "a", "units": 3}], spark).first()["rows"] is None


def test_command_line(capsys):
    assert main(["list"]) == 0 and "q_monthly_metrics" in capsys.readouterr().out
    assert main(["sql", "q_spine"]) == 0 and main([]) == 2 and main(["sql", "none"]) == 2 and main(["run", "none", "x"]) == 2
    assert main(["doctor"]) == 0 and "pyspark" in capsys.readouterr().out
    assert main(["plan-years", "--years", "2014-2016,2018", "--years-of", "viirs=2016"]) == 0
    assert '"modis": [2014, 2015, 2016, 2018], "viirs": [2016]' in capsys.readouterr().out
    assert main(["run-all", "x", "y", "--only", "q_spine", "--dry-run"]) == 0 and main(["run-all", "x", "y", "--only", "none"]) == 2


def test_years():
    for bad in ("", "14", "2016-2014", "2014-"):
        with pytest.raises(ValueError):
            runs.parse_years(bad)
    with pytest.raises(ValueError):
        runs.plan_years(["modis", "viirs"], None, {"viirs": "2016"})
    with pytest.raises(ValueError):
        runs.plan_years(["modis"], "2016", {"other": "2016"})


def test_run_is_resumed_and_validated(spark, tmp_path):
    out, asked = f"file://{tmp_path}/run", []

    def one(name):
        def query(s, tables):
            asked.append(name)
            if name == "c" and asked.count("c") == 1:
                raise RuntimeError("lost")
            return s.range(5).selectExpr("id", f"'{name}' as name", "cast(null as string) as none")
        return query

    queries = {n: one(n) for n in "abc"}
    with pytest.raises(RuntimeError):
        runs.run_all(spark, queries, "", out)
    assert sorted(runs.status(spark, out)) == ["a", "b"]
    with pytest.raises(FileExistsError):
        runs.run_all(spark, queries, "", out)
    assert runs.run_all(spark, queries, "", out, resume=True) == {"a": "kept", "b": "kept", "c": "done"}
    assert asked == ["a", "b", "c", "c"] and runs.validate(spark, out) == []
    spark.range(5).selectExpr("id", "'x' as name", "cast(null as string) as none").write.mode("overwrite").parquet(f"{out}/tables/b")
    assert runs.validate(spark, out) == ["b"]
