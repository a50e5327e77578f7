"""Missingness, joins, flags and rules on small fixtures."""

import pytest
from pyspark.sql import functions as F

from panelweave.functions import scalars as S
from panelweave.operators import consolidate as C
from panelweave.operators import detections as D
from panelweave.operators import identity as I
from panelweave.operators import panel as P
from panelweave.operators import publish as K
from panelweave.operators import quality as Q
from panelweave.operators import scan_io as N


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_zero_against_missing(spark):
    spine = P.spine(spark.createDataFrame([("u",)], "unit_id string"), 202312, 202402)
    m = spark.createDataFrame([("u", 202401, 1, 2, 3, 5, 2, 10.0, None, 50.0, 2, 1, 4.0), ("u", 202312, 9, 9, 9, 9, 9, 9.0, 9.0, 9.0, 9, 9, 9.0)], "unit_id string, yyyymm int, det_low int, det_nominal int, det_high int, det_nh int, frp_active_days int, frp_sum double, frp_mean double, pct_high_conf double, days_active_nh int, streak_max_nh int, frp_p95 double")
    got = {r["yyyymm"]: r for r in P.fill_covered(P.onto_spine(spine, m, ["unit_id", "yyyymm"]), P.in_coverage(202401)).collect()}
    assert got[202312]["det_low"] is None and got[202312]["frp_sum"] is None
    assert (got[202401]["frp_mean"], got[202401]["det_nh"]) == (5.0, 5)
    assert (got[202402]["det_low"], got[202402]["frp_sum"], got[202402]["frp_mean"], got[202402]["pct_high_conf"], got[202402]["streak_max_nh"]) == (0, 0.0, None, None, None)


def test_flags_and_division(spark):
    n = F.lit(None).cast("int")
    assert one(spark, S.safe_divide(F.lit(1), F.lit(0)), S.safe_divide(F.lit(1), F.lit(-2)), S.safe_divide(n, F.lit(2)), S.safe_divide(F.lit(1), F.lit(4), 100.0)) == (None, None, None, 25.0)
    assert one(spark, S.flag_of(F.lit(False), [n, F.lit(1)]), S.flag_of(F.lit(False), [F.lit(1)]), S.positive_flag(F.lit(3)), S.positive_flag(F.lit(3), F.lit(False))) == (None, 0, 1, None)
    assert one(spark, S.null_aware_sum(n, n), S.null_aware_sum(n, F.lit(2))) == (None, 2)


def test_text_and_time(spark):
    t = lambda f, *a: one(spark, f(*a))[0]
    assert [t(S.hhmm, F.lit(x)) for x in ("5", "2359", "2360", "x", "-1", "1275")] == ["0005", "2359", None, None, None, None]
    assert [t(S.parse_month_key, F.lit(x)) for x in ("200102", "2001-12", "200113", "x")] == [200102, 200112, None, None]
    assert t(S.add_months_key, F.lit(199911), 3) == 200002 and t(S.month_distance, F.lit(12), F.lit(1)) == 1
    assert t(S.rounded_text, F.lit(33.3335), 3) == "33.334" and t(S.scan_date, F.lit(200107)) == "2001/7/1"
    assert t(S.snake_slug, F.lit("Upper-East  Region")) == "upper_east_region" and t(S.title_slug, F.lit("upper EAST b")) == "Upper_East_B"
    assert t(S.normal_text, F.lit("  ﬁ  x ")) == "fi x"
    assert one(spark, *S.study_bounds(F.lit(202402), F.lit(202402)))[1].day == 29
    assert S.derive_codes(["North East", "New Earth", "Nine Elms", "Volta"], {"Volta": "V"}) == ["NE", "NE2", "NE3", "V"]
    with pytest.raises(Exception, match="not positive"):
        spark.range(1).select(S.log2_checked(F.lit(0.0))).collect()


def test_persistence_and_dedup(spark):
    rows = [("u", f"2024-01-{d:02d}", "h", 1.0) for d in (1, 2, 3, 7, 8)] + [("u", "2024-01-03", "n", 9.0), ("u", "2024-01-04", "l", 2.0), ("v", "2024-01-01", "l", None)]
    pts = spark.createDataFrame(rows, "unit_id string, d string, conf string, frp double").withColumn("acq_date", F.to_date("d"))
    p = {r["unit_id"]: r for r in D.persistence(pts, ["unit_id"]).collect()}
    assert (p["u"]["days_active_nh"], p["u"]["streak_max_nh"]) == (5, 3) and "v" not in p
    m = {r["unit_id"]: r for r in D.monthly_metrics(pts, ["unit_id"]).collect()}
    assert (m["u"]["days_active_nh"], m["u"]["streak_max_nh"], m["u"]["frp_active_days"], m["u"]["frp_sum"]) == (5, 3, 6, 15.0)
    assert (m["v"]["streak_max_nh"], m["v"]["frp_mean"], m["v"]["det_low"]) == (0, None, 1)
    assert D.resolve_window(None, None, (1, None)) == (1, None) and D.resolve_window(None, None, None) == (None, None)


def test_audited_joins_raise(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, 2), (1, 3)], "k int, w int")
    with pytest.raises(ValueError, match="repeated"):
        C.audited_left_join(a, b, ["k"])
    with pytest.raises(ValueError, match="both sides"):
        C.audited_left_join(a, a, ["k"])
    with pytest.raises(Exception, match="no dimension row"):
        C.dimension_join(spark.createDataFrame([(9,)], "k int"), a, ["k"]).collect()
    assert len(C.panel_columns()) == 111 and len(set(C.panel_columns())) == 111
    assert C.panel_columns()[63] == "modis_ba_km2_per100km2_union_ba2001" and C.panel_columns()[-1] == "merge_note"


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, float("nan"), "z"), (None, None, "a")], "i int, x double, s string")
    fields = [{"name": "i", "dtype": "integer", "nullable": False}, {"name": "x", "dtype": "number", "low": 0}, {"name": "s", "dtype": "string", "domain": ["a", "b"]}]
    got = {r["rule"]: r["violations"] for r in Q.check_rules(df, Q.contract_rules(fields)).collect()}
    assert got["i:required"] == 1 and got["x:finite"] == 1 and got["s:domain"] == 1 and got["i:whole"] == 0
    with pytest.raises(ValueError, match="violated"):
        Q.require(df, {"x": F.col("i") > 1})
    with pytest.raises(ValueError, match="another order"):
        Q.require_columns(df, ["x", "i", "s"])
    assert one(spark, Q.worst(F.array(F.lit("pass"), F.lit("warn"))), Q.worst(F.array().cast("array<string>"))) == ("warn", "pass")
    assert one(spark, S.threshold_status(F.lit(0.8), 0.95, 0.8), S.threshold_status(F.lit(0.79), 0.95, 0.8), S.threshold_status(F.lit(None).cast("double"), 0.95)) == ("warn", "fail", "na")
    assert one(spark, S.clamp_share(F.lit(1 + 1e-13)), S.clamp_share(F.lit(1.1))) == (1.0, 1.1)


def test_hierarchy(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", None)], "unit_id string, parent_id string")
    assert {(r["unit_id"], r["root_id"], r["depth"]) for r in I.hierarchy_roots(df).collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 3), ("e", "e", 0)}
    for bad in ([("a", "b"), ("b", "a")], [("a", "zz")]):
        with pytest.raises(ValueError):
            I.hierarchy_roots(spark.createDataFrame(bad, "unit_id string, parent_id string"))


def test_scan_files(spark):
    assert "ModelType=0" in N.parameter_file("poisson", "a.cas", "a.geo", "r", "2001/1/1", "2002/12/31", "a.pop")
    with pytest.raises(ValueError):
        N.parameter_file("permutation", "a", "b", "c", "d", "e", "pop")
    with pytest.raises(Exception, match="fewer than 11"):
        N.parse_clusters(spark.createDataFrame([("1 2 3",)], "value string")).collect()
    clusters = N.parse_clusters(spark.createDataFrame([("1 7 0 0 1 1 2001/1/1 2001/3/31 2 9 <0.01 5 2 2.5",), ("2 8 0 0 1 1 2001/5/1 2001/4/30 3 9 0.2 5 2 2.5",)], "value string"), 0.3)
    members = N.parse_members(spark.createDataFrame([("7 1 0.01",), ("10 1 0.01",), ("9 2 0.2",)], "value string"), 0.3)
    v = {r["cluster"]: r["problems"] for r in N.validate_results(clusters, members).collect()}
    assert v == {1: "", 2: "member_count;centre_not_member;reversed_period"}
    assert N.member_list(members, "cluster").where("cluster = 1").first()["members"] == "7|10"
    assert N.result_state(0, 3) == "EXTERNAL_RESULTS_REQUIRED" and N.result_state(3, 3) == "VALIDATED"
    with pytest.raises(ValueError):
        N.result_state(1, 3)


def test_publication(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, s string"), spark.createDataFrame([(2.0,)], "v double")
    u = K.union_records({"a": a, "b": b})
    assert u.columns == ["record_type", "a", "s", "v"] and u.count() == 2
    with pytest.raises(ValueError):
        K.select_rows(a, "a", 99)
    assert K.figure_violations(spark.createDataFrame([("excluded", 1.0), ("valid_zero", 0.0), ("odd", None)], "support_status string, value double"), ["excluded", "valid_zero"]).count() == 2
