"""Estimators against published values, brute force and properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import geometry as G2
from panelweave.operators import pgee as G
from panelweave.operators import rates as R
from panelweave.operators import spatial as S
from panelweave.operators import trend as T


def test_bh(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.2, 0.5))], "i int, p double")
    q = [r["bh_q"] for r in T.benjamini_hochberg(df, "p").orderBy("i").collect()]
    assert np.allclose(q, [0.05, 0.2 / 3, 0.2 / 3, 0.25, 0.5])


def test_bh_by_family_with_ties_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 7 == 0 else f"f{i % 3}", float(p)) for i, p in enumerate(np.round(rng.random(400) ** 4, 3))] + [(900 + i, "f0", 1.0) for i in range(50)] + [(990, "f1", None), (991, "f1", 0.0), (992, "f2", 5e-324)]
    df = spark.createDataFrame(rows, "i int, family string, p double")
    got = {r["i"]: r["bh_q"] for r in T.benjamini_hochberg(df, "p", ["family"]).collect()}
    want = {}
    for fam in {r[1] for r in rows}:
        own = sorted((p, i) for i, f, p in rows if f == fam and p is not None)
        q = 1.0
        for r in range(len(own), 0, -1):
            q = want[own[r - 1][1]] = min(q, own[r - 1][0] * len(own) / r)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_units_index_against_the_join_by_cells():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        x, y, w = rng.random() * 10, rng.random() * 10, rng.random() * (9 if k % 10 == 0 else 1)
        ring = lambda d: [{"x": x + d, "y": y + d}, {"x": x + w - d, "y": y + d}, {"x": x + w - d, "y": y + w - d}, {"x": x + d, "y": y + w - d}]  # noqa: E731, B023
        rows.append({"polygon": [ring(0), ring(w / 4)], "x0": x, "y0": y, "x1": x + w, "y1": y + w, "area": w * w * 0.75})
    rows.sort(key=lambda r: r["area"])
    xs, ys = np.append(rng.random(3000) * 12 - 1, [np.nan, rows[0]["x0"]]), np.append(rng.random(3000) * 12 - 1, [1.0, rows[0]["y0"]])
    hits = np.array([G2.locate(r["polygon"], xs, ys) for r in rows])
    for within in (False, True):
        inside = hits > 0 if within else hits >= 0
        want = np.where(inside.any(axis=0) & np.isfinite(xs), inside.argmax(axis=0), -1)
        for most in (4, 256):
            assert (G2.UnitIndex(rows, most).find(xs, ys, within) == want).all()


def test_gini(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 1.0, 3.0, 6.0)] + [("b", v) for v in (4.0, 0.0, 0.0, 0.0)] + [("c", 0.0)] * 3 + [("d", -1.0), ("d", 2.0)], "g string, v double")
    got = {r["g"]: r["gini"] for r in R.gini(df, ["g"], "v").collect()}
    assert got["a"] == pytest.approx(0.5) and got["b"] == pytest.approx(0.75) and got["c"] == 0 and got["d"] is None


def test_circular(spark):
    rows = [("a", m, 0.5 if m in (1, 3) else 0.0) for m in range(1, 13)] + [("b", m, 1.0) for m in range(1, 13)] + [("c", m, 0.0) for m in range(1, 13)] + [("d", 1, 1.0)]
    clim = spark.createDataFrame([(u, 2000 * 100 + m, v) for u, m, v in rows], "unit string, yyyymm int, v double")
    got = {r["unit"]: r for r in R.seasonality(R.climatology(clim, ["unit"], "v"), ["unit"], tiny=1e-12).collect()}
    assert got["a"]["circular_mean_month"] == pytest.approx(2.0) and got["a"]["resultant_length"] == pytest.approx(math.sqrt(3) / 2) and got["a"]["peak_month"] == 1
    assert got["b"]["status"] == "undirected" and got["b"]["circular_mean_month"] is None
    assert got["c"]["status"] == "zero_total" and got["d"]["status"] == "incomplete"


def test_sen_interval(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((1, 3, 2, 5, 4, 7))], "unit string, x int, y double")
    r = T.sen_with_interval(df, ["unit"], "x", "y").first()
    assert (r["sen_slope"], r["intercept"]) == (1.0, 1.0)
    assert r["low"] == pytest.approx(-1) and r["high"] == pytest.approx(3)
    assert T.sen_slope(df, ["unit"], "x", "y").first()["sen_slope"] == 1.0


def test_permutation_boundary_ranks(spark):
    ranks = (17, 6, 8, 19, 21, 18, 9, 15, 13, 10, 14, 7, 11, 5, 23, 16, 3, 12, 1, 22, 4, 24, 2, 20)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(ranks)] + [("t", i, 1.0) for i in range(5)], "unit string, x int, y double")
    got = {r["unit"]: r for r in T.mk_permutation(df, ["unit"], "x", "y").collect()}
    assert got["t"]["status"] == "ties" and got["t"]["p"] is None
    assert abs(got["a"]["p"] - 0.5741) < 0.02
    comp = T.mk_components(df.where("unit = 'a'"), ["unit"], "x", "y").first()
    assert comp["bandwidth"] == 2 and comp["t"] == pytest.approx(got["a"]["t"], abs=1e-9)


def test_acf_with_trend_and_ranks(spark):
    y = [1.0, 2.5, 2.0, 4.0, 4.5, 7.0, 6.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "unit string, x int, y double")
    got = [r["acf"] for r in T.autocorrelation(df, ["unit"], "x", "y", 3).orderBy("lag").collect()]
    d = np.array(y) - np.mean(y)
    assert np.allclose(got, [(d[:-k] * d[k:]).sum() / (d @ d) for k in (1, 2, 3)])
    ranked = [r["acf"] for r in T.autocorrelation(df, ["unit"], "x", "y", 1, rank=True).collect()]
    r = pd.Series(y).rank().to_numpy() - 4
    assert np.allclose(ranked, [(r[:-1] * r[1:]).sum() / (r @ r)])


PATH = [("A", "B"), ("B", "A"), ("B", "C"), ("C", "B"), ("C", "D"), ("D", "C")]


def test_moran_path(spark):
    v = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 4.0), ("D", 8.0)], "unit string, x double")
    e = spark.createDataFrame(PATH, "i string, j string")
    w = S.row_standardised(e)
    assert S.global_moran(v, w, "unit", "x").first()["moran_i"] == pytest.approx(0.2913043, abs=1e-6)
    loc = [r["local_i"] for r in S.local_moran(v, w, "unit", "x").orderBy("unit").collect()]
    assert np.allclose(loc, [0.66957, 0.30435, 0.04348, 0.14783], atol=1e-4)
    assert S.moran_permutation(v, e, "unit", "x", 199, 20260819)["p"] == pytest.approx(0.09, abs=0.05)
    p = S.local_moran_permutation(v.union(spark.createDataFrame([("I", 3.0)], v.schema)), e, "unit", "x", 199).orderBy("unit").collect()
    assert p[4]["class"] == "island" and all(0 < r["raw_p"] <= 0.505 for r in p[:4])


def test_local_moran_draws_as_many_as_the_contract(spark):
    v = spark.createDataFrame([(i, 5.0 + 0.01 * i if i < 9 else 0.01 * i) for i in range(30)], "unit long, x double")
    e = spark.createDataFrame([(i, j) for i in range(9) for j in range(9) if i != j], "i long, j long")
    p = [r["raw_p"] for r in S.local_moran_permutation(v, e, "unit", "x").where("raw_p is not null").collect()]
    assert len(p) == 9 and max(p) < 0.001 and all(abs(x * 10_000 - round(x * 10_000)) < 1e-6 for x in p)


def test_firth_on_separated_data(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(120)
    rows = [(1.0, float(v), float(v > 0), f"c{i % 20}") for i, v in enumerate(x)]  # fully separated
    df = spark.createDataFrame(rows, "one double, x double, y double, c string")
    fit = G.fit_firth(df, ["one", "x"], "c")
    assert np.isfinite(fit.beta).all() and np.linalg.eigvalsh(fit.covariance).min() > 0
    score, _ = G.adjusted_score(df, fit.terms, fit.beta)
    assert np.abs(score).max() < 1e-4
    best = G.penalised_loglik(df, fit.terms, fit.beta)
    for d in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)):
        assert G.penalised_loglik(df, fit.terms, fit.beta + np.array(d)) < best
    co = G.coefficients(fit, spark).collect()
    assert [r["term"] for r in co] == ["one", "x"] and all(r["or_low"] < r["odds_ratio"] < r["or_high"] for r in co)
    assert G.covariance_long(fit, spark).count() == 4 and G.fit_summary(fit, spark).first()["clusters"] == 20
    with pytest.raises(ValueError):
        G.fit_firth(df.withColumn("two", F.col("x") * 2), ["x", "two"], "c")
    with pytest.raises(KeyError):
        G.dispatch("something else")


def test_dummies(spark):
    df, names = G.dummies(spark.createDataFrame([("b",), ("a",), ("c",)], "f string"), "f", "f")
    assert names == ["f_b", "f_c"] and sorted(map(tuple, df.collect())) == [("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 0.0, 1.0)]


def test_annual_rate_states(spark):
    rows = [("a", 2000 * 100 + m, 1.0, 50.0) for m in range(1, 13)] + [("b", 200001, 1.0, 50.0)] + [("c", 200000 + m, 1.0, 50.0 + (m == 3)) for m in range(1, 13)] + [("d", 200000 + m, 1.0, 0.0) for m in range(1, 13)]
    got = {r["unit"]: r for r in R.annual_rate(spark.createDataFrame(rows, "unit string, yyyymm int, v double, s double"), ["unit"], "v", "s").collect()}
    assert got["a"]["rate"] == 24.0 and [got[k]["status"] for k in "bcd"] == ["incomplete", "support_varies", "support_not_positive"] and got["b"]["rate"] is None
