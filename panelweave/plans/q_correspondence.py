"""Correspondence of two products, diagnostics, and the penalised model."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import pgee as G
from ..operators import rates as R
from ..operators.adapters import monthly, units
from .q_rates import MON
from .registry import out, query

PAIR = f"WITH {MON}, f AS (SELECT p.*, CAST(area >= 60 AS BIGINT) AS a, CAST(n >= 9 AS BIGINT) AS b FROM p)"


def flags(spark, d):
    u = units(spark, d).select("unit_id", "parent_id")
    return monthly(spark, d).join(u, "unit_id").withColumns({"a": (F.col("area") >= 60).cast("int"), "b": (F.col("n") >= 9).cast("int")})


@query("q_four_state", PAIR + ", s AS (SELECT parent_id, CASE WHEN a = 1 AND b = 1 THEN 'both' WHEN a = 1 THEN 'left_only' WHEN b = 1 THEN 'right_only' ELSE 'neither' END AS state FROM f), g AS (SELECT 'overall' AS scope, CAST(NULL AS BIGINT) AS parent, state, count(*) AS n FROM s GROUP BY state UNION ALL SELECT 'parent', parent_id, state, count(*) FROM s GROUP BY ALL), w AS (SELECT scope, parent, CAST(sum(n) AS BIGINT) AS denominator FROM g GROUP BY ALL), st AS (SELECT unnest(['both', 'left_only', 'right_only', 'neither']) AS state, CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS state_order) SELECT w.scope, w.parent, st.state, state_order, coalesce(g.n, 0) AS n, denominator, round(coalesce(g.n, 0) / denominator, 6) AS proportion FROM w CROSS JOIN st LEFT JOIN g ON g.scope = w.scope AND g.parent IS NOT DISTINCT FROM w.parent AND g.state = st.state")
def four_state(spark, d):
    return out(R.four_states(flags(spark, d), "a", "b", "parent_id"))


@query("q_mismatch", PAIR + " SELECT unit_id, count(*) AS months, count(*) FILTER (a = 1) AS positive, count(*) FILTER (a = 1 AND b = 0) AS mismatched, round(count(*) FILTER (a = 1 AND b = 0) / nullif(count(*) FILTER (a = 1), 0), 6) AS share FROM f GROUP BY unit_id")
def mismatch(spark, d):
    return out(R.mismatch_by_unit(flags(spark, d), "unit_id", "a", "b"))


@query("q_support_audit", PAIR + " SELECT yyyymm, count(*) AS rows, count(*) FILTER (n >= 5) AS supported, count(*) FILTER (n < 5) AS structural_missing, CAST(0 AS BIGINT) AS numeric_missing, count(*) FILTER (n >= 5 AND area = 0) AS zero, count(*) FILTER (n >= 5 AND area > 0) AS positive FROM f GROUP BY yyyymm")
def audit(spark, d):
    return out(R.support_audit(flags(spark, d), "area", F.col("n") >= 5))


@query("q_separation", PAIR + ", l AS (SELECT a, 'month' AS factor, CAST(yyyymm % 100 AS VARCHAR) AS level FROM f UNION ALL SELECT a, 'parent_id', CAST(parent_id AS VARCHAR) FROM f) SELECT factor, level, count(*) AS n, count(*) FILTER (a = 1) AS y1, count(*) FILTER (a = 0) AS y0, round(count(*) FILTER (a = 1) / count(*), 6) AS prevalence, count(*) FILTER (a = 1) = 0 OR count(*) FILTER (a = 0) = 0 AS separated FROM l GROUP BY ALL")
def separation(spark, d):
    return out(R.separation(flags(spark, d).withColumn("month", F.col("yyyymm") % 100), "a", ["month", "parent_id"]))


@query("q_cluster_sizes", PAIR + ", c AS (SELECT unit_id, count(*) AS n, sum(a) AS s FROM f GROUP BY unit_id) SELECT count(*) AS clusters, min(n) AS least, median(n) AS median, round(avg(n), 6) AS mean, max(n) AS most, count(*) FILTER (s = n) AS all_one, count(*) FILTER (s = 0) AS all_zero FROM c")
def clusters(spark, d):
    return out(R.cluster_sizes(flags(spark, d), "unit_id", "a"))


def design(spark, d):
    rows = G.population(flags(spark, d), "n", "b").withColumns({"intercept": F.lit(1.0), "x": F.log2(F.col("n").cast("double"))})
    rows, names = G.dummies(rows, "parent_id", "zone")
    return rows, ["intercept", "x", *names]


@query("q_design_matrix", PAIR + " SELECT unit_id, yyyymm, CAST(1 - b AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS intercept, round(log2(n), 6) AS x, CAST(parent_id = 1 AS INT)::DOUBLE AS zone_1, CAST(parent_id = 2 AS INT)::DOUBLE AS zone_2, CAST(parent_id = 3 AS INT)::DOUBLE AS zone_3, CAST(parent_id = 4 AS INT)::DOUBLE AS zone_4 FROM f WHERE n > 0")
def design_matrix(spark, d):
    rows, terms = design(spark, d)
    return out(rows.select("unit_id", "yyyymm", "y", *terms))


@query("q_firth_score0", PAIR + ", r AS (SELECT log2(n) AS x, CAST(1 - b AS DOUBLE) AS y FROM f WHERE n > 0), i AS (SELECT sum(0.25) AS i00, sum(0.25 * x) AS i01, sum(0.25 * x * x) AS i11 FROM r) SELECT round(sum(y - 0.5), 6) + 0.0 AS s0, round(sum((y - 0.5) * x), 6) + 0.0 AS s1, round(any_value(i00), 6) AS i00, round(any_value(i01), 6) AS i01, round(any_value(i11), 6) AS i11 FROM r, i")
def score0(spark, d):
    rows, _ = design(spark, d)
    s, i = G.adjusted_score(rows, ["intercept", "x"], np.zeros(2))
    return out(spark.createDataFrame([(float(s[0]), float(s[1]), float(i[0, 0]), float(i[0, 1]), float(i[1, 1]))], "s0 double, s1 double, i00 double, i01 double, i11 double"))


@query("q_pgee_fit")
def pgee(spark, d):
    rows, _ = design(spark, d)
    return out(G.coefficients(G.dispatch("firth_pgee_independence")(rows, ["intercept", "x"], "unit_id"), spark))


#: The fit of two terms as Newton steps of a recursive query, and its small-sample covariance by the entries of 2 x 2 matrices.
FIT = PAIR.replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT unit_id, log2(n) AS x, CAST(1 - b AS DOUBLE) AS y FROM f WHERE n > 0),
it AS (SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 UNION ALL SELECT k + 1, b0 + (i11 * s0 - i01 * s1) / (i00 * i11 - i01 * i01), b1 + (i00 * s1 - i01 * s0) / (i00 * i11 - i01 * i01) FROM (
  SELECT k, any_value(b0) AS b0, any_value(b1) AS b1, any_value(i00) AS i00, any_value(i01) AS i01, any_value(i11) AS i11, sum(y - mu + h * (0.5 - mu)) AS s0, sum(x * (y - mu + h * (0.5 - mu))) AS s1 FROM (
    SELECT *, mu * (1 - mu) * (i11 - 2 * x * i01 + x * x * i00) / (i00 * i11 - i01 * i01) AS h FROM (
      SELECT *, sum(mu * (1 - mu)) OVER () AS i00, sum(mu * (1 - mu) * x) OVER () AS i01, sum(mu * (1 - mu) * x * x) OVER () AS i11 FROM (
        SELECT k, b0, b1, x, y, 1 / (1 + exp(-(b0 + b1 * x))) AS mu FROM it, r WHERE k < 40))) GROUP BY k)),
e AS (SELECT unit_id, x, y, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) AS mu FROM r, it WHERE k = 40),
i AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(mu * (1 - mu)) AS i00, sum(mu * (1 - mu) * x) AS i01, sum(mu * (1 - mu) * x * x) AS i11, count(*) AS n FROM e),
c AS (SELECT unit_id, sum(y - mu) AS s0, sum((y - mu) * x) AS s1 FROM e GROUP BY unit_id),
fm AS (SELECT count(*) AS k, sum(s0 * s0) - sum(s0) * sum(s0) / count(*) AS c00, sum(s0 * s1) - sum(s0) * sum(s1) / count(*) AS c01, sum(s1 * s1) - sum(s1) * sum(s1) / count(*) AS c11 FROM c),
z AS (SELECT b0, b1, i11 / (i00 * i11 - i01 * i01) AS p, -i01 / (i00 * i11 - i01 * i01) AS q, i00 / (i00 * i11 - i01 * i01) AS s, c00 * k / (k - 1) * (n - 1) / (n - 2) AS m00, c01 * k / (k - 1) * (n - 1) / (n - 2) AS m01, c11 * k / (k - 1) * (n - 1) / (n - 2) AS m11, least(0.5, 2.0 / (k - 2)) AS delta FROM i, fm),
y AS (SELECT *, greatest(1, (p * m00 + 2 * q * m01 + s * m11) / 2) * delta AS a, p * m00 + q * m01 AS g00, p * m01 + q * m11 AS g01, q * m00 + s * m01 AS g10, q * m01 + s * m11 AS g11 FROM z),
v AS (SELECT b0, b1, g00 * p + g01 * q + a * p AS v00, g00 * q + g01 * s + a * q AS v01, g10 * q + g11 * s + a * s AS v11 FROM y)
"""
DIGITS = "round({0} / pow(10, floor(log10(abs({0})))), 5) AS mantissa, CAST(floor(log10(abs({0}))) AS BIGINT) AS exponent"


def digits(value):
    """Six significant digits, since the size of a covariance depends on the data."""
    e = F.floor(F.log10(F.abs(value)))
    return F.round(value / F.pow(F.lit(10.0), e), 5).alias("mantissa"), e.alias("exponent")


@query("q_pgee_beta", FIT + ", l AS (SELECT 0 AS o, 'intercept' AS term, b0 AS beta, sqrt(v00) AS se FROM v UNION ALL SELECT 1, 'x', b1, sqrt(v11) FROM v) SELECT CAST(o AS BIGINT) AS term_order, term, round(beta, 5) AS beta, round(se, 5) AS se, round(beta / se, 5) AS z FROM l")
def pgee_beta(spark, d):
    rows, _ = design(spark, d)
    return out(G.coefficients(G.fit_firth(rows, ["intercept", "x"], "unit_id"), spark).select("term_order", "term", "beta", "se", "z"), 5)


@query("q_mbn_cov", FIT + ", l AS (SELECT 0 AS i, 0 AS j, v00 AS v FROM v UNION ALL SELECT 0, 1, v01 FROM v UNION ALL SELECT 1, 0, v01 FROM v UNION ALL SELECT 1, 1, v11 FROM v) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, ['intercept', 'x'][i + 1] AS term_i, ['intercept', 'x'][j + 1] AS term_j, " + DIGITS.format("v") + " FROM l")
def mbn(spark, d):
    rows, _ = design(spark, d)
    cov = G.covariance_long(G.fit_firth(rows, ["intercept", "x"], "unit_id"), spark)
    return out(cov.select("i", "j", "term_i", "term_j", *digits(F.col("value"))))


@query("q_standardise", PAIR + ", r AS (SELECT log2(n) AS x FROM f WHERE n > 0), q AS (SELECT quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75 FROM r) SELECT unnest([25, 75])::BIGINT AS quantile, round(unnest([1 / (1 + exp(-(0.5 - 0.2 * q25))), 1 / (1 + exp(-(0.5 - 0.2 * q75)))]), 6) AS probability FROM q")
def standardise(spark, d):
    """Mean probability at the quartiles of x, under fixed coefficients so that SQL can say the same."""
    rows, _ = design(spark, d)
    q = rows.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    fit = G.Fit(["intercept", "x"], np.array([0.5, -0.2]), np.eye(2), 0, 0, 0)
    parts = [G.standardised_probability(rows, fit, "x", v).withColumn("quantile", F.lit(k)) for k, v in ((25, q[0]), (75, q[1]))]
    return out(parts[0].unionByName(parts[1]).select("quantile", "probability"))
