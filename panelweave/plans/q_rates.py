"""Annual rates, dispersion, seasonality, on lineitem by nation."""

from pyspark.sql import functions as F

from ..operators import rates as R
from ..operators.adapters import monthly, units
from .registry import out, query

MON = """
m AS (SELECT CAST(s_nationkey AS BIGINT) AS unit_id, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS yyyymm, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS area,
  sum(l_quantity) AS quantity, count(*) AS n, CAST(100 + 7 * s_nationkey AS DOUBLE) AS support FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
p AS (SELECT m.*, CAST(n_regionkey AS BIGINT) AS parent_id FROM m JOIN nation ON unit_id = n_nationkey)
"""
ANNUAL = f"""WITH {MON},
a AS (SELECT unit_id, yyyymm // 100 AS year, sum(area) AS total, count(*) AS k, min(support) AS support FROM m GROUP BY ALL),
r AS (SELECT unit_id, year, total, support, CASE WHEN k <> 12 THEN 'incomplete' ELSE 'ok' END AS status, CASE WHEN k = 12 THEN 100 * total / support END AS rate FROM a),
u AS (SELECT unit_id, count(*) AS n_years, sum(total) AS total, avg(total) AS mean_annual_total, avg(rate) AS mean_annual_rate, min(support) AS support FROM r WHERE status = 'ok' GROUP BY unit_id),
up AS (SELECT u.*, CAST(n_regionkey AS BIGINT) AS parent_id FROM u JOIN nation ON unit_id = n_nationkey)
"""


def annual(spark, d):
    return R.annual_rate(monthly(spark, d), ["unit_id"], "area", "support")


def summaries(spark, d):
    return R.unit_summary(annual(spark, d), ["unit_id"]).join(units(spark, d).select("unit_id", "parent_id"), "unit_id")


@query("q_annual_rate", ANNUAL + "SELECT unit_id, year, round(total, 6) AS total, support, status, round(rate, 6) AS rate FROM r")
def annual_rate(spark, d):
    return out(annual(spark, d))


@query("q_unit_summary", ANNUAL + "SELECT unit_id, n_years, round(total, 6) AS total, round(mean_annual_total, 6) AS mean_annual_total, round(mean_annual_rate, 6) AS mean_annual_rate, support FROM u")
def unit_summary(spark, d):
    return out(R.unit_summary(annual(spark, d), ["unit_id"]))


@query("q_annualise_support", f"WITH {MON} SELECT unit_id, yyyymm // 100 AS year, CASE WHEN count(*) = 12 AND count(*) FILTER (n >= 5) = 12 THEN round(sum(quantity), 6) END AS value, count(*) = 12 AS complete, count(*) FILTER (n >= 5) = 12 AS supported FROM m GROUP BY ALL")
def annualise(spark, d):
    return out(R.annualise(monthly(spark, d), ["unit_id"], "quantity", F.col("n") >= 5))


GINI = "gr AS (SELECT parent_id, mean_annual_rate AS x, row_number() OVER (PARTITION BY parent_id ORDER BY mean_annual_rate) AS rk FROM up), gg AS (SELECT parent_id, 2 * sum(rk * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*) AS gini FROM gr GROUP BY parent_id)"


@query("q_dispersion", ANNUAL + f", {GINI} SELECT parent_id, count(*) AS n, round(median(mean_annual_rate), 6) AS median, round(quantile_cont(mean_annual_rate, 0.25), 6) AS q25, round(quantile_cont(mean_annual_rate, 0.75), 6) AS q75, round(quantile_cont(mean_annual_rate, 0.75) - quantile_cont(mean_annual_rate, 0.25), 6) AS iqr, round(any_value(gini), 6) AS gini FROM up JOIN gg USING (parent_id) GROUP BY parent_id")
def dispersion(spark, d):
    return out(R.dispersion(summaries(spark, d), ["parent_id"], "mean_annual_rate"))


@query("q_gini", ANNUAL + f", {GINI} SELECT parent_id, round(gini, 6) AS gini FROM gg")
def gini(spark, d):
    return out(R.gini(summaries(spark, d), ["parent_id"], "mean_annual_rate"))


CLIM = f"WITH {MON}, c AS (SELECT unit_id, yyyymm % 100 AS month, avg(area) AS mean FROM m GROUP BY ALL), s AS (SELECT *, mean / sum(mean) OVER (PARTITION BY unit_id) AS share FROM c), v AS (SELECT unit_id, sum(share * cos(2 * pi() * (month - 1) / 12)) AS c, sum(share * sin(2 * pi() * (month - 1) / 12)) AS s, arg_min(month, -mean * 1000 + month / 1000) AS peak_month FROM s GROUP BY unit_id), t AS (SELECT *, CASE WHEN atan2(s, c) < 0 THEN atan2(s, c) + 2 * pi() ELSE atan2(s, c) END AS theta, sqrt(s * s + c * c) AS r FROM v)"


@query("q_climatology", CLIM + " SELECT unit_id, month, round(mean, 6) AS mean, round(share, 6) AS share FROM s")
def climatology(spark, d):
    return out(R.climatology(monthly(spark, d), ["unit_id"], "area"))


@query("q_circular", CLIM + " SELECT unit_id, peak_month, round(theta, 6) AS direction, round(1 + 12 * theta / (2 * pi()) - CASE WHEN 1 + 12 * theta / (2 * pi()) > 12 THEN 12 ELSE 0 END, 6) AS circular_mean_month, round(r, 6) AS resultant_length, 'ok' AS status FROM t")
def circular(spark, d):
    return out(R.seasonality(R.climatology(monthly(spark, d), ["unit_id"], "area"), ["unit_id"]))


PARENT = ", pr AS (SELECT parent_id, sum(area) / (count(DISTINCT yyyymm) / 12.0) AS t, parent_id FROM p GROUP BY parent_id), ps AS (SELECT CAST(n_regionkey AS BIGINT) AS parent_id, sum(100 + 7 * n_nationkey) AS support FROM nation GROUP BY 1), px AS (SELECT pa.parent_id, avg(100 * pa.total / ps.support) AS rate FROM (SELECT parent_id, yyyymm // 100 AS year, sum(area) AS total FROM p GROUP BY ALL HAVING count(DISTINCT yyyymm) = 12) pa JOIN ps USING (parent_id) GROUP BY pa.parent_id)"


@query("q_departure", ANNUAL + PARENT + " SELECT unit_id, up.parent_id, round(mean_annual_rate, 6) AS mean_annual_rate, round(rate, 6) AS parent_rate, round(mean_annual_rate - rate, 6) AS departure FROM up JOIN px USING (parent_id)")
def departure(spark, d):
    u = units(spark, d).select("unit_id", "parent_id")
    support = u.groupBy("parent_id").agg(F.sum(100 + 7 * F.col("unit_id")).cast("double").alias("support"))
    pm = monthly(spark, d).join(u, "unit_id").groupBy("parent_id", "yyyymm").agg(F.sum("area").alias("area")).join(support, "parent_id")
    parents = R.unit_summary(R.annual_rate(pm, ["parent_id"], "area", "support"), ["parent_id"])
    return out(R.departure(summaries(spark, d), parents, "parent_id", "mean_annual_rate", "mean_annual_rate").select("unit_id", "parent_id", "mean_annual_rate", "parent_rate", "departure"))


@query("q_month_distance", CLIM + " SELECT unit_id, least(abs(peak_month - 1), 12 - abs(peak_month - 1)) AS from_january FROM t")
def distance(spark, d):
    from ..functions.scalars import month_distance

    s = R.seasonality(R.climatology(monthly(spark, d), ["unit_id"], "area"), ["unit_id"])
    return out(s.select("unit_id", month_distance("peak_month", F.lit(1)).alias("from_january")))


@query("q_describe", f"WITH {MON}, l AS (SELECT 'area' AS variable, area AS v FROM m UNION ALL SELECT 'quantity', quantity FROM m) SELECT variable, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS least, quantile_cont(v, 0.25) AS q25, median(v) AS median, quantile_cont(v, 0.75) AS q75, max(v) AS most FROM l GROUP BY variable")
def describe(spark, d):
    return out(R.describe(monthly(spark, d), ["area", "quantity"]))


@query("q_corr", f"WITH {MON}, c AS (SELECT corr(area, quantity) AS aq, corr(area, n) AS an, corr(quantity, n) AS qn FROM m) SELECT unnest(['area','area','area','quantity','quantity','quantity','n','n','n']) AS a, unnest(['area','quantity','n','area','quantity','n','area','quantity','n']) AS b, round(unnest([1.0, aq, an, aq, 1.0, qn, an, qn, 1.0]), 6) AS r FROM c")
def corr(spark, d):
    return out(R.correlations(monthly(spark, d), ["area", "quantity", "n"]))


@query("q_vif", f"WITH {MON} SELECT unnest(['area', 'quantity']) AS variable, round(1 / (1 - corr(area, quantity) ** 2), 6) AS vif FROM m")
def vif(spark, d):
    return out(R.vif(monthly(spark, d), ["area", "quantity"]))
