"""Scan-program files, recurrence, publication tables."""

from pyspark.sql import functions as F

from ..operators import publish as K
from ..operators import rates as R
from ..operators import scan_io as S
from ..operators import trend as T
from ..operators.adapters import monthly, table, units
from .q_panel import MASK, mask
from .q_rates import ANNUAL, CLIM, GINI, MON, annual, summaries
from .q_trend import SERIES, series
from .registry import out, query

LOCATIONS = "loc AS (SELECT CAST(n_nationkey AS BIGINT) AS unit_id, CAST(n_nationkey + 1 AS BIGINT) AS location_id FROM nation)"


def locations(spark, d):
    return units(spark, d).select("unit_id", (F.col("unit_id") + 1).alias("location_id"), (F.col("unit_id") % 5 + 0.5).cast("double").alias("x"), (F.floor(F.col("unit_id") / 5) + 0.5).cast("double").alias("y"))


@query("q_scan_case_text", f"WITH {MON}, {LOCATIONS} SELECT yyyymm, location_id, location_id || ' ' || CAST(area AS BIGINT) || ' ' || yyyymm // 100 || '/' || yyyymm % 100 || '/1' AS value FROM m JOIN loc USING (unit_id) WHERE area > 0 AND area % 1 = 0")
def case_text(spark, d):
    return out(S.case_lines(S.cases(monthly(spark, d), locations(spark, d), "unit_id", "area")))


@query("q_scan_population_text", f"WITH {MON}, {LOCATIONS} SELECT yyyymm, location_id, location_id || ' ' || yyyymm // 100 || '/' || yyyymm % 100 || '/1 ' || printf('%.9f', support) AS value FROM m JOIN loc USING (unit_id)")
def population_text(spark, d):
    return out(S.population_lines(S.populations(monthly(spark, d), locations(spark, d), "unit_id", "support")))


@query("q_scan_coordinate_text", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS location_id, printf('%d %.6f %.6f', n_nationkey + 1, n_nationkey % 5 + 0.5::DOUBLE, n_nationkey // 5 + 0.5::DOUBLE) AS value FROM nation")
def coordinate_text(spark, d):
    return out(S.coordinate_lines(locations(spark, d)))


@query("q_scan_time_index", "SELECT CAST(y * 100 + mo AS BIGINT) AS yyyymm, CAST((y - 1998) * 12 + mo - 3 + 1 AS BIGINT) AS time_index, y || '/' || mo || '/1' AS date FROM range(1998, 2001) t(y), range(1, 13) u(mo) WHERE y * 100 + mo BETWEEN 199803 AND 200004")
def time_index(spark, d):
    return out(S.time_index(199803, 200004, spark))


CLUST = "cl AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_partkey % 25 + 1 AS loc, 2000 + p_partkey % 3 AS y, p_partkey % 12 + 1 AS m, p_partkey % 7 / 100.0 AS p, p_size FROM part)"


def cluster_lines(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(F.concat_ws("  ", k.cast("string"), (k % 25 + 1).cast("string"), F.lit("1.5"), F.lit("2.5"), F.lit("0"), F.lit("0"), F.concat_ws("/", (2000 + k % 3).cast("string"), (k % 12 + 1).cast("string"), F.lit("1")), F.lit("2003/12/31"), F.col("p_size").cast("string"), F.lit("12.5"), F.format_string("<%.2f", (k % 7 / 100.0)), F.lit("10"), F.lit("4.0"), F.lit("2.5")).alias("value"))


@query("q_scan_parse", f"WITH {CLUST} SELECT k AS cluster, CAST(loc AS VARCHAR) AS location, CAST(y * 100 + m AS BIGINT) AS start, CAST(p_size AS BIGINT) AS n_locations, round(CAST(p AS DOUBLE), 6) AS p, CAST((2003 - y) * 12 + 12 - m + 1 AS BIGINT) AS months FROM cl WHERE p <= 0.05")
def scan_parse(spark, d):
    return out(S.parse_clusters(cluster_lines(spark, d)).select("cluster", "location", "start", "n_locations", "p", "months"))


MEMB = "mb AS (SELECT CAST(o_custkey % 25 + 1 AS VARCHAR) AS location, CAST((o_custkey % 25 + 1) * (1 + o_orderkey % 7) % 40 AS BIGINT) AS cluster, o_orderkey % 9 / 100.0 AS p FROM orders)"


def members(spark, d):
    o = table(spark, d, "orders")
    lines = o.select(F.concat_ws(" ", (F.col("o_custkey") % 25 + 1).cast("string"), ((F.col("o_custkey") % 25 + 1) * (1 + F.col("o_orderkey") % 7) % 40).cast("string"), F.format_string("%.2f", F.col("o_orderkey") % 9 / 100.0)).alias("value"))
    return S.parse_members(lines)


@query("q_recurrence", f"WITH {MEMB}, s AS (SELECT * FROM mb WHERE p <= 0.05), t AS (SELECT count(DISTINCT cluster) AS total FROM s), u AS (SELECT CAST(n_nationkey + 1 AS VARCHAR) AS location, n_nationkey % 6 <> 0 AS eligible FROM nation), k AS (SELECT location, count(DISTINCT cluster) AS k FROM s GROUP BY 1) SELECT u.location, CASE WHEN eligible THEN coalesce(k, 0) END AS clusters, total, CASE WHEN eligible THEN round(coalesce(k, 0) / total, 6) END AS fraction FROM u LEFT JOIN k USING (location), t")
def recur(spark, d):
    u = units(spark, d).select((F.col("unit_id") + 1).cast("string").alias("location"), (F.col("unit_id") % 6 != 0).alias("eligible"))
    return out(S.recurrence(members(spark, d), u))


@query("q_members_listagg", f"WITH {MEMB}, s AS (SELECT DISTINCT cluster, location FROM mb WHERE p <= 0.05) SELECT cluster, string_agg(location, '|' ORDER BY CAST(location AS INT)) AS members FROM s GROUP BY cluster")
def listagg(spark, d):
    return out(S.member_list(members(spark, d), "cluster"))


@query("q_sorted_list", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS joined FROM nation GROUP BY 1")
def sorted_list(spark, d):
    return out(K.sorted_list(table(spark, d, "nation"), ["n_regionkey"], "n_name"))


@query("q_scan_keys", f"WITH {MON} SELECT 'case_location' AS \"check\", count(*) FILTER (unit_id >= 20) AS n FROM m WHERE area > 0 UNION ALL SELECT 'case_month', count(*) FILTER (yyyymm > 200012) FROM m WHERE area > 0")
def scan_keys(spark, d):
    c = S.cases(monthly(spark, d), locations(spark, d), "unit_id", "area")
    return out(S.key_problems(c, None, locations(spark, d).where("location_id <= 20"), S.time_index(199501, 200012, spark)))


SPREAD = f"{GINI}, sp AS (SELECT parent_id, median(mean_annual_rate) AS median, quantile_cont(mean_annual_rate, 0.75) - quantile_cont(mean_annual_rate, 0.25) AS iqr FROM up GROUP BY parent_id)"


@query("q_table1", SERIES + f", {SPREAD}, par AS (SELECT n_regionkey AS parent_id, min(n_nationkey) AS lead FROM nation GROUP BY 1), sl AS (SELECT unit_id, median(slope) AS sen_slope FROM pairs GROUP BY 1) SELECT CAST(par.parent_id AS BIGINT) AS parent_id, round(mean_annual_rate, 6) AS rate, round(median, 6) AS median, round(iqr, 6) AS iqr, round(gini, 6) AS gini, round(sen_slope, 6) AS sen_slope FROM par JOIN u ON u.unit_id = lead JOIN sp USING (parent_id) JOIN gg USING (parent_id) JOIN sl ON sl.unit_id = lead")
def table1(spark, d):
    lead = units(spark, d).groupBy("parent_id").agg(F.min("unit_id").alias("unit_id"))
    s = summaries(spark, d)
    rates = lead.join(s.drop("parent_id"), "unit_id").select("parent_id", F.col("mean_annual_rate").alias("rate"))
    spread = R.dispersion(s, ["parent_id"], "mean_annual_rate").select("parent_id", "median", "iqr", "gini")
    slopes = lead.join(T.sen_slope(series(spark, d), ["unit_id"], "year", "rate"), "unit_id").select("parent_id", "sen_slope")
    return out(K.table_one(rates, spread, slopes, "parent_id"))


@query("q_map_source", MASK + ", v AS (SELECT unit_id, sum(area) AS value FROM m WHERE yyyymm = 199701 GROUP BY 1) SELECT e.unit_id, CASE WHEN exclusion_reasons <> '' THEN 'excluded' WHEN value = 0 THEN 'valid_zero' WHEN value IS NOT NULL THEN 'valid_nonzero' END AS support_status, CASE WHEN exclusion_reasons = '' THEN value END AS value, exclusion_reasons FROM e LEFT JOIN v USING (unit_id)")
def map_source(spark, d):
    v = monthly(spark, d).where("yyyymm = 199701").select("unit_id", F.col("area").alias("v"))
    return out(K.map_source(units(spark, d).select("unit_id"), v, mask(spark, d), "unit_id", "v"))


@query("q_union_long", "SELECT 'region' AS record_type, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, CAST(NULL AS BIGINT) AS n_nationkey, CAST(NULL AS VARCHAR) AS n_name FROM region UNION ALL SELECT 'nation', NULL, NULL, n_nationkey, n_name FROM nation")
def union_long(spark, d):
    return out(K.union_records({"region": table(spark, d, "region"), "nation": table(spark, d, "nation").select("n_nationkey", "n_name")}))


WIDE = CLIM + ", w AS (SELECT unit_id, " + ", ".join(f"round(max(mean) FILTER (month = {m}), 6) AS mean_m{m:02d}" for m in range(1, 13)) + " FROM s GROUP BY unit_id)"


@query("q_pivot", WIDE + " SELECT * FROM w")
def pivot(spark, d):
    return out(K.pivot_months(R.climatology(monthly(spark, d), ["unit_id"], "area"), ["unit_id"], "mean", "mean"))


@query("q_unpivot", CLIM + " SELECT unit_id, month, round(mean, 6) AS mean FROM s")
def unpivot(spark, d):
    wide = K.pivot_months(R.climatology(monthly(spark, d), ["unit_id"], "area"), ["unit_id"], "mean", "mean")
    return out(K.unpivot_months(wide, ["unit_id"], "mean", "mean"))


@query("q_display_order", ANNUAL + " SELECT unit_id, parent_id, row_number() OVER (ORDER BY list_position([3, 1, 4, 0, 2], parent_id), mean_annual_rate NULLS LAST, unit_id) AS display_order FROM up")
def display(spark, d):
    return out(K.display_order(summaries(spark, d).withColumn("parent_id", F.col("parent_id").cast("int")), [3, 1, 4, 0, 2], "parent_id", "mean_annual_rate", "unit_id").select("unit_id", "parent_id", "display_order"))


@query("q_top_examples", ANNUAL + " SELECT unit_id, year, round(rate, 6) AS rate FROM r WHERE status = 'ok' ORDER BY rate DESC, unit_id, year LIMIT 10")
def top(spark, d):
    return out(K.top_examples(annual(spark, d).where("status = 'ok'").select("unit_id", "year", "rate"), [F.desc("rate"), "unit_id", "year"], 10))


@query("q_registry", "SELECT 'units' AS result_id, unnest(['n', 'most']) AS field, unnest([CAST(count(*) AS VARCHAR), CAST(max(n_nationkey) AS VARCHAR)]) AS value FROM nation UNION ALL SELECT 'zones', 'n', CAST(count(*) AS VARCHAR) FROM region")
def registry(spark, d):
    n = table(spark, d, "nation").agg(F.count(F.lit(1)).alias("n"), F.max("n_nationkey").alias("most"))
    return K.registry({"units": n, "zones": table(spark, d, "region").agg(F.count(F.lit(1)).alias("n"))})
