"""Text identity, hierarchy, quality rules, raster algebra, streams."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import identity as I
from ..operators import quality as Q
from ..operators import raster as A
from ..operators.adapters import monthly, table, units
from .q_panel import BASE, panel
from .q_rates import MON
from .registry import out, query

PIX = """
px AS (SELECT l_orderkey * 10 + l_linenumber AS obs, l_partkey AS pixel, CAST(year(l_shipdate) AS BIGINT) AS year, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS yyyymm, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS burn_date,
  CAST(l_suppkey % 18 AS BIGINT) AS lc, CAST(l_linenumber % 2 + 1 AS BIGINT) AS lw, CAST(l_orderkey % 8 AS BIGINT) AS qc, CAST(14000 + l_quantity * 20 AS BIGINT) AS dn, l_partkey % 25 AS region, 0.25::DOUBLE AS area FROM lineitem)
"""


def pixels(spark, d):
    """lineitem as observations of pixels (parts) in regions."""
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs"), F.col("l_partkey").alias("pixel"), F.year("l_shipdate").alias("year"), S.yyyymm("l_shipdate").alias("yyyymm"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(F.lit(0)).alias("burn_date"),
        (F.col("l_suppkey") % 18).alias("lc"), (F.col("l_linenumber") % 2 + 1).alias("lw"), (F.col("l_orderkey") % 8).alias("qc"), (14000 + F.col("l_quantity") * 20).cast("long").alias("dn"), (F.col("l_partkey") % 25).alias("region"), F.lit(0.25).alias("area"),
    )


BURN = "lc IN (1,2,3,4,5,6,7,8,9,10,12,14) AND lw = 2 AND lc <> 17"


@query("q_raster_union", f"WITH {PIX} SELECT pixel, bool_or({BURN}) AS in_union FROM px GROUP BY pixel")
def raster_union(spark, d):
    return A.burnable_union(pixels(spark, d))


@query("q_exact_year", f"WITH {PIX} SELECT pixel, count(*) AS n FROM px WHERE year = 1998 GROUP BY pixel")
def exact_year(spark, d):
    return A.exact_year(pixels(spark, d), 1998).groupBy("pixel").agg(F.count(F.lit(1)).alias("n"))


@query("q_burned_any", f"WITH {PIX} SELECT pixel, yyyymm, max(burn_date) > 0 AS burned FROM px GROUP BY ALL")
def burned_any(spark, d):
    return out(A.burned_any(pixels(spark, d), ["pixel", "yyyymm"]))


ZONAL = f"WITH {PIX}, u AS (SELECT pixel, bool_or({BURN}) AS in_union FROM px GROUP BY pixel), b AS (SELECT region, pixel, yyyymm, max(burn_date) > 0 AS burned FROM px GROUP BY ALL), z AS (SELECT region, yyyymm, coalesce(sum(0.25::DOUBLE) FILTER (burned AND in_union), 0) AS area_km2, count(*) FILTER (burned AND in_union) AS pixel_count FROM b JOIN u USING (pixel) GROUP BY ALL)"


def zones(spark, d):
    p = pixels(spark, d)
    b = A.burned_any(p, ["region", "pixel", "yyyymm"]).join(A.burnable_union(p), "pixel").withColumn("area", F.lit(0.25))
    return A.zonal(b, ["region", "yyyymm"], F.col("burned") & F.col("in_union"))


@query("q_zonal_area", ZONAL + " SELECT region, yyyymm, round(area_km2, 6) AS area_km2, pixel_count FROM z")
def zonal(spark, d):
    return out(zones(spark, d))


@query("q_burned_rows", ZONAL + ", d AS (SELECT *, CAST(region % 4 * 20 AS DOUBLE) AS burnable_union, CAST(region % 3 * 30 AS DOUBLE) AS burnable_annual FROM z) SELECT region, yyyymm, round(area_km2, 6) AS area_km2, pixel_count, burnable_union, burnable_annual, CASE WHEN burnable_union > 0 THEN round(area_km2 / burnable_union, 6) END AS burned_frac_union, CASE WHEN burnable_annual > 0 THEN round(area_km2 / burnable_annual, 6) END AS burned_frac_annual, CAST(burnable_union = 0 AS BIGINT) AS zero_union_den_flag, CAST(burnable_annual = 0 AS BIGINT) AS zero_annual_den_flag, CAST(area_km2 > 0 AS BIGINT) AS ba_any, CAST(burnable_union < 50 AS BIGINT) AS small_denominator FROM d")
def burned_rows(spark, d):
    z = zones(spark, d).withColumns({"burnable_union": (F.col("region") % 4 * 20).cast("double"), "burnable_annual": (F.col("region") % 3 * 30).cast("double")})
    return out(A.burned_rows(z))


@query("q_local_national", ZONAL + ", n AS (SELECT yyyymm, sum(area_km2) AS national_km2 FROM z GROUP BY 1) SELECT region, yyyymm, round(area_km2, 6) AS area_km2, pixel_count, round(national_km2, 6) AS national_km2, CAST(area_km2 = 0 AND national_km2 > 0 AS BIGINT) AS zero_local_but_national FROM z JOIN n USING (yyyymm)")
def local_national(spark, d):
    return out(A.local_against_national(zones(spark, d), ["yyyymm"]))


@query("q_qa_bits", f"WITH {PIX} SELECT region, yyyymm, round(avg(0.02::DOUBLE * dn - 273.15::DOUBLE), 5) AS celsius, count(*) AS n FROM px WHERE qc & 3 = 0 GROUP BY ALL")
def qa_bits(spark, d):
    return out(A.monthly_composite(pixels(spark, d), ["region", "yyyymm"]), 5)


@query("q_drift_flag", f"WITH {MON} SELECT unit_id, yyyymm, CAST(abs(area - quantity * 0.3) > 20 AND abs(area - quantity * 0.3) > 0.1 * abs(quantity * 0.3) AS BIGINT) AS drift, CASE WHEN area <> 0 THEN round(quantity / area, 6) END AS fraction FROM m")
def drift(spark, d):
    m = monthly(spark, d)
    return out(m.select("unit_id", "yyyymm", S.drift_flag("area", F.col("quantity") * 0.3, 20, 0.1).alias("drift"), S.safe_fraction("quantity", "area").alias("fraction")))


@query("q_slugs", "WITH t AS (SELECT p_partkey, p_name, regexp_extract_all(p_name || ' of ' || p_brand, '[A-Za-z0-9]+') AS w FROM part) SELECT p_partkey, array_to_string(list_transform(w, lambda x: lower(x)), '_') AS snake, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), '_') AS title, upper(array_to_string(list_transform(w[1:2], lambda x: x[1]), '')) AS code FROM t")
def slugs(spark, d):
    label = F.concat_ws(" of ", "p_name", "p_brand")
    return table(spark, d, "part").select("p_partkey", S.snake_slug(label).alias("snake"), S.title_slug(label).alias("title"), S.initials(label).alias("code"))


@query("q_text_key", "SELECT p_partkey, upper(regexp_replace(p_name || '-' || p_brand, '[^A-Za-z0-9]', '', 'g')) AS key, trim(regexp_replace('  ' || p_name || '   x ', '\\s+', ' ', 'g')) AS text FROM part")
def text_key(spark, d):
    return table(spark, d, "part").select("p_partkey", I.text_key(F.concat_ws("-", "p_name", "p_brand")).alias("key"), S.normal_text(F.concat(F.lit("  "), F.col("p_name"), F.lit("   x ")), ascii_only=True).alias("text"))


@query("q_bind_identity", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS unit_id, CASE c_custkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'code' WHEN 2 THEN 'name' ELSE 'unresolved' END AS match_source FROM customer")
def bind(spark, d):
    k = F.col("c_custkey") % 4
    nk = F.col("c_nationkey").cast("string")
    raw = table(spark, d, "customer").select("c_custkey", F.when(k == 0, nk).otherwise("none").alias("raw_id"), F.when(k == 1, F.concat(F.lit("c-"), nk)).alias("raw_code"), F.when(k == 2, F.concat(F.lit("nation "), nk)).otherwise("").alias("raw_name"))
    u = units(spark, d).select(F.col("unit_id").cast("string").alias("unit_id"), F.concat(F.lit("C"), F.col("unit_id").cast("string")).alias("unit_code"), "unit_name")
    return I.bind_identity(raw, u).select("c_custkey", "unit_id", "match_source")


@query("q_hierarchy_root", "SELECT 'n' || n_nationkey AS unit, 'r' || n_regionkey AS root_id, CAST(1 AS BIGINT) AS depth FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region")
def roots(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("unit"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("unit"), F.lit(None).cast("string").alias("parent"))
    return out(I.hierarchy_roots(n.union(r), "unit", "parent"))


@query("q_threshold_status", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'fail' WHEN s_acctbal > 9000 THEN 'fail' WHEN s_acctbal < 1000 THEN 'warn' WHEN s_acctbal > 8000 THEN 'warn' ELSE 'pass' END AS status FROM supplier")
def threshold(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.threshold_status("s_acctbal", 1000, 0, 8000, 9000).alias("status"))


@query("q_rules", f"WITH {MON} SELECT unnest(['area_not_negative', 'area_below_quantity', 'month_in_window']) AS rule, unnest([count(*) FILTER (area < 0), count(*) FILTER (area > 0.6 * quantity), count(*) FILTER (yyyymm NOT BETWEEN 199501 AND 200012)]) AS violations FROM m")
def rules(spark, d):
    return Q.check_rules(monthly(spark, d), {"area_not_negative": F.col("area") >= 0, "area_below_quantity": F.col("area") <= 0.6 * F.col("quantity"), "month_in_window": F.col("yyyymm").between(199501, 200012)})


@query("q_final_panel_rules", BASE + "SELECT CAST(0 AS BIGINT) AS violated_other, CAST(bool_or(NOT here)::INT + bool_or(NOT here AND sup)::INT AS BIGINT) AS rules_violated FROM b")
def final_rules(spark, d):
    bad = Q.check_rules(panel(spark, d), Q.final_panel_rules(199801)).where("violations > 0")
    return out(bad.agg(F.count_if(~F.col("rule").isin("modis_present", "viirs_present")).alias("violated_other"), F.count(F.lit(1)).alias("rules_violated")))


@query("q_qa_summary", "WITH s AS (SELECT CASE WHEN s_acctbal < 0 THEN 'fail' WHEN s_acctbal < 1000 THEN 'warn' ELSE 'pass' END AS status FROM supplier) SELECT 'balance' AS metric, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'fail') AS n_fail, CAST(0 AS BIGINT) AS n_na, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS worst FROM s")
def qa_summary(spark, d):
    return Q.qa_summary(table(spark, d, "supplier"), {"balance": S.threshold_status("s_acctbal", warn_below=1000, fail_below=0)})


@query("q_share_summary", f"WITH {MON}, s AS (SELECT area / quantity AS s FROM m) SELECT count(*) AS n, round(min(s), 6) AS least, round(avg(s), 6) AS mean, round(max(s), 6) AS most, count(*) FILTER (s >= 0.2 AND s < 0.3) AS warn, count(*) FILTER (s < 0.2) AS fail FROM s")
def share_summary(spark, d):
    return out(Q.share_summary(monthly(spark, d).withColumn("s", F.col("area") / F.col("quantity")), "s", 0.3, 0.2))


@query("q_row_hashes", "SELECT c_custkey, sha256('v' || c_custkey || chr(31) || 'v' || c_name || chr(31) || 'v' || c_mktsegment) AS row_sha256 FROM customer")
def hashes(spark, d):
    from ..sources.tables import row_hashes

    return row_hashes(table(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"]).select("c_custkey", "row_sha256")


@query("q_nfkc")
def nfkc(spark, d):
    return table(spark, d, "part").select("p_partkey", S.normal_text(F.concat(F.lit("ﬁ ①  "), F.col("p_name"))).alias("text"))


@query("q_stream_daily", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(user_id % 25 AS BIGINT) AS unit_id, count(*) FILTER (event_type = 'error') AS det_low, count(*) FILTER (event_type IN ('view', 'click')) AS det_nominal, count(*) FILTER (event_type IN ('purchase', 'signup')) AS det_high, max(value) AS daily_max FROM events GROUP BY ALL")
def stream(spark, d):
    """The streaming aggregation, run on the table as a bounded source."""
    from ..streaming.windows import daily_metrics

    return out(daily_metrics(spark.read.parquet(f"{d}/events.parquet")))
