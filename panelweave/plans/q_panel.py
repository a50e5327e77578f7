"""Consolidation: eight source families on a spine, 111 columns, and its audits."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import consolidate as C
from ..operators import panel as P
from ..operators.adapters import monthly, table, units
from ..operators.masks import exclusion_histogram, population_mask
from .q_rates import MON
from .registry import out, query


def families(spark, d):
    """Four families out of the monthly table, each over its own window."""
    m = monthly(spark, d).withColumn("level", F.lit("nation")).withColumn("unit_id", F.col("unit_id").cast("string"))
    low, high = F.floor(F.col("n") / 3), F.floor(F.col("n") / 4)

    def af(s):
        return m.select(
            *C.KEY, low.alias(f"{s}_det_low"), (F.col("n") - low - high).alias(f"{s}_det_nominal"), high.alias(f"{s}_det_high"), F.col("n").alias(f"{s}_det_all"), (F.col("n") - low).alias(f"{s}_det_nh"),
            F.round(100.0 * high / F.col("n"), 3).alias(f"{s}_pct_high_conf"), F.least(F.col("n"), F.lit(28)).alias(f"{s}_days_active_nh"), F.lit(1).cast("long").alias(f"{s}_streak_max_nh"), F.least(F.col("n"), F.lit(28)).alias(f"{s}_frp_active_days"),
            F.col("quantity").alias(f"{s}_frp_sum_daily_max_mw"), (F.col("quantity") / F.least(F.col("n"), F.lit(28))).alias(f"{s}_frp_mean_mw"), F.lit(50.0).alias(f"{s}_frp_p95_daily_max_mw"),
        )

    frac = S.safe_divide("area", "support")
    ba = m.select(
        *C.KEY, F.col("area").alias("modis_ba_km2"), F.col("n").alias("modis_burned_pixel_count"), (F.col("area") > 0).cast("long").alias("modis_ba_any"), (F.col("support") * 2).alias("modis_aoi_area_land_km2"), F.col("support").alias("modis_burnable_km2_union"),
        (F.col("support") * 0.9).alias("modis_burnable_km2_annual"), frac.alias("modis_burned_frac_union"), (frac / 0.9).alias("modis_burned_frac_annual"), F.lit(0).cast("long").alias("modis_zero_union_den_flag"), F.lit(0).cast("long").alias("modis_zero_annual_den_flag"),
    )
    return {"modis": af("modis"), "viirs": af("viirs").where("yyyymm >= 199801"), "ba2001": ba, "ba2012": ba.where("yyyymm >= 199801 and unit_id <> '3'")}


def spine(spark, d):
    u = units(spark, d).select(F.lit("nation").alias("level"), F.col("unit_id").cast("string").alias("unit_id"), F.lit(None).cast("string").alias("unit_code"), "unit_name", F.lit("region").alias("parent_level"), F.col("parent_id").cast("string").alias("parent_id"), F.lit(None).cast("string").alias("parent_code"), "parent_name")
    return P.spine(u, 199501, 200012).withColumns({"year": F.floor(F.col("yyyymm") / 100).cast("int"), "month": (F.col("yyyymm") % 100).cast("int")})


def panel(spark, d):
    return C.derive_panel(C.level_panel(spine(spark, d), families(spark, d), audit=False), "merge-1", support_start=199801)


SPN = "sp AS (SELECT CAST(n_nationkey AS BIGINT) AS unit_id, CAST(y * 100 + mo AS BIGINT) AS yyyymm FROM nation, range(1995, 2001) t(y), range(1, 13) u(mo))"
BASE = f"""WITH {MON}, {SPN},
b AS (SELECT sp.unit_id, sp.yyyymm, sp.yyyymm >= 199801 AS sup, area, quantity, n, support, n - n // 3 AS nh, m.unit_id IS NOT NULL AS here, m.unit_id IS NOT NULL AND sp.yyyymm >= 199801 AND sp.unit_id <> 3 AS here12 FROM sp LEFT JOIN m ON sp.unit_id = m.unit_id AND sp.yyyymm = m.yyyymm)
"""


@query("q_safe_rates", BASE + "SELECT unit_id, yyyymm, round(100 * area / support, 6) AS per100, round(nh / n, 6) AS nh_share, CASE WHEN area > 0 THEN round(quantity / area, 6) END AS per_area FROM b")
def safe_rates(spark, d):
    m = monthly(spark, d).withColumn("nh", F.col("n") - F.floor(F.col("n") / 3))
    j = P.onto_spine(spine(spark, d).select(F.col("unit_id").cast("int").alias("unit_id"), "yyyymm"), m, ["unit_id", "yyyymm"])
    return out(j.select("unit_id", "yyyymm", S.safe_divide("area", "support", 100.0).alias("per100"), S.safe_divide("nh", "n").alias("nh_share"), S.safe_divide("quantity", "area").alias("per_area")))


FLAGS = "SELECT CAST(unit_id AS VARCHAR) AS unit_id, yyyymm, CAST(sup AS BIGINT) AS viirs_supported_flag, CASE WHEN here THEN CAST(nh > 0 AS BIGINT) END AS modis_det_primary_any, CASE WHEN sup AND here THEN CAST(nh > 0 AS BIGINT) END AS viirs_det_primary_any, CASE WHEN here AND sup THEN CAST(area > 0 AND nh > 0 AS BIGINT) END AS ba_any_ba2001_and_viirs_primary_any_flag, CASE WHEN here12 THEN CAST(area > 0 AND nh > 0 AS BIGINT) END AS ba_any_ba2012_and_modis_primary_any_flag, CASE WHEN here12 THEN CAST(nh > 0 AND area = 0 AS BIGINT) END AS viirs_primary_without_ba_any_ba2012_flag FROM b"


@query("q_concordance_flags", BASE + FLAGS)
def concordance(spark, d):
    return out(panel(spark, d).select("unit_id", "yyyymm", "viirs_supported_flag", "modis_det_primary_any", "viirs_det_primary_any", "ba_any_ba2001_and_viirs_primary_any_flag", "ba_any_ba2012_and_modis_primary_any_flag", "viirs_primary_without_ba_any_ba2012_flag"))


@query("q_merge_notes", BASE + "SELECT CAST(unit_id AS VARCHAR) AS unit_id, yyyymm, concat_ws(';', CASE WHEN NOT here THEN 'missing_modis_af_source' END, CASE WHEN sup AND NOT here THEN 'missing_viirs_af_source_in_supported_window' END, CASE WHEN NOT here THEN 'missing_ba2001_source' END, CASE WHEN sup AND NOT here12 THEN 'missing_ba2012_source_in_supported_window' END) AS merge_note, CAST(here12 AS BIGINT) AS ba2012_source_present FROM b")
def notes(spark, d):
    return out(panel(spark, d).select("unit_id", "yyyymm", "merge_note", "ba2012_source_present"))


@query("q_final_panel", BASE + "SELECT count(*) AS rows, CAST(111 AS BIGINT) AS columns, CAST(sum(nh) AS BIGINT) AS modis_primary, CAST(sum(nh) FILTER (sup) AS BIGINT) AS viirs_primary, round(sum(100 * area / support), 4) AS rate_2001, round(sum(100 * area / support) FILTER (here12), 4) AS rate_2012, round(sum(quantity / support) FILTER (here12), 4) AS frp_2012, round(sum(quantity / least(n, 28)), 4) AS per_day, count(*) FILTER (here12) AS with_2012 FROM b")
def final_panel(spark, d):
    p = panel(spark, d)
    return out(p.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(p.columns)).alias("columns"), F.sum("modis_det_primary").alias("modis_primary"), F.sum("viirs_det_primary").alias("viirs_primary"), F.sum("modis_ba_km2_per100km2_union_ba2001").alias("rate_2001"), F.sum("modis_ba_km2_per100km2_union_ba2012").alias("rate_2012"),
        F.sum("viirs_frp_sum_daily_max_mw_per_km2_burnable_union_ba2012").alias("frp_2012"), F.sum("modis_frp_sum_daily_max_mw_per_active_day").alias("per_day"), F.count("modis_ba_km2_ba2012").alias("with_2012"),
    ), 4)


@query("q_panel_audit", BASE + "SELECT count(*) AS actual_rows, count(DISTINCT (unit_id, yyyymm)) AS unique_keys, CAST(0 AS BIGINT) AS duplicate_key_rows, min(yyyymm) AS yyyymm_min, max(yyyymm) AS yyyymm_max, CAST(111 AS BIGINT) AS column_count, count(*) = 1800 AS passes FROM b")
def panel_audit(spark, d):
    return out(P.key_audit(panel(spark, d), list(C.KEY), 1800))


@query("q_coverage_diff", f"WITH {MON}, {SPN} SELECT coalesce(sp.unit_id, m.unit_id) AS unit_id, coalesce(sp.yyyymm, m.yyyymm) AS yyyymm, CASE WHEN m.unit_id IS NULL THEN 'missing' ELSE 'extra' END AS side FROM sp FULL JOIN m ON sp.unit_id = m.unit_id AND sp.yyyymm = m.yyyymm WHERE sp.unit_id IS NULL OR m.unit_id IS NULL")
def coverage_diff(spark, d):
    return out(C.presence_diff(spine(spark, d).select(F.col("unit_id").cast("int").alias("unit_id"), "yyyymm"), monthly(spark, d), ["unit_id", "yyyymm"]))


@query("q_reconcile_parent", f"WITH {MON}, c AS (SELECT parent_id, yyyymm, sum(area) AS area, sum(quantity) AS quantity FROM p GROUP BY ALL), l AS (SELECT 'area' AS field, area AS a, CASE WHEN yyyymm % 100 = 7 THEN area + 1 ELSE area END AS b FROM c UNION ALL SELECT 'quantity', quantity, quantity FROM c) SELECT field, count(*) AS compared, count(*) FILTER (abs(a - b) > 1e-8 + 1e-10 * abs(b)) AS mismatched, CAST(0 AS BIGINT) AS null_state, max(abs(a - b)) AS max_abs, round(max(CASE WHEN b <> 0 THEN abs(a - b) / abs(b) END), 6) AS max_rel FROM l GROUP BY field")
def reconcile(spark, d):
    kids = monthly(spark, d).join(units(spark, d).select("unit_id", "parent_id"), "unit_id")
    parents = kids.groupBy("parent_id", "yyyymm").agg(F.sum("area").alias("area"), F.sum("quantity").alias("quantity")).withColumn("area", F.when(F.col("yyyymm") % 100 == 7, F.col("area") + 1).otherwise(F.col("area")))
    return out(C.reconcile(kids, parents, ["parent_id", "yyyymm"], ["area", "quantity"]))


MASK = f"WITH {MON}, k AS (SELECT CAST(n_nationkey AS BIGINT) AS unit_id, count(m.yyyymm) AS months, count(*) FILTER (n >= 3) AS ok, min(m.support) AS support FROM nation LEFT JOIN m ON unit_id = n_nationkey AND yyyymm BETWEEN 199501 AND 200012 AND unit_id <> 7 GROUP BY n_nationkey), e AS (SELECT unit_id, concat_ws(';', CASE WHEN months <> 72 THEN 'months_incomplete' END, CASE WHEN months > 0 AND ok <> months THEN 'unsupported_month' END, CASE WHEN support IS NULL OR support <= 0 THEN 'denominator_not_positive' END) AS exclusion_reasons FROM k)"


def mask(spark, d):
    panel = monthly(spark, d).where("unit_id <> 7").withColumn("ok", F.col("n") >= 3)
    return population_mask(units(spark, d).select("unit_id"), panel, "unit_id", 199501, 200012, ["ok"], "support")


@query("q_population_mask", MASK + " SELECT unit_id, exclusion_reasons = '' AS eligible, exclusion_reasons FROM e")
def pop_mask(spark, d):
    return out(mask(spark, d))


@query("q_exclusion_hist", MASK + ", x AS (SELECT unnest(string_split(exclusion_reasons, ';')) AS reason FROM e WHERE exclusion_reasons <> '') SELECT reason, count(*) AS n FROM x GROUP BY reason")
def excl(spark, d):
    return out(exclusion_histogram(mask(spark, d)))


@query("q_semi", MASK + " SELECT unit_id, count(*) AS n FROM m WHERE unit_id IN (SELECT unit_id FROM e WHERE exclusion_reasons = '') GROUP BY unit_id")
def semi(spark, d):
    return out(C.members(monthly(spark, d), mask(spark, d).where("eligible"), ["unit_id"]).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")))


@query("q_anti", MASK + " SELECT unit_id, count(*) AS n FROM m WHERE unit_id NOT IN (SELECT unit_id FROM e WHERE exclusion_reasons = '') GROUP BY unit_id")
def anti(spark, d):
    return out(C.non_members(monthly(spark, d), mask(spark, d).where("eligible"), ["unit_id"]).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")))


@query("q_identity_nullsafe", "WITH x AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS eseg FROM customer) SELECT c_custkey, seg, eseg AS expected_seg FROM x WHERE seg IS DISTINCT FROM eseg")
def identity(spark, d):
    c = table(spark, d, "customer")
    have = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("seg"))
    want = c.select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("seg"))
    return C.identity_mismatches(have, want, ["c_custkey"], ["seg"])


@query("q_dimension_join", f"WITH {MON} SELECT r_name AS parent_name, count(*) AS n, round(sum(area), 6) AS area FROM p JOIN region ON parent_id = r_regionkey GROUP BY r_name")
def dim(spark, d):
    u = units(spark, d).select("unit_id", "parent_name")
    return out(C.dimension_join(monthly(spark, d), u, ["unit_id"]).groupBy("parent_name").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area")))


@query("q_orphans", "SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3)")
def orphans(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 10 <> 3")
    return C.orphans(table(spark, d, "lineitem"), s, "l_suppkey", "s_suppkey").select(F.col("l_suppkey").alias("s"))
