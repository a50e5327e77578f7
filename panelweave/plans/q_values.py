"""Value functions, rule sets, identity and round trips through files."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import exports as X
from ..operators import identity as I
from ..operators import masks as M
from ..operators import panel as P
from ..operators import pgee as G
from ..operators import publish as K
from ..operators import quality as Q
from ..operators import scan_io as C
from ..operators.adapters import detections, monthly, table, units
from ..sources import tables as T
from ..sources.workspace import workspace
from .q_correspondence import PAIR, flags
from .q_detections import DET
from .q_extras import ZONAL, zones
from .q_rates import MON
from .registry import out, query


@query("q_rounded_text", "SELECT p_partkey, printf('%.2f', round_even(p_retailprice / 3, 2)) AS text FROM part")
def rounded_text(spark, d):
    return table(spark, d, "part").select("p_partkey", S.rounded_text(F.col("p_retailprice") / 3, 2).alias("text"))


@query("q_log2", "SELECT o_orderkey, round(log2(o_totalprice), 6) AS value FROM orders")
def log2(spark, d):
    return out(table(spark, d, "orders").select("o_orderkey", S.log2_checked(F.col("o_totalprice").cast("double")).alias("value")))


@query("q_odds_ratio", "WITH b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 900.0::DOUBLE WHEN s_suppkey % 7 = 0 THEN -900.0::DOUBLE ELSE s_acctbal / 10000.0::DOUBLE END AS b, (s_suppkey % 7 + 1) / 10.0::DOUBLE AS s FROM supplier) SELECT s_suppkey, CASE WHEN abs(b) < 700 THEN round(exp(b), 6) END AS odds_ratio, CASE WHEN abs(b) < 700 THEN round(exp(b - 1.959963984540054 * s), 6) END AS low, CASE WHEN abs(b) < 700 THEN round(exp(b + 1.959963984540054 * s), 6) END AS high FROM b")
def odds_ratio(spark, d):
    k = F.col("s_suppkey")
    b = F.when(k % 5 == 0, F.lit(900.0)).when(k % 7 == 0, F.lit(-900.0)).otherwise(F.col("s_acctbal").cast("double") / 10000.0)
    ratio, low, high = S.odds_ratio("b", (F.col("s_suppkey") % 7 + 1) / F.lit(10.0))
    return out(table(spark, d, "supplier").withColumn("b", b).select("s_suppkey", ratio.alias("odds_ratio"), low.alias("low"), high.alias("high")))


@query("q_clamp_share", "WITH x AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN -1e-13::DOUBLE WHEN 1 THEN 1 + 1e-13::DOUBLE WHEN 2 THEN 1.5::DOUBLE WHEN 3 THEN -0.25::DOUBLE ELSE 0.25::DOUBLE END AS x FROM supplier) SELECT s_suppkey, CASE WHEN x < 0 AND x >= -1e-12 THEN 0 WHEN x > 1 AND x <= 1 + 1e-12 THEN 1 ELSE x END AS share, x < -1e-12 OR x > 1 + 1e-12 AS outside FROM x")
def clamp_share(spark, d):
    k = F.col("s_suppkey") % 5
    x = F.when(k == 0, F.lit(-1e-13)).when(k == 1, F.lit(1 + 1e-13)).when(k == 2, F.lit(1.5)).when(k == 3, F.lit(-0.25)).otherwise(F.lit(0.25))
    got = table(spark, d, "supplier").select("s_suppkey", S.clamp_share(x).alias("share"))
    return got.withColumn("outside", ~F.col("share").between(0, 1))


@query("q_study_bounds", f"WITH {DET} SELECT yyyymm, CAST(make_date(yyyymm // 100, yyyymm % 100, 1) AS VARCHAR) AS first, CAST(last_day(make_date(yyyymm // 100, yyyymm % 100, 1)) AS VARCHAR) AS last FROM (SELECT DISTINCT yyyymm FROM det)")
def study_bounds(spark, d):
    first, last = S.study_bounds("yyyymm", "yyyymm")
    return out(detections(spark, d).select("yyyymm").distinct().select("yyyymm", first.alias("first"), last.alias("last")))


@query("q_sensor_columns", f"WITH {DET} SELECT unit_id, count(*) AS viirs_det, CAST(NULL AS DOUBLE) AS viirs_frp FROM det WHERE sensor = 'viirs' GROUP BY unit_id")
def sensor_columns(spark, d):
    counts = detections(spark, d).where("sensor = 'viirs'").groupBy("unit_id").agg(F.count(F.lit(1)).alias("modis_det"))
    return out(P.sensor_columns(P.swap_prefix(counts, "modis", "viirs"), "viirs", ["det", "frp"]))


@query("q_role", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def role(spark, d):
    contract = {"sales": {"amount": "l_extendedprice", "by": "l_returnflag"}}
    by, amount = (I.resolve_role(contract, f"sales.{k}") for k in ("by", "amount"))
    return out(table(spark, d, "lineitem").groupBy(by).agg(F.sum(amount).alias("total")), 2)


@query("q_exclusion_reasons", "SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 3 = 0 THEN 'unresolved_identity' END, CASE WHEN o_orderkey % 5 = 0 THEN 'unresolved_parent' END, CASE WHEN o_totalprice <= 100000 THEN 'zero_land_intersection' END) AS reasons FROM orders")
def exclusion_reasons(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k % 3 != 0, k).alias("unit_id"), F.when(k % 5 != 0, k).alias("parent_id"), (F.col("o_totalprice") - 100000).cast("double").alias("land_area"))
    return rows.select("o_orderkey", I.exclusion_reasons().alias("reasons"))


@query("q_carry_legacy", "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey % 7 END AS old, c_nationkey % 5 AS now FROM customer) SELECT c_custkey, CAST(old AS BIGINT) AS legacy_zone, CAST(now AS BIGINT) AS zone_now, old IS NOT NULL AS legacy_present, CASE WHEN old IS NOT NULL THEN old = now END AS legacy_match, CASE WHEN old IS NOT NULL THEN old <> now END AS legacy_disagrees FROM c")
def carry_legacy(spark, d):
    n = F.col("c_nationkey")
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, n % 7).alias("zone"), (n % 5).alias("zone_now"))
    return out(I.carry_legacy(rows, {"zone": "legacy_zone"}, "zone_now"))


@query("q_finite_violations", "SELECT count(*) FILTER (l_quantity IS NULL) AS quantity, count(*) FILTER (l_discount - 0.05 < -1e-9) AS discount, count(*) FILTER (l_linenumber = 3) AS ratio FROM lineitem")
def finite_violations(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), (F.col("l_discount") - 0.05 + 1e-9).alias("discount"), F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("ratio"))
    return M.finite_violations(rows, ["quantity", "discount", "ratio"])


SCENARIOS = [{"id": "a", "model": "poisson", "exposure": "quantity", "start": 199601, "end": 199612}, {"id": "b", "model": "permutation", "start": 199701, "end": 199812}]


@query("q_scenarios", f"WITH {MON}, sc AS (SELECT * FROM (VALUES ('a', 'poisson', 'quantity', 199601, 199612), ('b', 'permutation', NULL, 199701, 199812)) t(id, model, exposure, first, last)) SELECT id, model, exposure, count(*) AS rows, round(sum(area), 6) AS cases FROM sc JOIN m ON yyyymm BETWEEN first AND last GROUP BY ALL")
def scenarios(spark, d):
    rows = [(s["id"], s["model"], s.get("exposure"), s["start"], s["end"]) for s in C.scenarios(SCENARIOS)]
    months = spark.createDataFrame(rows, "id string, model string, exposure string, first int, last int").withColumn("o", F.explode(F.sequence(S.month_ordinal("first"), S.month_ordinal("last")))).withColumn("yyyymm", S.ordinal_month("o"))
    return out(months.join(monthly(spark, d), "yyyymm").groupBy("id", "model", "exposure").agg(F.count(F.lit(1)).alias("rows"), F.sum("area").alias("cases")))


@query("q_population", PAIR + " SELECT unit_id, yyyymm, CAST(1 - b AS DOUBLE) AS y FROM f WHERE area > 0")
def population(spark, d):
    return out(G.population(flags(spark, d), "area", "b").select("unit_id", "yyyymm", "y"))


@query("q_active_fire_rules", f"WITH {DET}, c AS (SELECT unit_id, yyyymm, count(*) AS n, count(*) FILTER (conf = 'h') AS h FROM det GROUP BY ALL) SELECT unnest(['det_low_not_negative', 'det_nominal_not_negative', 'det_high_not_negative', 'det_all_not_negative', 'det_nh_not_negative', 'pct_in_range', 'all_is_sum', 'nh_is_sum']) AS rule, unnest([0, 0, 0, 0, count(*) FILTER (unit_id % 11 = 0), count(*) FILTER (unit_id % 7 = 0), count(*) FILTER (unit_id % 5 = 0), count(*) FILTER (unit_id % 11 = 0)]) AS violations FROM c")
def active_fire_rules(spark, d):
    u = F.col("unit_id")
    count = lambda *c: F.count_if(F.col("conf").isin(*c))
    c = detections(spark, d).groupBy("unit_id", "yyyymm").agg(count("l").alias("modis_det_low"), count("n").alias("modis_det_nominal"), count("h").alias("modis_det_high"), count("n", "h").alias("modis_det_nh"), F.count(F.lit(1)).alias("modis_det_all"))
    c = c.withColumns({"modis_pct_high_conf": F.when(u % 7 == 0, 101.0).otherwise(50.0), "modis_det_all": F.col("modis_det_all") + (u % 5 == 0).cast("int"), "modis_det_nh": F.when(u % 11 == 0, -1).otherwise(F.col("modis_det_nh"))})
    return Q.check_rules(c, Q.active_fire_rules("modis"))


@query("q_burned_area_rules", ZONAL + " SELECT unnest(['ba_any_binary', 'zero_union_den_flag_binary', 'zero_annual_den_flag_binary', 'frac_union', 'frac_annual', 'any_iff_area']) AS rule, unnest([0, 0, count(*) FILTER (region % 9 = 0), count(*) FILTER (region % 4 > 0 AND area_km2 > region % 4 * 2), 0, count(*) FILTER (region % 6 = 0 AND area_km2 > 0)]) AS violations FROM z")
def burned_area_rules(spark, d):
    r, a = F.col("region"), F.col("area_km2")
    z = zones(spark, d).select(
        (F.when(r % 6 == 0, F.lit(False)).otherwise(a > 0)).cast("int").alias("modis_ba_any"), a.alias("modis_ba_km2"), (r % 4 == 0).cast("int").alias("modis_zero_union_den_flag"), F.when(r % 9 == 0, 2).otherwise(0).alias("modis_zero_annual_den_flag"),
        (r % 4 * 2).cast("double").alias("modis_burnable_km2_union"), F.lit(1.0).alias("modis_burnable_km2_annual"), F.when(r % 4 > 0, a / (r % 4 * 2)).alias("modis_burned_frac_union"), F.lit(0.5).alias("modis_burned_frac_annual"),
    )
    return Q.check_rules(z, Q.burned_area_rules())


@query("q_time_rules", f"WITH {MON} SELECT unnest(['month', 'year_month_agree', 'in_window']) AS rule, unnest([count(*) FILTER (unit_id = 3 AND yyyymm % 100 = 12), count(*) FILTER (unit_id = 3), count(*) FILTER (yyyymm NOT BETWEEN 199301 AND 199712)]) AS violations FROM m")
def time_rules(spark, d):
    m = monthly(spark, d).withColumns({"year": F.floor(F.col("yyyymm") / 100), "month": F.col("yyyymm") % 100 + (F.col("unit_id") == 3).cast("int")})
    return Q.check_rules(m, Q.time_rules(199301, 199712))


@query("q_figure_rules", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'odd' WHEN s_suppkey % 4 = 1 THEN 'excluded' ELSE 'valid_nonzero' END AS support_status FROM supplier WHERE s_suppkey % 4 = 0 OR (s_suppkey % 4 = 1 AND s_acctbal > 0)")
def figure_rules(spark, d):
    k = F.col("s_suppkey") % 4
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(k == 0, "odd").when(k == 1, "excluded").otherwise("valid_nonzero").alias("support_status"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("value"))
    return K.figure_violations(rows, ["excluded", "valid_zero", "valid_nonzero"]).select("s_suppkey", "support_status")


@query("q_constant_rules", "SELECT CAST(n_regionkey AS BIGINT) AS parent, count(DISTINCT n_regionkey % 2) AS same, count(DISTINCT n_name) AS other FROM nation GROUP BY 1 HAVING count(DISTINCT n_regionkey % 2) > 1 OR count(DISTINCT n_name) > 1")
def constant_rules(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("parent"), (F.col("n_regionkey") % 2).alias("same"), F.col("n_name").alias("other"))
    return out(Q.constant_rules(n, ["parent"], ["same", "other"]))


@query("q_month_series_rules", f"WITH {MON} SELECT unit_id * 10000 + yyyymm // 100 AS unit_year, count(DISTINCT yyyymm % 100) AS months, count(*) AS rows FROM m GROUP BY ALL HAVING count(*) <> 12")
def month_series_rules(spark, d):
    m = monthly(spark, d).select((F.col("unit_id") * 10000 + F.floor(F.col("yyyymm") / 100)).alias("unit_year"), (F.col("yyyymm") % 100).alias("month"))
    return out(Q.month_series_rules(m, "unit_year"))


@query("q_share_sum_rules", "WITH s AS (SELECT CAST(n_regionkey AS BIGINT) AS parent, CASE WHEN n_regionkey % 2 = 0 THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY n_regionkey) ELSE 0.1::DOUBLE END AS share FROM nation) SELECT parent, round(sum(share), 6) AS total FROM s GROUP BY parent HAVING abs(sum(share) - 1) > 1e-9")
def share_sum_rules(spark, d):
    n = table(spark, d, "nation")
    sizes = n.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("k"))
    rows = n.join(sizes, "n_regionkey").select(F.col("n_regionkey").alias("parent"), F.when(F.col("n_regionkey") % 2 == 0, F.lit(1.0) / F.col("k")).otherwise(F.lit(0.1)).alias("share"))
    return out(Q.share_sum_rules(rows, ["parent"], "share"))


@query("q_relative_area", "WITH x AS (SELECT abs(p_retailprice - p_size * 30) / (p_size * 30) AS d FROM part) SELECT count(d) AS n, round(max(d), 6) AS most, round(avg(d), 6) AS mean, count(*) FILTER (d > 0.5 AND d <= 5) AS warn, count(*) FILTER (d > 5) AS fail FROM x")
def relative_area(spark, d):
    rows = table(spark, d, "part").select(F.col("p_retailprice").cast("double").alias("a"), (F.col("p_size") * 30).cast("double").alias("b"))
    return out(Q.relative_area_summary(rows, "a", "b", 0.5, 5))


@query("q_issues", "SELECT s_suppkey, metric, status FROM (SELECT s_suppkey, 'balance' AS metric, CASE WHEN s_acctbal < 0 THEN 'fail' WHEN s_acctbal < 1000 THEN 'warn' END AS status FROM supplier UNION ALL SELECT s_suppkey, 'nation', CASE WHEN s_nationkey > 23 THEN 'fail' WHEN s_nationkey > 20 THEN 'warn' END FROM supplier) WHERE status IS NOT NULL")
def issues(spark, d):
    return Q.issues(table(spark, d, "supplier"), "s_suppkey", {"balance": S.threshold_status("s_acctbal", warn_below=1000, fail_below=0), "nation": S.threshold_status("s_nationkey", warn_above=20, fail_above=23)})


@query("q_contract_rules", "SELECT unnest(['p_size:required', 'p_size:high', 'p_size:whole', 'p_brand:domain', 'half:whole']) AS rule, unnest([0, count(*) FILTER (p_size > 40), 0, count(*) FILTER (p_brand NOT IN ('Brand#11', 'Brand#12')), count(*) FILTER (p_size % 2 = 1)]) AS violations FROM part")
def contract_rules(spark, d):
    fields = [{"name": "p_size", "dtype": "integer", "nullable": False, "high": 40}, {"name": "p_brand", "dtype": "string", "domain": ["Brand#11", "Brand#12"]}, {"name": "half", "dtype": "integer"}]
    return Q.check_rules(table(spark, d, "part").withColumn("half", F.col("p_size") / 2), Q.contract_rules(fields))


@query("q_unit_universe", "SELECT CAST(r_regionkey AS BIGINT) AS unit_id, r_name AS unit_name, CAST(NULL AS BIGINT) AS parent_id FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def unit_universe(spark, d):
    coarse = table(spark, d, "region").select(F.col("r_regionkey").alias("unit_id"), F.col("r_name").alias("unit_name"))
    return out(I.unit_universe(coarse, units(spark, d).select("unit_id", "unit_name", "parent_id")).select("unit_id", "unit_name", "parent_id"))


@query("q_universe_rows", "SELECT CAST(r_regionkey AS BIGINT) AS unit_id, printf('%.6f', 1000.5::DOUBLE + r_regionkey) AS area_sqkm, CAST(NULL AS BIGINT) AS parent_id FROM region UNION ALL SELECT n_nationkey, printf('%.6f', n_nationkey / 7.0::DOUBLE), n_regionkey FROM nation")
def universe_rows(spark, d):
    coarse = table(spark, d, "region").select(F.col("r_regionkey").alias("unit_id"), (F.col("r_regionkey") + 1000.5).alias("area_sqkm"))
    fine = units(spark, d).select("unit_id", (F.col("unit_id") / F.lit(7.0)).alias("area_sqkm"), "parent_id")
    return out(X.universe_rows(coarse, fine))


@query("q_crosswalk_rows", "SELECT CAST(n_nationkey AS BIGINT) AS unit_id, CAST(n_regionkey AS BIGINT) AS zone_id, r_name AS zone_name, round(1 - n_nationkey / 100.0::DOUBLE, 6) AS share FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 0")
def crosswalk_rows(spark, d):
    k = F.col("unit_id")
    assigned = units(spark, d).select("unit_id", F.when(k % 6 != 0, F.col("parent_id")).alias("zone_id"), (1 - k / F.lit(100.0)).alias("share"))
    zones_ = table(spark, d, "region").select(F.col("r_regionkey").alias("zone_id"), F.col("r_name").alias("zone_name"))
    return out(X.crosswalk_rows(assigned, zones_, "unit_id", "zone_id"))


@query("q_geo_qa", "SELECT count(*) AS points, count(*) FILTER (user_id % 25 <> 4) AS matched, count(*) FILTER (value < 50) AS outside, round(count(*) FILTER (user_id % 25 <> 4) / count(*), 6) AS matched_rate, count(*) FILTER (user_id % 25 = 4) AS unmatched_rows, count(*) FILTER (value < 50) AS outside_rows FROM events")
def geo_qa(spark, d):
    joined = detections(spark, d).select(F.when(F.col("unit_id") != 4, F.col("unit_id")).alias("unit"), (F.col("frp") >= 50).alias("in_mask"))
    q = X.qa_tables(joined, "unit", "in_mask")
    one = lambda name: q[name].agg(F.count(F.lit(1)).alias(f"{name}_rows"))
    return out(q["summary"].join(one("unmatched")).join(one("outside")))


@query("q_select_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def select_rows(spark, d):
    return K.select_rows(table(spark, d, "orders"), "o_orderstatus", "F").select("o_orderkey")


@query("q_population_table", "SELECT * FROM (VALUES ('long', CAST(250 AS BIGINT), CAST(72000 AS BIGINT), '2001-01', '2024-12', 'all'), ('paired', 249, 38595, '2012-02', '2024-12', NULL)) t(population_id, units, rows, \"start\", \"end\", rule)")
def population_table(spark, d):
    return X.population_table([{"population_id": "long", "units": 250, "rows": 72000, "start": "2001-01", "end": "2024-12", "rule": "all"}, {"population_id": "paired", "units": 249, "rows": 38595, "start": "2012-02", "end": "2024-12"}], spark)


@query("q_fingerprint", "SELECT '{\"a\":[1,2],\"b\":\"é\"}' AS json, sha256('{\"a\":[1,2],\"b\":\"é\"}') AS sha256")
def fingerprint(spark, d):
    value = {"b": "é", "a": [1, 2]}
    return spark.createDataFrame([(T.stable_json(value), T.fingerprint(value))], "json string, sha256 string")


@query("q_csv_round_trip", "SELECT p_partkey, trim(p_name) AS p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def csv_round_trip(spark, d):
    """part written as sorted CSV parts, and read back strictly with its types."""
    at, columns = workspace(spark, "csv"), ["p_partkey", "p_name", "p_size", "p_retailprice"]
    T.write_csv_parts(table(spark, d, "part"), at, ["p_partkey"], columns)
    return T.parse_types(T.read_csv_strict(spark, f"{at}/part-*.csv", columns), ["p_partkey", "p_size"], ["p_retailprice"])


@query("q_family_round_trip", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, 'r' || n_regionkey AS code FROM nation")
def family_round_trip(spark, d):
    """A file for each region, found again by its code, with one lineage each."""
    at, columns, n = workspace(spark, "family"), ["n_nationkey", "n_name", "run_id", "schema_version"], table(spark, d, "nation").withColumns({"run_id": F.lit("r1"), "schema_version": F.lit("1")})
    codes = [f"r{r[0]}" for r in table(spark, d, "region").select("r_regionkey").collect()]
    for c in codes:
        T.write_output(f"panel_{c}.csv", T.write_csv_bytes(n.where(F.col("n_regionkey") == int(c[1:])), ["n_nationkey"], columns), at)
    T.write_output("panel_r0_qa.csv", b"x\n", at)
    rows = T.load_family(spark, T.discover_family(spark, f"{at}/*.csv", codes), columns)
    return T.parse_types(rows.select("n_nationkey", "n_name", F.regexp_extract("source_path", r"panel_(r\d+)\.csv", 1).alias("code")), ["n_nationkey"], [])


@query("q_partitioned_export", "SELECT sensor, unit_id, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'modis' ELSE 'viirs' END AS sensor, CAST(user_id % 25 AS BIGINT) AS unit_id FROM events) GROUP BY ALL")
def partitioned_export(spark, d):
    """Written in a folder for each sensor and read back."""
    at = workspace(spark, "panel")
    X.write_partitioned(detections(spark, d).select("sensor", "unit_id", "event_id"), at, ["sensor"], ["unit_id", "event_id"])
    return out(spark.read.parquet(at).groupBy("sensor", "unit_id").agg(F.count(F.lit(1)).alias("n")))


@query("q_authorities", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def authorities(spark, d):
    """Materialised with a manifest of digests, and loaded against it."""
    at = workspace(spark, "authority")
    X.materialise({"region": (table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"])}, at)
    return X.load_materialised(spark, at)["region"]


@query("q_manifest", "SELECT 'changed' AS problem, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'unregistered', 1")
def manifest(spark, d):
    """A manifest of written files against a record of which one is missing, one changed and one unknown."""
    at = workspace(spark, "manifest")
    for name in ("a", "b", "c"):
        T.write_output(f"{name}.csv", name.encode(), at)
    now = T.manifest(spark, f"{at}/*.csv")
    name = F.element_at(F.split("path", "/"), -1)
    was = now.where(name != "c.csv").withColumn("sha256", F.when(name == "b.csv", "0").otherwise(F.col("sha256")))
    was = was.unionByName(spark.createDataFrame([(f"{at}/d.csv", 1, "0")], "path string, bytes long, sha256 string"))
    return T.manifest_problems(now, was).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
