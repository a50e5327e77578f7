"""Points to monthly metrics, on ``events``."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import detections as D
from ..operators import panel as P
from ..operators.adapters import detections, units
from .registry import out, query

#: The adapter's view of events, as SQL.
DET = """
det AS (SELECT event_id, ts, 'nation' AS level, CAST(user_id % 25 AS BIGINT) AS unit_id,
  CASE WHEN event_type = 'error' THEN 'l' WHEN event_type IN ('view', 'click') THEN 'n' WHEN event_type IN ('purchase', 'signup') THEN 'h' END AS conf,
  value AS frp, CAST(ts AS DATE) AS acq_date, CAST(year(ts) * 100 + month(ts) AS BIGINT) AS yyyymm, CAST(week(ts) AS BIGINT) AS week,
  CASE WHEN event_id % 2 = 0 THEN 'modis' ELSE 'viirs' END AS sensor, CAST(event_id % 7 % 4 AS BIGINT) AS type,
  user_id % 5 + value / 1000 AS x, (user_id // 5) % 5 + value / 2000 AS y FROM events)
"""
KEYS = ["level", "unit_id", "yyyymm"]
METRICS = f"""
WITH {DET},
c AS (SELECT level, unit_id, yyyymm, count(*) FILTER (conf = 'l') AS det_low, count(*) FILTER (conf = 'n') AS det_nominal, count(*) FILTER (conf = 'h') AS det_high,
  count(*) FILTER (conf IN ('n', 'h')) AS det_nh, round(CASE WHEN count(conf) > 0 THEN 100.0 * count(*) FILTER (conf = 'h') / count(conf) ELSE 0 END, 3) AS pct_high_conf FROM det GROUP BY ALL),
dm AS (SELECT level, unit_id, yyyymm, acq_date, max(frp) AS m FROM det WHERE frp >= 0 GROUP BY ALL),
f AS (SELECT level, unit_id, yyyymm, count(*) AS frp_active_days, sum(m) AS frp_sum, avg(m) AS frp_mean, quantile_cont(m, 0.95) AS frp_p95 FROM dm GROUP BY ALL),
d AS (SELECT DISTINCT level, unit_id, yyyymm, acq_date FROM det WHERE conf IN ('n', 'h')),
r AS (SELECT *, acq_date - CAST(row_number() OVER (PARTITION BY level, unit_id, yyyymm ORDER BY acq_date) AS INTEGER) AS run FROM d),
l AS (SELECT level, unit_id, yyyymm, run, count(*) AS n FROM r GROUP BY ALL),
p AS (SELECT level, unit_id, yyyymm, CAST(sum(n) AS BIGINT) AS days_active_nh, max(n) AS streak_max_nh FROM l GROUP BY ALL)
"""


@query("q_confidence_classes", f"WITH {DET} SELECT sensor, conf, CASE conf WHEN 'l' THEN 0 WHEN 'n' THEN 1 WHEN 'h' THEN 2 END::BIGINT AS rank, CASE WHEN frp < 30 THEN 'l' WHEN frp >= 80 THEN 'h' ELSE 'n' END AS by_number, count(*) AS n FROM det GROUP BY ALL")
def confidence_classes(spark, d):
    p = detections(spark, d)
    return out(p.groupBy("sensor", "conf", S.class_rank("conf").alias("rank"), S.class_from_number("frp").alias("by_number")).agg(F.count(F.lit(1)).alias("n")))


@query("q_class_by_sensor", "SELECT CASE WHEN event_id % 2 = 0 THEN 'modis' ELSE 'viirs' END AS sensor, CASE WHEN event_id % 2 = 0 THEN CASE WHEN value < 30 THEN 'l' WHEN value >= 80 THEN 'h' ELSE 'n' END ELSE CASE event_type WHEN 'error' THEN 'l' WHEN 'view' THEN 'n' WHEN 'click' THEN 'n' WHEN 'purchase' THEN 'h' END END AS conf, count(*) AS n FROM events GROUP BY ALL")
def class_by_sensor(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    sensor = F.when(F.col("event_id") % 2 == 0, "modis").otherwise("viirs")
    conf = S.class_by_sensor(sensor, F.col("value"), F.concat(F.lit(" "), F.upper("event_type")), {"error": "l", "view": "n", "click": "n", "purchase": "h"})
    return e.groupBy(sensor.alias("sensor"), conf.alias("conf")).agg(F.count(F.lit(1)).alias("n"))


@query("q_type_filter_hist", f"WITH {DET} SELECT type, count(*) AS n FROM det GROUP BY type")
def type_hist(spark, d):
    return out(D.type_histogram(detections(spark, d)))


@query("q_type_kept_window", f"WITH {DET} SELECT unit_id, count(*) AS n, CAST(min(acq_date) AS VARCHAR) AS first, CAST(max(acq_date) AS VARCHAR) AS last FROM det WHERE type = 0 AND yyyymm BETWEEN 202401 AND 202402 GROUP BY unit_id")
def type_kept(spark, d):
    lo, hi = D.resolve_window(None, (202401, 202402), (200001, 210012))
    return out(D.in_window(D.keep_type(detections(spark, d)), lo, hi).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.min("acq_date").alias("first"), F.max("acq_date").alias("last")))


@query("q_dedup_keep_first", f"WITH {DET}, k AS (SELECT *, sensor || '|' || CAST(acq_date AS VARCHAR) || '|' || unit_id AS dedup_key FROM det), r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY event_id) AS rn FROM k) SELECT dedup_key, event_id, conf, frp FROM r WHERE rn = 1")
def dedup_first(spark, d):
    p = detections(spark, d).withColumn("dedup_key", F.concat_ws("|", "sensor", F.col("acq_date").cast("string"), F.col("unit_id").cast("string")))
    return D.keep_first(p, ["dedup_key"], ["event_id"]).select("dedup_key", "event_id", "conf", "frp")


@query("q_dedup_marked", f"WITH {DET}, r AS (SELECT sensor, row_number() OVER (PARTITION BY sensor, acq_date, unit_id ORDER BY event_id) = 1 AS was_dedup_kept FROM det) SELECT sensor, was_dedup_kept, count(*) AS n FROM r GROUP BY ALL")
def dedup_marked(spark, d):
    return D.mark_first(detections(spark, d), ["sensor", "acq_date", "unit_id"], ["event_id"]).groupBy("sensor", "was_dedup_kept").agg(F.count(F.lit(1)).alias("n"))


@query("q_hhmm_month_keys", "SELECT event_id, lpad(CAST(hour(ts) * 100 + minute(ts) AS VARCHAR), 4, '0') AS hhmm, CAST(year(ts) * 100 + month(ts) AS BIGINT) AS yyyymm, CAST(year(ts) * 12 + month(ts) - 1 AS BIGINT) AS ordinal, CAST(year(ts + INTERVAL 5 MONTH) * 100 + month(ts + INTERVAL 5 MONTH) AS BIGINT) AS plus_five, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS acquired FROM events")
def hhmm_keys(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    t, k = S.hhmm(F.hour("ts") * 100 + F.minute("ts")), S.yyyymm("ts")
    return out(e.select("event_id", t.alias("hhmm"), k.alias("yyyymm"), S.month_ordinal(k).alias("ordinal"), S.add_months_key(k, 5).alias("plus_five"), S.acquisition_time(F.to_date("ts"), t).cast("timestamp_ntz").alias("acquired")))


@query("q_canonical_points", "SELECT CAST(user_id AS DOUBLE) AS latitude, value AS longitude, CAST(CAST(ts AS DATE) AS VARCHAR) AS acq_date, lpad(CAST(hour(ts) * 100 + minute(ts) AS VARCHAR), 4, '0') AS acq_time, CAST(year(ts) * 100 + month(ts) AS BIGINT) AS yyyymm, CASE WHEN value < 30 THEN 'l' WHEN value >= 80 THEN 'h' ELSE 'n' END AS conf, value AS frp, CAST(event_id % 4 AS BIGINT) AS type, 'modis' AS sensor FROM events WHERE value >= 30")
def canonical(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("LATITUDE"), F.col("value").cast("string").alias("LONGITUDE"), F.col("ts").cast("string").alias("ACQ_DATE"), (F.hour("ts") * 100 + F.minute("ts")).alias("ACQ_TIME"), F.col("value").cast("string").alias("CONFIDENCE"), F.col("value").alias("FRP"), (F.col("event_id") % 4).alias("TYPE"))
    return out(D.canonical_points(e, {"lat": "LATITUDE", "lon": "LONGITUDE", "date": "ACQ_DATE", "time": "ACQ_TIME", "confidence": "CONFIDENCE", "frp": "FRP", "type": "TYPE"}, "modis", drop_low=True))


@query("q_monthly_detections", METRICS + "SELECT * FROM c")
def monthly_detections(spark, d):
    return out(D.detection_counts(detections(spark, d), KEYS))


@query("q_daily_max", f"WITH {DET} SELECT unit_id, CAST(acq_date AS VARCHAR) AS acq_date, max(frp) AS daily_max FROM det WHERE frp >= 1 GROUP BY unit_id, det.acq_date")
def daily_max(spark, d):
    return out(D.daily_maximum(detections(spark, d), ["unit_id"], 1.0))


@query("q_monthly_frp", METRICS + "SELECT level, unit_id, yyyymm, frp_active_days, round(frp_sum, 6) AS frp_sum, round(frp_mean, 6) AS frp_mean, round(frp_p95, 6) AS frp_p95 FROM f")
def monthly_frp(spark, d):
    return out(D.frp_metrics(detections(spark, d), KEYS))


@query("q_persistence_streak", METRICS + "SELECT * FROM p")
def persistence(spark, d):
    return out(D.persistence(detections(spark, d), KEYS))


@query("q_run_ids", f"WITH {DET}, d AS (SELECT DISTINCT unit_id, acq_date FROM det WHERE conf = 'h'), n AS (SELECT *, CASE WHEN acq_date - lag(acq_date) OVER (PARTITION BY unit_id ORDER BY acq_date) = 1 THEN 0 ELSE 1 END AS new FROM d) SELECT unit_id, CAST(acq_date AS VARCHAR) AS acq_date, CAST(sum(new) OVER (PARTITION BY unit_id ORDER BY n.acq_date) AS BIGINT) AS run_id FROM n")
def run_ids(spark, d):
    return out(D.run_ids(detections(spark, d).where("conf = 'h'").select("unit_id", "acq_date").distinct(), ["unit_id"]))


@query("q_monthly_metrics", METRICS + "SELECT c.*, frp_active_days, round(coalesce(frp_sum, 0), 6) AS frp_sum, round(frp_mean, 6) AS frp_mean, round(frp_p95, 6) AS frp_p95, coalesce(days_active_nh, 0) AS days_active_nh, coalesce(streak_max_nh, 0) AS streak_max_nh FROM c LEFT JOIN f USING (level, unit_id, yyyymm) LEFT JOIN p USING (level, unit_id, yyyymm)")
def monthly_metrics(spark, d):
    return out(D.monthly_metrics(detections(spark, d), KEYS))


@query("q_weekly_metrics", METRICS.replace("yyyymm", "week").replace("AS week, CAST(week(ts)", "AS yyyymm, CAST(week(ts)") + "SELECT c.*, coalesce(days_active_nh, 0) AS days_active_nh, coalesce(streak_max_nh, 0) AS streak_max_nh FROM c LEFT JOIN p USING (level, unit_id, week)")
def weekly_metrics(spark, d):
    return out(D.monthly_metrics(detections(spark, d), ["level", "unit_id", "week"]).drop("frp_active_days", "frp_sum", "frp_mean", "frp_p95"))


COVER = (202401, 202402)
SPINE = "spine AS (SELECT CAST(u.n_nationkey AS BIGINT) AS unit_id, n_name AS unit_name, m.yyyymm FROM nation u, (SELECT CAST(o // 12 * 100 + o % 12 + 1 AS BIGINT) AS yyyymm FROM (SELECT unnest(range((SELECT min(year(ts) * 12 + month(ts)) - 2 FROM events), (SELECT max(year(ts) * 12 + month(ts)) + 1 FROM events))) AS o)) m)"
FILLED = METRICS + f""", {SPINE},
s AS (SELECT spine.*, yyyymm BETWEEN 202401 AND 202402 AS cov FROM spine),
j AS (SELECT s.*, det_low, det_nominal, det_high, det_nh, pct_high_conf, frp_active_days, frp_sum, frp_mean, frp_p95, days_active_nh, streak_max_nh
  FROM s LEFT JOIN c ON s.unit_id = c.unit_id AND s.yyyymm = c.yyyymm LEFT JOIN f ON s.unit_id = f.unit_id AND s.yyyymm = f.yyyymm LEFT JOIN (SELECT c.unit_id, c.yyyymm, coalesce(days_active_nh, 0) AS days_active_nh, coalesce(streak_max_nh, 0) AS streak_max_nh FROM c LEFT JOIN p USING (unit_id, yyyymm)) q ON s.unit_id = q.unit_id AND s.yyyymm = q.yyyymm),
filled AS (SELECT unit_id, unit_name, yyyymm, cov, CASE WHEN cov THEN coalesce(det_low, 0) END AS det_low, CASE WHEN cov THEN coalesce(det_nominal, 0) END AS det_nominal, CASE WHEN cov THEN coalesce(det_high, 0) END AS det_high, CASE WHEN cov THEN coalesce(det_nh, 0) END AS det_nh,
  CASE WHEN cov THEN coalesce(frp_active_days, 0) END AS frp_active_days, CASE WHEN cov THEN coalesce(frp_sum, 0) END AS frp_sum, CASE WHEN cov THEN frp_mean END AS frp_mean, CASE WHEN cov THEN pct_high_conf END AS pct_high_conf, CASE WHEN cov THEN frp_p95 END AS frp_p95, CASE WHEN cov THEN days_active_nh END AS days_active_nh, CASE WHEN cov THEN streak_max_nh END AS streak_max_nh FROM j)
"""


def spine_rows(spark, d):
    """Every unit in every month of the table, and in one before and after."""
    first, last = detections(spark, d).agg(F.min("acq_date"), F.max("acq_date")).first()
    o = [first.year * 12 + first.month - 2, last.year * 12 + last.month]
    return P.spine(units(spark, d).select("unit_id", "unit_name"), *[k // 12 * 100 + k % 12 + 1 for k in o])


def filled_panel(spark, d):
    m = D.monthly_metrics(detections(spark, d), ["unit_id", "yyyymm"])
    panel = P.onto_spine(spine_rows(spark, d), m, ["unit_id", "yyyymm"])
    return P.fill_covered(panel, P.in_coverage(*COVER))


@query("q_spine", f"WITH {SPINE} SELECT * FROM spine")
def spine(spark, d):
    return out(spine_rows(spark, d))


@query("q_balanced_panel", FILLED + "SELECT unit_id, unit_name, yyyymm, det_low, det_nominal, det_high, det_nh, frp_active_days, round(frp_sum, 6) AS frp_sum, round(frp_mean, 6) AS frp_mean, pct_high_conf, round(frp_p95, 6) AS frp_p95, days_active_nh, streak_max_nh FROM filled")
def balanced(spark, d):
    return out(filled_panel(spark, d))


@query("q_coverage_null", FILLED + "SELECT yyyymm, count(*) AS n, count(det_low) AS with_counts, count(frp_mean) AS with_mean, count(frp_p95) AS with_p95 FROM filled GROUP BY yyyymm")
def coverage_null(spark, d):
    return out(filled_panel(spark, d).groupBy("yyyymm").agg(F.count(F.lit(1)).alias("n"), F.count("det_low").alias("with_counts"), F.count("frp_mean").alias("with_mean"), F.count("frp_p95").alias("with_p95")))


@query("q_qc_flags", FILLED + "SELECT unit_id, yyyymm, cov AS in_coverage, NOT cov AS structural_missing, CASE WHEN cov THEN det_nh + det_low > 0 END AS has_any, CASE WHEN cov THEN det_nh + det_low < 3 END AS low_information, CASE WHEN cov THEN CASE WHEN frp_active_days = 0 THEN TRUE ELSE abs(frp_mean * frp_active_days - frp_sum) <= 1e-9 * greatest(1, abs(frp_sum)) END END AS frp_ok FROM filled")
def qc(spark, d):
    return out(P.qc_flags(filled_panel(spark, d), P.in_coverage(*COVER)).select("unit_id", "yyyymm", "in_coverage", "structural_missing", "has_any", "low_information", "frp_ok"))


@query("q_year_provenance", FILLED + "SELECT unit_id, yyyymm, count(*) OVER w AS year_rows, CAST(sum(cov::INT) OVER w AS BIGINT) AS year_covered, CAST(count(*) OVER w - sum(cov::INT) OVER w AS BIGINT) AS year_missing, count(*) OVER w = 12 AND sum(cov::INT) OVER w = 12 AS year_complete FROM filled WINDOW w AS (PARTITION BY unit_id, yyyymm // 100)")
def provenance(spark, d):
    return out(P.year_provenance(filled_panel(spark, d), ["unit_id"], P.in_coverage(*COVER)).select("unit_id", "yyyymm", "year_rows", "year_covered", "year_missing", "year_complete"))


@query("q_level_totals", FILLED + "SELECT yyyymm, CAST(sum(det_low) AS BIGINT) AS det_low, CAST(sum(det_nh) AS BIGINT) AS det_nh, round(sum(frp_sum), 6) AS frp_sum FROM filled GROUP BY yyyymm")
def totals(spark, d):
    return out(P.level_totals(filled_panel(spark, d), ["det_low", "det_nh", "frp_sum"], ("yyyymm",)))


@query("q_month_spine_gaps", f"WITH {DET}, m AS (SELECT DISTINCT unit_id, yyyymm FROM det), g AS (SELECT unit_id, yyyymm, (yyyymm // 100) * 12 + yyyymm % 100 - lag((yyyymm // 100) * 12 + yyyymm % 100) OVER (PARTITION BY unit_id ORDER BY yyyymm) AS step FROM m) SELECT unit_id, min(yyyymm) AS first, max(yyyymm) AS last, count(*) FILTER (step <> 1) AS breaks, count(*) AS months FROM g GROUP BY unit_id HAVING min(yyyymm) <> 202401 OR max(yyyymm) <> 202403 OR count(*) FILTER (step <> 1) > 0")
def gaps(spark, d):
    return out(P.spine_gaps(detections(spark, d).select("unit_id", "yyyymm").distinct(), "unit_id", 202401, 202403))


@query("q_key_audit", METRICS + "SELECT CAST(count(*) AS BIGINT) AS actual_rows, count(DISTINCT (level, unit_id, yyyymm)) AS unique_keys, CAST(0 AS BIGINT) AS duplicate_key_rows, min(yyyymm) AS yyyymm_min, max(yyyymm) AS yyyymm_max, CAST(8 AS BIGINT) AS column_count, TRUE AS passes FROM c")
def audit(spark, d):
    return out(P.key_audit(D.detection_counts(detections(spark, d), KEYS), KEYS))


@query("q_days_pivot", f"WITH {DET} SELECT unit_id, count(*) FILTER (conf = 'l') AS low, count(*) FILTER (conf = 'n') AS nominal, count(*) FILTER (conf = 'h') AS high FROM det GROUP BY unit_id")
def pivoted(spark, d):
    p = detections(spark, d).groupBy("unit_id").pivot("conf", ["l", "n", "h"]).agg(F.count(F.lit(1)))
    return out(p.select("unit_id", *[F.coalesce(F.col(a), F.lit(0)).alias(b) for a, b in (("l", "low"), ("n", "nominal"), ("h", "high"))]))
