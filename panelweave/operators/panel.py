"""Balanced unit-month panels: spine, fill, coverage, quality flags, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import null_aware_sum, ordinal_month

COUNTS = ("det_low", "det_nominal", "det_high", "det_nh", "frp_active_days")


def months_between(spark: SparkSession, start: int, end: int) -> DataFrame:
    """(yyyymm) from start to end, both included."""
    o = lambda k: k // 100 * 12 + k % 100 - 1
    if end < start:
        raise ValueError(f"reversed window {start}..{end}")
    return spark.range(o(start), o(end) + 1).select(ordinal_month("id").alias("yyyymm"))


def spine(units: DataFrame, start: int, end: int) -> DataFrame:
    """Every distinct unit in every month. Months go to each unit as an array, so no cross join is planned."""
    o = lambda k: k // 100 * 12 + k % 100 - 1
    out = units.distinct().withColumn("_o", F.explode(F.sequence(F.lit(o(start)), F.lit(o(end)))))
    return out.withColumn("yyyymm", ordinal_month("_o")).drop("_o")


def onto_spine(spine_rows: DataFrame, metrics: DataFrame, keys: list[str], prefix: str | None = None) -> DataFrame:
    """Left join of the metrics (only those with the prefix) to the spine."""
    keep = [c for c in metrics.columns if c in keys or prefix is None or c.startswith(prefix)]
    return spine_rows.join(metrics.select(*keep), keys, "left")


def sensor_columns(df: DataFrame, sensor: str, metrics: list[str]) -> DataFrame:
    """Contract columns of a sensor; those that are absent are NULL."""
    have = set(df.columns)
    return df.withColumns({f"{sensor}_{m}": F.lit(None).cast("double") for m in metrics if f"{sensor}_{m}" not in have})


def swap_prefix(df: DataFrame, old: str, new: str) -> DataFrame:
    """Renames <old>_x to <new>_x and derives <new>_det_all where it is missing."""
    out = df.withColumnsRenamed({c: new + c[len(old):] for c in df.columns if c.startswith(old + "_")})
    parts = [f"{new}_det_{k}" for k in ("low", "nominal", "high")]
    return out.withColumn(f"{new}_det_all", null_aware_sum(*parts)) if all(p in out.columns for p in parts) and f"{new}_det_all" not in out.columns else out


def in_coverage(start: int, end: int | None = None, key: str = "yyyymm") -> Column:
    return (F.col(key) >= start) & (F.lit(True) if end is None else F.col(key) <= end)


def fill_covered(panel: DataFrame, covered: Column) -> DataFrame:
    """Observed zero against structurally missing.

    Inside coverage counts and sums are 0 where no detection was seen, and a
    missing mean is recomputed from sum and days, NULL without active day; percentages,
    streaks and the percentile stay NULL. Outside coverage everything is NULL, applied last.
    """
    out = panel.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in COUNTS} | {"frp_sum": F.coalesce("frp_sum", F.lit(0.0))})
    out = out.withColumn("frp_mean", F.when(F.col("frp_active_days") > 0, F.coalesce("frp_mean", F.col("frp_sum") / F.col("frp_active_days"))))
    metrics = [*COUNTS, "frp_sum", "frp_mean", *[c for c in ("pct_high_conf", "days_active_nh", "streak_max_nh", "frp_p95") if c in panel.columns]]
    return mask_outside(out, covered, metrics)


def mask_outside(panel: DataFrame, covered: Column, columns: list[str]) -> DataFrame:
    return panel.withColumns({c: F.when(covered, F.col(c)) for c in columns})


def qc_flags(panel: DataFrame, covered: Column, least_detections: int = 3, tolerance: float = 1e-9) -> DataFrame:
    """has_any, in_coverage, structural_missing, low_information (NULL outside coverage) and frp_ok: sum = mean * days."""
    seen = F.coalesce(F.col("det_nh"), F.lit(0)) + F.coalesce(F.col("det_low"), F.lit(0))
    agrees = (F.col("frp_active_days") == 0) | (F.abs(F.col("frp_mean") * F.col("frp_active_days") - F.col("frp_sum")) <= tolerance * F.greatest(F.lit(1.0), F.abs("frp_sum")))
    return panel.withColumns({
        "in_coverage": covered, "structural_missing": ~covered, "has_any": F.when(covered, seen > 0), "low_information": F.when(covered, seen < least_detections), "frp_ok": F.when(covered, agrees),
    })


def year_provenance(panel: DataFrame, keys: list[str], covered: Column) -> DataFrame:
    """Rows, covered rows, missing rows and completeness of each unit-year, on every row."""
    w = Window.partitionBy(*keys, F.floor(F.col("yyyymm") / 100))
    rows, in_cov = F.count(F.lit(1)).over(w), F.sum(covered.cast("long")).over(w)
    return panel.withColumns({"year_rows": rows, "year_covered": in_cov, "year_missing": rows - in_cov, "year_complete": (rows == 12) & (in_cov == 12)})


def level_totals(panel: DataFrame, metrics: list[str], keys: tuple = ("level", "yyyymm")) -> DataFrame:
    return panel.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in metrics])


def spine_gaps(panel: DataFrame, unit: str, start: int, end: int) -> DataFrame:
    """Units whose months are not exactly start..end, each once and without a gap."""
    o = F.floor(F.col("yyyymm") / 100) * 12 + F.col("yyyymm") % 100 - 1
    lag = F.lag("_o").over(Window.partitionBy(unit).orderBy("_o"))
    rows = panel.select(unit, "yyyymm").withColumn("_o", o).withColumn("_gap", F.coalesce(F.col("_o") - lag != 1, F.lit(False)))
    got = rows.groupBy(unit).agg(F.min("yyyymm").alias("first"), F.max("yyyymm").alias("last"), F.count_if("_gap").alias("breaks"), F.count(F.lit(1)).alias("months"))
    return got.where((F.col("first") != start) | (F.col("last") != end) | (F.col("breaks") > 0))


def key_audit(panel: DataFrame, keys: list[str], expected_rows: int | None = None) -> DataFrame:
    """One row: rows, unique keys, rows of repeated keys, first and last month, columns, and whether all is well."""
    per_key = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = per_key.agg(
        F.sum("_n").alias("actual_rows"), F.count(F.lit(1)).alias("unique_keys"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_key_rows"),
        F.min("yyyymm").alias("yyyymm_min"), F.max("yyyymm").alias("yyyymm_max"),
    ).withColumn("column_count", F.lit(len(panel.columns)))
    good = F.col("duplicate_key_rows") == 0
    return out.withColumn("passes", good if expected_rows is None else good & (F.col("actual_rows") == expected_rows))
