"""From points to monthly detection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import class_from_label, class_from_number, hhmm, rounded_text, yyyymm


def canonical_points(raw: DataFrame, names: dict[str, str], sensor: str, mapping: dict[str, str] | None = None, drop_low: bool = False) -> DataFrame:
    """Renames by ``names`` (canonical -> source), coerces, derives date, month and class. A value that does not parse is NULL, for the quality rules to report."""
    col = lambda k: F.col(names[k])
    kind = class_from_number(col("confidence").try_cast("double")) if mapping is None else class_from_label(col("confidence"), mapping)
    day = F.to_date(F.to_timestamp(col("date").cast("string")))
    out = raw.select(
        F.lit(sensor).alias("sensor"), col("lat").try_cast("double").alias("latitude"), col("lon").try_cast("double").alias("longitude"), day.alias("acq_date"),
        hhmm(col("time")).alias("acq_time"), yyyymm(day).alias("yyyymm"), kind.alias("conf"), col("frp").try_cast("double").alias("frp"), col("type").try_cast("int").alias("type"),
        *([col("satellite").alias("satellite")] if "satellite" in names else []),
    )
    return out.where("conf <> 'l'") if drop_low else out


def keep_type(points: DataFrame, code: int = 0, type_col: str = "type") -> DataFrame:
    """The rows of one type code; written before masks and dedup, across which it could not be pushed."""
    return points.where(F.col(type_col) == code)


def type_histogram(points: DataFrame, type_col: str = "type") -> DataFrame:
    return points.groupBy(F.col(type_col).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def in_window(points: DataFrame, start: int | None, end: int | None, key: str = "yyyymm") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; an open side is None."""
    out = points
    if start is not None:
        out = out.where(F.col(key) >= start)
    if end is not None:
        out = out.where(F.col(key) <= end)
    return out


def resolve_window(explicit: tuple | None, sensor: tuple | None, overall: tuple | None) -> tuple:
    """The first that is given: explicit, the sensor's, the global range, none."""
    return next((w for w in (explicit, sensor, overall) if w and any(x is not None for x in w)), (None, None))


def dedup_key(sensor, date, time, lat, lon, decimals: int = 4, satellite=None) -> Column:
    parts = [sensor, *([satellite] if satellite is not None else []), date.cast("string"), time, rounded_text(lat, decimals), rounded_text(lon, decimals)]
    return F.concat_ws("|", *parts)


def keep_first(points: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; a file order does not exist in Spark, so the order is one of columns."""
    w = Window.partitionBy(*key).orderBy(*order)
    return points.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def mark_first(points: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All rows, with whether dedup keeps them."""
    return points.withColumn("was_dedup_kept", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def _counts() -> list[Column]:
    n = lambda c: F.count_if(F.col("conf") == c)
    total = F.count_if(F.col("conf").isin("l", "n", "h"))
    pct = F.when(total > 0, F.round(100.0 * n("h") / total, 3)).otherwise(F.lit(0.0))
    return [n("l").alias("det_low"), n("n").alias("det_nominal"), n("h").alias("det_high"), (n("n") + n("h")).alias("det_nh"), pct.alias("pct_high_conf")]


def detection_counts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by class, nominal plus high, and the percentage of high (0 when there is none)."""
    return points.groupBy(*keys).agg(*_counts())


def daily_maximum(points: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """The largest frp of each unit and day; NULL and less than ``least`` are left out."""
    return points.where(F.col("frp").isNotNull() & (F.col("frp") >= least)).groupBy(*keys, "acq_date").agg(F.max("frp").alias("daily_max"))


def frp_metrics(points: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """Active days, sum, mean and linear 95th percentile of the daily maxima."""
    n = F.count(F.lit(1))
    return daily_maximum(points, keys, least).groupBy(*keys).agg(n.alias("frp_active_days"), F.sum("daily_max").alias("frp_sum"), F.try_divide(F.sum("daily_max"), n).alias("frp_mean"), F.percentile("daily_max", 0.95).alias("frp_p95"))


def persistence(points: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct days of classes n and h, and the longest run of consecutive days inside the group."""
    days = points.where(F.col("conf").isin("n", "h")).select(*keys, "acq_date").distinct()
    run = F.date_sub("acq_date", F.row_number().over(Window.partitionBy(*keys).orderBy("acq_date")))
    runs = days.withColumn("_run", run).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_len"))
    return runs.groupBy(*keys).agg(F.sum("_len").alias("days_active_nh"), F.max("_len").alias("streak_max_nh"))


def run_ids(days: DataFrame, keys: list[str], date_col: str = "acq_date") -> DataFrame:
    """Numbers runs of consecutive days: a new one where the day before is missing."""
    w = Window.partitionBy(*keys).orderBy(date_col)
    starts = F.coalesce((F.datediff(F.col(date_col), F.lag(date_col).over(w)) != 1).cast("int"), F.lit(1))
    return days.withColumn("_new", starts).withColumn("run_id", F.sum("_new").over(w)).drop("_new")


def monthly_metrics(points: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """All metrics of each group in one pass over its days.

    Counting classes, daily maxima and active days per day first makes one
    shuffle of day rows; the full outer join of three metric groups that this
    replaces would make three and a join. Months with low detections only have days and streak 0.
    """
    daily = points.groupBy(*keys, "acq_date").agg(
        *[F.count_if(F.col("conf") == c).alias(c) for c in "lnh"], F.max(F.when(F.col("frp") >= least, F.col("frp"))).alias("daily_max")
    )
    active = (F.col("n") + F.col("h")) > 0
    nth = F.sum(active.cast("int")).over(Window.partitionBy(*keys).orderBy("acq_date"))
    runs = daily.withColumn("_run", F.when(active, F.date_sub("acq_date", nth.cast("int"))))
    runs = runs.withColumn("_len", F.when(active, F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run"))))
    total = F.sum(F.col("l") + F.col("n") + F.col("h"))
    days = F.count("daily_max")
    return runs.groupBy(*keys).agg(
        F.sum("l").alias("det_low"), F.sum("n").alias("det_nominal"), F.sum("h").alias("det_high"), F.sum(F.col("n") + F.col("h")).alias("det_nh"),
        F.when(total > 0, F.round(100.0 * F.sum("h") / total, 3)).otherwise(F.lit(0.0)).alias("pct_high_conf"),
        days.alias("frp_active_days"), F.coalesce(F.sum("daily_max"), F.lit(0.0)).alias("frp_sum"), F.when(days > 0, F.sum("daily_max") / days).alias("frp_mean"), F.percentile("daily_max", 0.95).alias("frp_p95"),
        F.count_if(active).alias("days_active_nh"), F.coalesce(F.max("_len"), F.lit(0)).alias("streak_max_nh"),
    )
