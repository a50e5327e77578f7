"""The driver's tables seen as detections, monthly panels, pixels and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import yyyymm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as point detections: 25 units, three classes, frp, date, sensor, position and a type code."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "l").when(F.col("event_type").isin("view", "click"), "n").when(F.col("event_type").isin("purchase", "signup"), "h")
    day = F.to_date("ts")
    return e.select(
        "event_id", "ts", F.lit("nation").alias("level"), (F.col("user_id") % 25).cast("int").alias("unit_id"), kind.alias("conf"), F.col("value").alias("frp"), day.alias("acq_date"),
        yyyymm(day).alias("yyyymm"), F.weekofyear(day).alias("week"), F.when(F.col("event_id") % 2 == 0, "modis").otherwise("viirs").alias("sensor"),
        (F.col("user_id") % 5 + F.col("value") / 1000).alias("x"), (F.floor(F.col("user_id") / 5) % 5 + F.col("value") / 2000).alias("y"), (F.col("event_id") % 7 % 4).cast("int").alias("type"),
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by supplier nation and month: numerator (returned quantity), all quantity, a constant denominator per nation."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = li.join(s, li.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("unit_id"), yyyymm("l_shipdate").alias("yyyymm"))
    return rows.agg(
        F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0.0)).alias("area"),
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"),
    ).withColumn("support", (100 + 7 * F.col("unit_id")).cast("double"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under regions: a unit universe of two levels."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("unit_name"), F.col("r_regionkey").alias("parent_id"), F.col("r_name").alias("parent_name"))
