"""Analytical populations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_window(start: int, end: int, key: str = "yyyymm") -> Column:
    return F.col(key).between(start, end)


def year_window(first: int, last: int, key: str = "yyyymm") -> Column:
    """Whole years, both ends included."""
    return F.floor(F.col(key) / 100).between(first, last)


def population_mask(units: DataFrame, panel: DataFrame, unit: str, start: int, end: int, support: list[str], denominator: str | None = None) -> DataFrame:
    """(unit, eligible, exclusion_reasons): every unit of the universe with all reasons, joined by ``;``.

    A unit counts if it has exactly the window's months, all supported, and its denominator is positive in all.
    """
    o = lambda k: k // 100 * 12 + k % 100
    months = o(end) - o(start) + 1
    aggs = [F.count(F.lit(1)).alias("_n"), F.countDistinct("yyyymm").alias("_k"), *[F.count_if(F.col(s)).alias(f"_s{i}") for i, s in enumerate(support)]]
    aggs.append((F.min(denominator) if denominator else F.lit(1.0)).alias("_d"))
    aggs.append((F.count(denominator) if denominator else F.count(F.lit(1))).alias("_dn"))
    got = panel.where(month_window(start, end)).groupBy(unit).agg(*aggs)
    j = units.select(unit).join(got, unit, "left")
    n = F.coalesce("_n", F.lit(0))
    reasons = [F.when((n != months) | (F.coalesce("_k", F.lit(0)) != months), "months_incomplete"), *[F.when(n != F.coalesce(f"_s{i}", F.lit(0)), "unsupported_month") for i in range(len(support))]]
    if denominator:
        reasons.append(F.when(F.col("_d").isNull() | (F.col("_d") <= 0) | (F.col("_dn") != n), "denominator_not_positive"))
    text = F.concat_ws(";", *reasons)
    return j.select(unit, (text == "").alias("eligible"), text.alias("exclusion_reasons"))


def exclusion_histogram(mask: DataFrame) -> DataFrame:
    return mask.where("exclusion_reasons <> ''").select(F.explode(F.split("exclusion_reasons", ";")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def finite_violations(rows: DataFrame, columns: list[str], nonnegative: bool = True) -> DataFrame:
    """One row: how many values of each column are missing, not finite or negative."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) | ((F.col(c) < 0) if nonnegative else F.lit(False))
    return rows.agg(*[F.count_if(bad(c)).alias(c) for c in columns])
