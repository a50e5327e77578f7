"""Tables for publication: unions, reshapes, registries, map sources, text aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_records(parts: dict[str, DataFrame]) -> DataFrame:
    """Heterogeneous rows in one long form: record_type first, absent columns NULL."""
    typed = [df.select(F.lit(name).alias("record_type"), "*") for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), typed)


def unpivot_months(rows: DataFrame, keys: list[str], prefix: str, value: str) -> DataFrame:
    """prefix_m01..m12 to (keys, month, value)."""
    cols = [f"{prefix}_m{m:02d}" for m in range(1, 13)]
    long = rows.unpivot(keys, cols, "_m", value)
    return long.select(*keys, F.substring("_m", -2, 2).cast("int").alias("month"), value)


def pivot_months(rows: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """(keys, month, value) to prefix_m01..m12 by conditional aggregates."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("month") == m, F.col(value))).alias(f"{prefix}_m{m:02d}") for m in range(1, 13)])


def sorted_list(rows: DataFrame, by: list[str], column: str, sep: str = "|") -> DataFrame:
    """Sorted distinct texts of a group in one string."""
    return rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), sep).alias("joined"))


def support_status(value: str, eligible: str) -> Column:
    """excluded, valid_zero or valid_nonzero."""
    return F.when(~F.col(eligible), "excluded").when(F.col(value) == 0, "valid_zero").when(F.col(value).isNotNull(), "valid_nonzero")


def map_source(universe: DataFrame, values: DataFrame, mask: DataFrame, unit: str, value: str) -> DataFrame:
    """A row for each unit: status, value (NULL if excluded) and why."""
    j = universe.join(values.select(unit, value), unit, "left").join(mask, unit, "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    return j.select(*universe.columns, support_status(value, "eligible").alias("support_status"), F.when(F.col("eligible"), F.col(value)).alias("value"), "exclusion_reasons")


def figure_violations(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows of another status, or excluded rows that carry a value."""
    return rows.where(~F.col("support_status").isin(*statuses) | ((F.col("support_status") == "excluded") & F.col("value").isNotNull()))


def table_one(rates: DataFrame, spread: DataFrame, trend: DataFrame, key: str) -> DataFrame:
    """One-to-one join of rates, dispersion and trend."""
    return rates.join(spread, key).join(trend, key)


def top_examples(rows: DataFrame, order: list, k: int = 10) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def display_order(rows: DataFrame, parent_order: list[str], parent: str, by: str, name: str) -> DataFrame:
    """Numbered by a given parent order, then a value (NULL last), then a name."""
    place = F.array_position(F.array(*map(F.lit, parent_order)), F.col(parent))
    w = Window.orderBy(place, F.col(by).asc_nulls_last(), name)
    return rows.withColumn("display_order", F.row_number().over(w))


def registry(records: dict[str, DataFrame], key: str = "result_id") -> DataFrame:
    """(result_id, field, value) of one-row results of any shape."""
    parts = [df.select(F.lit(n).alias(key), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in df.columns])).alias("r")).select(key, "r.*") for n, df in records.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def select_rows(rows: DataFrame, selector: str, value=None) -> DataFrame:
    """``all_rows`` or ``column = value``; raises if nothing is left."""
    out = rows if selector == "all_rows" else rows.where(F.col(selector) == value)
    if out.isEmpty():
        raise ValueError(f"{selector} = {value}: no rows")
    return out
