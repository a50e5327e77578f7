"""Running sums over large groups, without a task for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, group: list[str], coarse: Column, fine: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that come before the row.

    Rows are ordered by (coarse, fine, *order); ``coarse`` and ``fine`` must be
    monotone in that order, and few enough per group (about a thousand each) for
    a window over their sums. A group is thus spread over as many tasks as it
    has (coarse, fine) cells, so one that holds a third of all rows stays cheap.
    """
    rows = df.withColumns({"_c": coarse, "_f": fine, "_v": value})
    cells = rows.groupBy(*group, "_c", "_f").agg(F.sum("_v").alias("_s"))
    within = Window.partitionBy(*group, "_c").orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before_f", F.coalesce(F.sum("_s").over(within), F.lit(0)))
    coarse_sums = cells.groupBy(*group, "_c").agg(F.sum("_s").alias("_cs"))
    above = Window.partitionBy(*group).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    coarse_sums = coarse_sums.withColumn("_before_c", F.coalesce(F.sum("_cs").over(above), F.lit(0))).drop("_cs")
    same = lambda a, b, names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    offsets = (
        cells.alias("a").join(coarse_sums.alias("b"), same("a", "b", [*group, "_c"]))
        .select(*[F.col(f"a.{n}").alias(n) for n in [*group, "_c", "_f"]], (F.col("_before_f") + F.col("_before_c")).alias("_offset"))
    )
    inside = Window.partitionBy(*group, "_c", "_f").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    joined = rows.alias("a").join(offsets.alias("b"), same("a", "b", [*group, "_c", "_f"]))
    keep = [F.col(f"a.{c}").alias(c) for c in df.columns]
    return joined.select(*keep, (F.col("_inside") + F.col("_offset")).cast("long").alias(out))
