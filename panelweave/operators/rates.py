"""Annual rates, summaries, dispersion, seasonality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_angle, safe_divide


def annual_rate(monthly: DataFrame, unit: list[str], value: str, support: str, scale: float = 100.0) -> DataFrame:
    """Per unit and year: total, support, scale * total / support, and the state of the year.

    ``status`` is ok, incomplete (not exactly months 1..12), support_varies or
    support_not_positive; the rate is NULL unless ok. ``require_ok`` raises on the others.
    """
    rows = monthly.withColumns({"_y": F.floor(F.col("yyyymm") / 100).cast("int"), "_m": (F.col("yyyymm") % 100).cast("int")})
    constant = rows.groupBy(*unit).agg(F.min(support).alias("_lo"), F.max(support).alias("_hi"))
    years = rows.groupBy(*unit, F.col("_y").alias("year")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("_n"), F.countDistinct("_m").alias("_months"))
    out = years.join(constant, unit)
    status = F.when(F.col("_lo") != F.col("_hi"), "support_varies").when(~(F.col("_lo") > 0), "support_not_positive").when((F.col("_n") != 12) | (F.col("_months") != 12), "incomplete").otherwise("ok")
    return out.select(*unit, "year", "total", F.col("_lo").alias("support"), status.alias("status"), F.when(status == "ok", scale * F.col("total") / F.col("_lo")).alias("rate"))


def unit_summary(annual: DataFrame, unit: list[str]) -> DataFrame:
    """Totals and means over the complete years."""
    return annual.where("status = 'ok'").groupBy(*unit).agg(F.count(F.lit(1)).alias("n_years"), F.sum("total").alias("total"), F.avg("total").alias("mean_annual_total"), F.avg("rate").alias("mean_annual_rate"), F.min("support").alias("support"))


def annualise(monthly: DataFrame, unit: list[str], value: str, supported: Column, how: str = "sum") -> DataFrame:
    """Sum or mean of a year's months, only where all 12 are there and supported; else NULL with its flags."""
    rows = monthly.withColumn("_s", supported)
    agg = F.sum(value) if how == "sum" else F.avg(value)
    got = rows.groupBy(*unit, F.floor(F.col("yyyymm") / 100).cast("int").alias("year")).agg(agg.alias("_v"), F.countDistinct("yyyymm").alias("months"), F.count_if("_s").alias("supported_months"))
    complete, full = F.col("months") == 12, F.col("supported_months") == 12
    return got.select(*unit, "year", F.when(complete & full, F.col("_v")).alias("value"), complete.alias("complete"), full.alias("supported"))


def gini(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Gini by group: 0 if all are 0, NULL if one is negative, clamped to [0, 1]."""
    r = F.row_number().over(Window.partitionBy(*group).orderBy(value))
    rows = values.where(F.col(value).isNotNull()).withColumn("_r", r)
    n, total = F.count(F.lit(1)), F.sum(value)
    raw = 2 * F.sum(F.col("_r") * F.col(value)) / (n * total) - (n + 1) / n
    clamped = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    return rows.groupBy(*group).agg(F.when(F.min(value) < 0, None).when(total == 0, 0.0).otherwise(clamped).alias("gini"))


def dispersion(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Number, median, quartiles (linear), their distance and Gini by parent."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = values.groupBy(*group).agg(F.count(value).alias("n"), q.alias("_q")).select(*group, "n", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"))
    return got.join(gini(values, group, value), group)


def climatology(monthly: DataFrame, unit: list[str], value: str) -> DataFrame:
    """(unit, month, mean, share): mean by calendar month, and its share of the twelve, NULL if they sum to 0."""
    means = monthly.groupBy(*unit, (F.col("yyyymm") % 100).cast("int").alias("month")).agg(F.avg(value).alias("mean"))
    return means.withColumn("share", F.try_divide(F.col("mean"), F.sum("mean").over(Window.partitionBy(*unit))))


def seasonality(clim: DataFrame, unit: list[str], tiny: float = 1e-15) -> DataFrame:
    """Peak month (earliest of ties), circular mean month and direction, resultant length and status.

    Needs the 12 months of a unit; status is ok, incomplete, zero_total or undirected.
    """
    c, s = F.sum(F.col("share") * F.cos(month_angle("month"))), F.sum(F.col("share") * F.sin(month_angle("month")))
    got = clim.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n"), F.sum("mean").alias("_t"), c.alias("_c"), s.alias("_s"), F.min_by("month", F.struct(-F.col("mean"), F.col("month"))).alias("_peak"))
    r = F.hypot("_c", "_s")
    status = F.when(F.col("_n") != 12, "incomplete").when(F.col("_t") == 0, "zero_total").when(r <= tiny, "undirected").otherwise("ok")
    theta = F.pmod(F.atan2("_s", "_c"), F.lit(2 * math.pi))
    month = 1 + 12 * theta / (2 * math.pi)
    directed = status == "ok"
    return got.select(
        *unit, F.when(status.isin("ok", "undirected"), F.col("_peak")).alias("peak_month"), F.when(directed, theta).alias("direction"),
        F.when(directed, F.when(month > 12, month - 12).otherwise(month)).alias("circular_mean_month"), F.when(status.isin("ok", "undirected"), r).alias("resultant_length"), status.alias("status"),
    )


def departure(child: DataFrame, parent: DataFrame, key: str, child_value: str, parent_value: str) -> DataFrame:
    """Child rate less its parent's own rate (never the mean of the children)."""
    p = parent.select(key, F.col(parent_value).alias("parent_rate"))
    return child.join(p, key).withColumn("departure", F.col(child_value) - F.col("parent_rate"))


def four_states(panel: DataFrame, left: str, right: str, parent: str, states: tuple = ("both", "left_only", "right_only", "neither")) -> DataFrame:
    """Counts and shares of the four states overall and by parent, those that never occur included, in the given order."""
    state = F.when((F.col(left) == 1) & (F.col(right) == 1), states[0]).when((F.col(left) == 1) & (F.col(right) == 0), states[1]).when((F.col(left) == 0) & (F.col(right) == 1), states[2]).when((F.col(left) == 0) & (F.col(right) == 0), states[3])
    rows = panel.select(F.col(parent).alias("parent"), state.alias("state")).where("state is not null")
    counted = rows.groupingSets([["state"], ["parent", "state"]], "parent", "state").agg(F.count(F.lit(1)).alias("n"), F.grouping("parent").alias("_all"))
    scopes = counted.select(F.when(F.col("_all") == 1, "overall").otherwise("parent").alias("scope"), "parent", "state", "n")
    whole = scopes.groupBy("scope", "parent").agg(F.sum("n").alias("denominator")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    grid = whole.withColumn("state", F.element_at(F.array(*map(F.lit, states)), F.col("_i") + 1))
    met = grid.alias("g").join(scopes.alias("s"), (F.col("g.scope") == F.col("s.scope")) & F.col("g.parent").eqNullSafe(F.col("s.parent")) & (F.col("g.state") == F.col("s.state")), "left")
    n = F.coalesce(F.col("s.n"), F.lit(0))
    return met.select("g.scope", "g.parent", "g.state", F.col("g._i").alias("state_order"), n.alias("n"), "g.denominator", (n / F.col("g.denominator")).alias("proportion"))


def mismatch_by_unit(panel: DataFrame, unit: str, left: str, right: str) -> DataFrame:
    """Months, months where the left is positive, of those the ones that the right misses, and their share."""
    pos = F.count_if(F.col(left) == 1)
    miss = F.count_if((F.col(left) == 1) & (F.col(right) == 0))
    return panel.groupBy(unit).agg(F.count(F.lit(1)).alias("months"), pos.alias("positive"), miss.alias("mismatched"), F.try_divide(miss, pos).alias("share"))


def support_audit(panel: DataFrame, value: str, supported: Column, key: str = "yyyymm") -> DataFrame:
    v = F.col(value)
    return panel.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(supported).alias("supported"), F.count_if(~supported).alias("structural_missing"),
        F.count_if(supported & v.isNull()).alias("numeric_missing"), F.count_if(supported & (v == 0)).alias("zero"), F.count_if(supported & (v > 0)).alias("positive"),
    )


def separation(rows: DataFrame, outcome: str, factors: list[str]) -> DataFrame:
    """Outcome counts by factor level; a level with only one outcome is completely separated."""
    long = rows.select(F.col(outcome).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])).alias("f")).select("y", "f.*")
    got = long.groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("y1"), F.count_if(F.col("y") == 0).alias("y0"))
    return got.withColumns({"prevalence": F.col("y1") / F.col("n"), "separated": (F.col("y1") == 0) | (F.col("y0") == 0)})


def cluster_sizes(rows: DataFrame, cluster: str, outcome: str) -> DataFrame:
    per = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("s"))
    return per.agg(F.count(F.lit(1)).alias("clusters"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.count_if(F.col("s") == F.col("n")).alias("all_one"), F.count_if(F.col("s") == 0).alias("all_zero"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n, mean, sd (n - 1), least, quartiles, most of each column, in one pass."""
    stats = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = rows.select(stats).select("s.*").groupBy("variable").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), q.alias("_q"), F.max("v").alias("most"))
    return got.select("variable", "n", "mean", "sd", "least", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"), "most")


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs, in one aggregate."""
    pairs = [(a, b) for a in columns for b in columns]
    one = rows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def vif(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix, a few numbers on the driver."""
    import numpy as np

    at = {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns))
    for r in correlations(rows, columns).collect():
        m[at[r["a"]], at[r["b"]]] = r["r"] if r["a"] != r["b"] else 1.0
    inv = np.linalg.inv(m)
    return rows.sparkSession.createDataFrame([(c, float(inv[i, i])) for c, i in at.items()], "variable string, vif double")


def rate_of(total: str, support: str) -> Column:
    return safe_divide(total, support, 100.0)
