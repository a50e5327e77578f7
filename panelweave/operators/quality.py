"""Rules that return evidence, and their hard-failing form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = ("pass", "warn", "fail")


def check_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of all rules in one pass; a rule that is NULL for a row does not count against it."""
    one = rows.agg(*[F.count_if(~F.coalesce(r, F.lit(True))).alias(f"r{i}") for i, r in enumerate(rules.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(rules)])).alias("r")).select("r.*")


def require(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows, if no rule is violated; else raises with the counts."""
    bad = [(r["rule"], r["violations"]) for r in check_rules(rows, rules).where("violations > 0").collect()]
    if bad:
        raise ValueError(f"violated: {bad}")
    return rows


def active_fire_rules(s: str) -> dict[str, Column]:
    c = lambda m: F.col(f"{s}_{m}")
    counts = ["det_low", "det_nominal", "det_high", "det_all", "det_nh"]
    return {f"{m}_not_negative": c(m) >= 0 for m in counts} | {
        "pct_in_range": c("pct_high_conf").between(0, 100), "all_is_sum": c("det_all") == c("det_low") + c("det_nominal") + c("det_high"), "nh_is_sum": c("det_nh") == c("det_nominal") + c("det_high"),
    }


def burned_area_rules(suffix: str = "") -> dict[str, Column]:
    c = lambda m: F.col(f"modis_{m}{suffix}")
    out = {f"{f}_binary": c(f).isin(0, 1) for f in ("ba_any", "zero_union_den_flag", "zero_annual_den_flag")}
    for kind in ("union", "annual"):
        out[f"frac_{kind}"] = F.when(c(f"burnable_km2_{kind}") > 0, c(f"burned_frac_{kind}").between(0, 1))
    return out | {"any_iff_area": (c("ba_any") == 1) == (c("ba_km2") > 0)}


def time_rules(start: int, end: int) -> dict[str, Column]:
    return {"month": F.col("month").between(1, 12), "year_month_agree": F.col("yyyymm") == F.col("year") * 100 + F.col("month"), "in_window": F.col("yyyymm").between(start, end)}


def final_panel_rules(support_start: int = 201201) -> dict[str, Column]:
    """Support flags agree with the month, unsupported columns are NULL, flags are 0, 1 or NULL, sources are present where expected."""
    from .consolidate import CONCORDANCE, panel_columns

    v = F.col("yyyymm") >= support_start
    rules = {"viirs_flag": F.col("viirs_supported_flag") == v.cast("long"), "ba2012_flag": F.col("ba2012_supported_flag") == v.cast("long"), "viirs_missing_flag": F.col("viirs_structural_missing_flag") == (~v).cast("long")}
    for c in panel_columns():
        if (c.startswith("viirs_") and "supported" not in c and "structural" not in c) or ("ba2012" in c and c not in ("ba2012_supported_flag", "ba2012_structural_missing_flag", "ba2012_source_present")):
            rules[f"null_before_support:{c}"] = v | F.col(c).isNull()
    rules |= {f"binary:{c[0]}": F.col(c[0]).isin(0, 1) for c in CONCORDANCE}
    return rules | {"modis_present": F.col("af_modis_source_present") == 1, "viirs_present": ~v | (F.col("af_viirs_source_present") == 1), "key_complete": F.col("merge_key_complete_flag") == 1}


def contract_rules(fields: list[dict]) -> dict[str, Column]:
    """Rules of field specifications: dtype, nullability, domain, range, finiteness.

    A field has name, dtype (string, integer, number), nullable, and optionally domain, low, high, support (a Column under which it is required).
    """
    out: dict[str, Column] = {}
    for f in fields:
        c = F.col(f["name"])
        if not f.get("nullable", True):
            out[f"{f['name']}:required"] = c.isNotNull()
        elif f.get("support") is not None:
            out[f"{f['name']}:required_when_supported"] = ~f["support"] | c.isNotNull()
        if f.get("domain"):
            out[f"{f['name']}:domain"] = c.isin(*f["domain"])
        if f.get("low") is not None:
            out[f"{f['name']}:low"] = c >= f["low"]
        if f.get("high") is not None:
            out[f"{f['name']}:high"] = c <= f["high"]
        if f["dtype"] == "number":
            out[f"{f['name']}:finite"] = ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
        if f["dtype"] == "integer":
            out[f"{f['name']}:whole"] = c % 1 == 0
    return out


def require_columns(df: DataFrame, expected: list[str], ordered: bool = True) -> DataFrame:
    """Raises unless the columns are exactly those expected, in order if asked."""
    missing, extra = [c for c in expected if c not in df.columns], [c for c in df.columns if c not in expected]
    if missing or extra or (ordered and df.columns != list(expected)):
        raise ValueError(f"missing {missing}, extra {extra}" + ("" if missing or extra else ", or another order"))
    return df


def worst(statuses: Column) -> Column:
    """The worst of an array of pass, warn and fail."""
    rank = F.array_max(F.transform(statuses, lambda s: F.when(s == "fail", 2).when(s == "warn", 1).otherwise(0)))
    return F.element_at(F.array(*map(F.lit, STATUS)), F.coalesce(rank, F.lit(0)) + 1)


def issues(rows: DataFrame, key: str, statuses: dict[str, Column]) -> DataFrame:
    """(key, metric, status) of every metric that is not pass or na."""
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("status")) for n, c in statuses.items()])).alias("i")).select(key, "i.*")
    return long.where(F.col("status").isin("warn", "fail"))


def qa_summary(rows: DataFrame, statuses: dict[str, Column]) -> DataFrame:
    """One row a metric: counts of each status and the worst."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("status")) for n, c in statuses.items()])).alias("i")).select("i.*")
    return long.groupBy("metric").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in (*STATUS, "na")], worst(F.collect_set("status")).alias("worst"))


def share_summary(rows: DataFrame, share: str, warn_below: float = 0.95, fail_below: float = 0.8) -> DataFrame:
    """Count, least, mean, most; those in [fail, warn) and those below fail."""
    s = F.col(share)
    return rows.agg(F.count(s).alias("n"), F.min(s).alias("least"), F.avg(s).alias("mean"), F.max(s).alias("most"), F.count_if((s >= fail_below) & (s < warn_below)).alias("warn"), F.count_if(s < fail_below).alias("fail"))


def relative_area_summary(rows: DataFrame, a: str, b: str, warn_above: float = 0.01, fail_above: float = 0.05) -> DataFrame:
    d = F.abs(F.col(a) - F.col(b)) / F.abs(F.col(b))
    return rows.select(F.when(F.col(b) != 0, d).alias("d")).agg(F.count("d").alias("n"), F.max("d").alias("most"), F.avg("d").alias("mean"), F.count_if((F.col("d") > warn_above) & (F.col("d") <= fail_above)).alias("warn"), F.count_if(F.col("d") > fail_above).alias("fail"))


def month_series_rules(rows: DataFrame, unit: str, months: int = 12) -> DataFrame:
    """Units whose number of distinct months is another than asked."""
    return rows.groupBy(unit).agg(F.countDistinct("month").alias("months"), F.count(F.lit(1)).alias("rows")).where((F.col("months") != months) | (F.col("rows") != months))


def share_sum_rules(rows: DataFrame, group: list[str], share: str, tolerance: float = 1e-9) -> DataFrame:
    """Groups whose shares do not sum to 1 within the tolerance."""
    return rows.groupBy(*group).agg(F.sum(share).alias("total")).where(F.abs(F.col("total") - 1) > tolerance)


def constant_rules(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Groups in which a column that should be constant is not."""
    got = rows.groupBy(*group).agg(*[F.countDistinct(c).alias(c) for c in columns])
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c) > 1)
    return got.where(bad)
