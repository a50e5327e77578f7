"""Consolidation of source families on a spine, and the derived columns of the wide panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import flag_of, positive_flag, safe_divide

KEY = ("level", "unit_id", "yyyymm")
#: Fixed values of the panel contract.
SUPPORT_START = 201201
SENSORS = ("modis", "viirs")
FAMILIES = ("ba2001", "ba2012")
IDENTITY = ("run_id", "schema_version", "level", "unit_id", "unit_code", "unit_name", "parent_level", "parent_id", "parent_code", "parent_name", "yyyymm", "year", "month")
AF_METRICS = ("det_low", "det_nominal", "det_high", "det_all", "det_nh", "pct_high_conf", "days_active_nh", "streak_max_nh", "frp_active_days", "frp_sum_daily_max_mw", "frp_mean_mw", "frp_p95_daily_max_mw")
BA_METRICS = ("ba_km2", "burned_pixel_count", "ba_any", "aoi_area_land_km2", "burnable_km2_union", "burnable_km2_annual", "burned_frac_union", "burned_frac_annual", "zero_union_den_flag", "zero_annual_den_flag")
#: (name, left, left value, right, right value)
CONCORDANCE = (
    ("ba_any_ba2001_and_viirs_primary_any_flag", "modis_ba_any_ba2001", 1, "viirs_det_primary_any", 1),
    ("ba_any_ba2012_and_viirs_primary_any_flag", "modis_ba_any_ba2012", 1, "viirs_det_primary_any", 1),
    ("ba_any_ba2001_and_modis_primary_any_flag", "modis_ba_any_ba2001", 1, "modis_det_primary_any", 1),
    ("ba_any_ba2012_and_modis_primary_any_flag", "modis_ba_any_ba2012", 1, "modis_det_primary_any", 1),
    ("ba_any_ba2001_without_viirs_primary_flag", "modis_ba_any_ba2001", 1, "viirs_det_primary_any", 0),
    ("ba_any_ba2012_without_viirs_primary_flag", "modis_ba_any_ba2012", 1, "viirs_det_primary_any", 0),
    ("viirs_primary_without_ba_any_ba2001_flag", "viirs_det_primary_any", 1, "modis_ba_any_ba2001", 0),
    ("viirs_primary_without_ba_any_ba2012_flag", "viirs_det_primary_any", 1, "modis_ba_any_ba2012", 0),
    ("viirs_primary_any_and_modis_primary_any_flag", "viirs_det_primary_any", 1, "modis_det_primary_any", 1),
)
PRESENCE = ("af_modis_source_present", "af_viirs_source_present", "ba2001_source_present", "ba2012_source_present")


def _rates() -> dict[str, Column]:
    """Every rate of the panel, family by family: area per 100 km2, detections per 100 km2, frp per km2."""
    out = {}
    for fam in FAMILIES:
        for den in ("union", "annual"):
            out[f"modis_ba_km2_per100km2_{den}_{fam}"] = safe_divide(f"modis_ba_km2_{fam}", f"modis_burnable_km2_{den}_{fam}", 100.0)
    for s in SENSORS:
        for fam in FAMILIES:
            for den in ("union", "annual"):
                out[f"{s}_det_primary_per100km2_burnable_{den}_{fam}"] = safe_divide(f"{s}_det_primary", f"modis_burnable_km2_{den}_{fam}", 100.0)
    for s in SENSORS:
        for fam in FAMILIES:
            for den in ("union", "annual"):
                out[f"{s}_frp_sum_daily_max_mw_per_km2_burnable_{den}_{fam}"] = safe_divide(f"{s}_frp_sum_daily_max_mw", f"modis_burnable_km2_{den}_{fam}")
    for s in SENSORS:
        out[f"{s}_det_primary_per_active_day"] = safe_divide(f"{s}_det_primary", f"{s}_days_active_nh")
        out[f"{s}_frp_sum_daily_max_mw_per_active_day"] = safe_divide(f"{s}_frp_sum_daily_max_mw", f"{s}_frp_active_days")
        out[f"{s}_frp_sum_daily_max_mw_per_primary_det"] = safe_divide(f"{s}_frp_sum_daily_max_mw", f"{s}_det_primary")
    return out


def _primary(s: str) -> list[str]:
    return [f"{s}_det_primary", f"{s}_det_nh_share_of_all", f"{s}_det_primary_any"]


def panel_columns() -> list[str]:
    """The 111 columns in contract order."""
    support = ["viirs_supported_flag", "ba2012_supported_flag", "full_overlap_supported_flag"]
    tail = ["row_in_canonical_spine", "merge_key_complete_flag", "merge_duplicate_resolved_flag", "viirs_structural_missing_flag", "ba2012_structural_missing_flag", "merge_note"]
    return [
        *IDENTITY, *[f"{s}_{m}" for s in SENSORS for m in AF_METRICS], *[f"modis_{m}_{fam}" for fam in FAMILIES for m in BA_METRICS],
        *_primary("modis"), *_primary("viirs"), *_rates(), *support, *[c[0] for c in CONCORDANCE], *PRESENCE, *tail,
    ]


def suffix_family(df: DataFrame, family: str, keep: tuple = KEY) -> DataFrame:
    """A family's columns under its suffix, before the join, with its presence column."""
    present = {"modis": "af_modis_source_present", "viirs": "af_viirs_source_present"}.get(family, f"{family}_source_present")
    out = df if family in SENSORS else df.withColumnsRenamed({c: f"{c}_{family}" for c in df.columns if c not in keep})
    return out.withColumn(present, F.lit(1).cast("long"))


def unique_violations(df: DataFrame, key: list[str], sample: int = 20) -> DataFrame:
    """Keys that occur more than once, the first ``sample`` of them."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(*key).limit(sample)


def audited_left_join(left: DataFrame, right: DataFrame, key: list[str], audit: bool = True) -> DataFrame:
    """One-to-one left join. Raises if a key repeats on either side (``audit``) or a column would occur twice."""
    twice = (set(left.columns) & set(right.columns)) - set(key)
    if twice:
        raise ValueError(f"columns on both sides: {sorted(twice)}")
    if audit:
        for side, df in (("left", left), ("right", right)):
            bad = unique_violations(df, key).collect()
            if bad:
                raise ValueError(f"{side}: repeated keys, e.g. {[tuple(r)[:-1] for r in bad[:3]]}")
    return left.join(right, key, "left")


def level_panel(spine: DataFrame, families: dict[str, DataFrame], audit: bool = True) -> DataFrame:
    """Successive audited joins of the families to the spine; all on the same key, so Spark shuffles each side once."""
    prepared = [suffix_family(df, name) for name, df in families.items()]
    out = reduce(lambda a, b: audited_left_join(a, b, list(KEY), audit), prepared, spine)
    return out.withColumns({p: F.coalesce(F.col(p), F.lit(0)).cast("long") for p in PRESENCE if p in out.columns})


def derive_panel(panel: DataFrame, run_id: str, schema_version: str = "1", support_start: int = SUPPORT_START) -> DataFrame:
    """The 111 columns from a joined panel: rates, flags, notes; unsupported months are NULL at the end, after all derivations."""
    v = F.col("yyyymm") >= support_start
    b = F.col("yyyymm") >= support_start
    out = panel.withColumns({"run_id": F.lit(run_id), "schema_version": F.lit(schema_version)})
    first = {}
    for s in SENSORS:
        first[f"{s}_det_primary"] = F.col(f"{s}_det_nh")
        first[f"{s}_det_nh_share_of_all"] = safe_divide(f"{s}_det_nh", f"{s}_det_all")
        first[f"{s}_det_primary_any"] = positive_flag(f"{s}_det_nh", v if s == "viirs" else None)
    out = out.withColumns(first)
    missing = lambda c: F.coalesce(F.col(c), F.lit(0)) != 1
    note = F.concat_ws(
        ";", F.when(missing("af_modis_source_present"), "missing_modis_af_source"), F.when(v & missing("af_viirs_source_present"), "missing_viirs_af_source_in_supported_window"),
        F.when(missing("ba2001_source_present"), "missing_ba2001_source"), F.when(b & missing("ba2012_source_present"), "missing_ba2012_source_in_supported_window"),
    )
    one = F.lit(1).cast("long")
    out = out.withColumns(_rates() | {name: flag_of((F.col(x) == xv) & (F.col(y) == yv), [x, y]) for name, x, xv, y, yv in CONCORDANCE} | {
        "viirs_supported_flag": v.cast("long"), "ba2012_supported_flag": b.cast("long"), "full_overlap_supported_flag": (v & b).cast("long"),
        "viirs_structural_missing_flag": (~v).cast("long"), "ba2012_structural_missing_flag": (~b).cast("long"), "row_in_canonical_spine": one,
        "merge_key_complete_flag": reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in KEY]).cast("long"), "merge_duplicate_resolved_flag": F.lit(0).cast("long"), "merge_note": note,
    })
    viirs = [c for c in panel_columns() if c.startswith("viirs_") and c not in ("viirs_supported_flag", "viirs_structural_missing_flag")] + [c[0] for c in CONCORDANCE if "viirs" in c[0]]
    ba2012 = [c for c in panel_columns() if "ba2012" in c and c not in ("ba2012_supported_flag", "ba2012_structural_missing_flag", "ba2012_source_present")]
    out = out.withColumns({c: F.when(v, F.col(c)) for c in dict.fromkeys(viirs)})
    return out.withColumns({c: F.when(b, F.col(c)) for c in ba2012}).select(*panel_columns())


def presence_diff(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only: side is ``missing`` (expected only) or ``extra``."""
    e, a = expected.select(*key).distinct().withColumn("_e", F.lit(1)), actual.select(*key).distinct().withColumn("_a", F.lit(1))
    side = F.when(F.col("_a").isNull(), "missing").otherwise("extra")
    return e.join(a, key, "full").where("_e is null or _a is null").select(*key, side.alias("side"))


def reconcile(children: DataFrame, parents: DataFrame, parent_key: list[str], fields: list[str], atol: float = 1e-8, rtol: float = 1e-10) -> DataFrame:
    """One row a field: compared, outside the tolerance, of different null state, largest absolute and relative difference. A sum of NULLs only is NULL."""
    sums = children.groupBy(*parent_key).agg(*[F.sum(f).alias(f"c_{f}") for f in fields])
    both = sums.join(parents.select(*parent_key, *[F.col(f).alias(f"p_{f}") for f in fields]), parent_key, "full")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"c_{f}").cast("double").alias("a"), F.col(f"p_{f}").cast("double").alias("b")) for f in fields])).alias("r")).select("r.*")
    d = F.abs(F.col("a") - F.col("b"))
    return long.groupBy("field").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("compared"), F.count_if(d > atol + rtol * F.abs("b")).alias("mismatched"),
        F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("null_state"), F.max(d).alias("max_abs"), F.max(F.when(F.col("b") != 0, d / F.abs("b"))).alias("max_rel"),
    )


def dimension_join(facts: DataFrame, dim: DataFrame, key: list[str], most_rows: int = 100_000) -> DataFrame:
    """Many-to-one join that raises on a fact without its dimension row. The dimension is broadcast only if a count shows it within the bound."""
    small = dim.limit(most_rows + 1).count() <= most_rows
    side = F.broadcast(dim.withColumn("_d", F.lit(1))) if small else dim.withColumn("_d", F.lit(1))
    out = facts.join(side, key, "left")
    found = F.when(F.col("_d").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no dimension row for"), *[F.col(k).cast("string") for k in key])).cast("int")).otherwise(F.col("_d"))
    return out.withColumn("_d", found).where("_d = 1").drop("_d")


def identity_mismatches(rows: DataFrame, canonical: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Rows whose identity fields differ from the canonical ones; NULL equals NULL."""
    c = canonical.select(*key, *[F.col(f).alias(f"_c_{f}") for f in fields])
    bad = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(F.col(f"_c_{f}")) for f in fields])
    return rows.join(c, key, "left").where(bad).select(*key, *fields, *[F.col(f"_c_{f}").alias(f"expected_{f}") for f in fields])


def members(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def non_members(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent row (many to one)."""
    p = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).select(child_key).distinct().join(p, child_key, "left_anti")
