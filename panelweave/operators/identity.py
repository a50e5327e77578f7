"""Unit identity: text keys, hierarchy, carried assignments, exclusions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_LIKE = ("", "null", "none", "nan", "undefined")


def text_key(x) -> Column:
    """Upper-case letters and digits only; null-like tokens are empty."""
    t = F.trim(F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit("")))
    return F.when(F.lower(t).isin(*NULL_LIKE), F.lit("")).otherwise(F.upper(F.regexp_replace(t, "[^A-Za-z0-9]", "")))


def first_usable(*columns) -> Column:
    return F.coalesce(*[F.when(text_key(c) != "", F.trim(c if isinstance(c, Column) else F.col(c))) for c in columns])


def bind_identity(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Binds rows (raw_id, raw_code, raw_name) to units (unit_id, unit_code, unit_name) by id, else code, else name, with the source of the match."""
    out = rows
    for k, (raw, col) in enumerate((("raw_id", "unit_id"), ("raw_code", "unit_code"), ("raw_name", "unit_name"))):
        side = units.select(text_key(col).alias(f"_k{k}"), F.col("unit_id").alias(f"_u{k}")).where(F.col(f"_k{k}") != "").dropDuplicates([f"_k{k}"])
        out = out.join(side, text_key(raw) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
    source = F.when(F.col("_u0").isNotNull(), "id").when(F.col("_u1").isNotNull(), "code").when(F.col("_u2").isNotNull(), "name").otherwise("unresolved")
    return out.select(*rows.columns, F.coalesce("_u0", "_u1", "_u2").alias("unit_id"), source.alias("match_source"))


def exclusion_reasons(unit: str = "unit_id", parent: str = "parent_id", area: str = "land_area") -> Column:
    return F.concat_ws("|", F.when(F.col(unit).isNull(), "unresolved_identity"), F.when(F.col(parent).isNull(), "unresolved_parent"), F.when(F.coalesce(F.col(area), F.lit(0.0)) <= 0, "zero_land_intersection"))


def hierarchy_roots(units: DataFrame, unit: str = "unit_id", parent: str = "parent_id", most_levels: int = 16) -> DataFrame:
    """(unit, root_id, depth): the top ancestor of each unit, doubling the steps each round; a cycle or a dangling parent raises."""
    ids = units.select(F.col(unit).alias("_p"))
    dangling = units.where(F.col(parent).isNotNull()).join(ids, F.col(parent) == F.col("_p"), "left_anti")
    if not dangling.isEmpty():
        raise ValueError("a parent that is no unit")
    walk = units.select(F.col(unit).alias("u"), F.coalesce(F.col(parent), F.col(unit)).alias("r"), F.col(parent).isNotNull().cast("int").alias("d"))
    for _ in range(max(1, most_levels.bit_length())):
        up = walk.select(F.col("u").alias("r"), F.col("r").alias("r2"), F.col("d").alias("d2"))
        walk = walk.join(up, "r").select("u", F.col("r2").alias("r"), (F.col("d") + F.col("d2")).alias("d"))
    tops = units.where(F.col(parent).isNull()).select(F.col(unit).alias("r"))
    if not walk.join(tops, "r", "left_anti").isEmpty():
        raise ValueError("a cycle, or more levels than asked")
    return walk.select(F.col("u").alias(unit), F.col("r").alias("root_id"), F.col("d").alias("depth"))


def carry_legacy(rows: DataFrame, legacy: dict[str, str], current: str) -> DataFrame:
    """Keeps earlier assignment columns under legacy names, with presence and agreement (NULL where there was none)."""
    out = rows.withColumnsRenamed(legacy)
    old = F.col(next(iter(legacy.values())))
    return out.withColumns({"legacy_present": old.isNotNull(), "legacy_match": F.when(old.isNotNull(), old.eqNullSafe(F.col(current))), "legacy_disagrees": F.when(old.isNotNull(), ~old.eqNullSafe(F.col(current)))})


def unit_universe(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Both levels in one table; the coarse has NULL parents."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [coarse, fine])


def resolve_role(contract: dict, path: str) -> str:
    """The physical column of a dotted role, e.g. ``rq3.count``."""
    at = contract
    for part in path.split("."):
        if not isinstance(at, dict) or part not in at:
            raise KeyError(f"undeclared role {path!r}")
        at = at[part]
    return at


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Registers views, so that everything is open to spark.sql."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
