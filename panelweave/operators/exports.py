"""Exports, their manifests and validators, and whole result bundles."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T
from . import geometry as G
from . import publish as K
from . import quality as Q
from . import rates as R
from . import spatial as S
from . import trend as D
from .consolidate import presence_diff

# --- sinks ----------------------------------------------------------------------------------------


def universe_rows(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Both levels with areas as text of six decimals, the coarse first; parents of the coarse are NULL."""
    both = coarse.withColumn("_l", F.lit(0)).unionByName(fine.withColumn("_l", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("area_sqkm", F.format_string("%.6f", F.col("area_sqkm").cast("double"))).orderBy("_l", "unit_id").drop("_l")


def crosswalk_rows(assigned: DataFrame, zones: DataFrame, fine_id: str, zone_id: str) -> DataFrame:
    """(fine unit, zone, zone attributes, share) of every assigned unit."""
    return assigned.where(F.col(zone_id).isNotNull()).join(zones, zone_id).select(fine_id, zone_id, *[c for c in zones.columns if c != zone_id], "share")


def field_crosswalk(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """(field, short_field) of a shapefile; raises on names that shapefiles cannot hold."""
    bad = T.check_field_names(list(names.values()))
    if bad:
        raise ValueError("; ".join(bad))
    return spark.createDataFrame(sorted(names.items()), "field string, short_field string")


def write_partitioned(panel: DataFrame, path: str, by: list[str], sort: list[str]) -> None:
    """One folder a partition value (sensor, level, top ancestor), rows sorted within; dealt by the values and the sort key, so a large value is many files."""
    panel.repartitionByRange(*by, *sort).sortWithinPartitions(*by, *sort).write.partitionBy(*by).mode("errorifexists").parquet(path)


def qa_tables(joined: DataFrame, unit: str, in_mask: str) -> dict[str, DataFrame]:
    """Unmatched points, points outside the mask, and a one-row summary."""
    one = joined.agg(F.count(F.lit(1)).alias("points"), F.count(unit).alias("matched"), F.count_if(~F.col(in_mask)).alias("outside"))
    return {"unmatched": joined.where(F.col(unit).isNull()), "outside": joined.where(~F.col(in_mask)), "summary": one.withColumn("matched_rate", F.try_divide(F.col("matched"), F.col("points")))}


def materialise(authorities: dict[str, tuple[DataFrame, list[str]]], root: str) -> list[dict]:
    """Writes named results (frame, sort keys) as byte-stable CSV and a manifest with their digests; what is there already is an error."""
    records = []
    for name, (df, sort) in sorted(authorities.items()):
        records.append({"name": name, **T.write_output(f"{name}.csv", T.write_csv_bytes(df, sort, df.columns), root)})
    T.write_output("manifest.json", T.stable_json(records).encode(), root)
    return records


def load_materialised(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a manifest; a file that is absent or has another digest raises."""
    out = {}
    for r in T.read_json(spark, f"{root}/manifest.json"):
        data = T.read_bytes(spark, f"{root}/{r['path']}")
        if hashlib.sha256(data).hexdigest() != r["sha256"]:
            raise ValueError(f"{r['path']}: another digest")
        out[r["name"]] = T.read_csv_strict(spark, f"{root}/{r['path']}")
    return out


# --- validators -----------------------------------------------------------------------------------


def validate_manifest(manifest: dict, required: dict) -> list[str]:
    """What a manifest lacks or has otherwise than required."""
    return [f"{k}: {manifest.get(k)!r} is not {v!r}" for k, v in sorted(required.items()) if manifest.get(k) != v]


def validate_audit(audit: DataFrame, expected: dict[str, int]) -> list[str]:
    """Problems of a key audit (level, actual_rows, duplicate_key_rows)."""
    rows = {r["level"]: r for r in audit.collect()}
    out = [f"{k}: no audit" for k in expected if k not in rows]
    return out + [f"{k}: {r['actual_rows']} rows, {r['duplicate_key_rows']} repeated" for k, r in rows.items() if k in expected and (r["actual_rows"] != expected[k] or r["duplicate_key_rows"])]


def validate_inputs(rules_violated: int, digests: dict[str, str], recorded: dict[str, str]) -> dict:
    """Scientific validity and byte identity, reported apart."""
    return {"scientific": "PASS" if rules_violated == 0 else "FAIL", "bytes": {k: "MATCH" if digests.get(k) == v else "DIFFERENT" for k, v in recorded.items()}}


def sample_schema_problems(df: DataFrame, columns: list[str], fields: list[dict], rows: int = 200) -> DataFrame:
    """Exact column order, then the field rules over the first ``rows`` rows (the check is of a sample by definition)."""
    Q.require_columns(df, columns)
    return Q.check_rules(df.limit(rows), Q.contract_rules(fields)).where("violations > 0")


STATES = ("prepared", "run", "validated", "integrated")


def advance(state: str, to: str) -> str:
    """The next state of a run; only one step forward is allowed."""
    if STATES.index(to) != STATES.index(state) + 1:
        raise ValueError(f"{state} does not lead to {to}")
    return to


def registries_agree(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    return presence_diff(a, b, [key])


# --- bundles --------------------------------------------------------------------------------------


def projection_sensitivity(fine: DataFrame, coarse: DataFrame, other_fine: DataFrame, other_coarse: DataFrame, fine_id: str, coarse_id: str) -> DataFrame:
    """Assignments under two projections: (unit, zone, other zone, share, other share, same)."""
    a = G.assign_by_share(G.overlay(fine, coarse, fine_id, coarse_id), fine, fine_id, coarse_id)
    b = G.assign_by_share(G.overlay(other_fine, other_coarse, fine_id, coarse_id), other_fine, fine_id, coarse_id)
    other = b.select(fine_id, F.col(coarse_id).alias("other_zone"), F.col("share").alias("other_share"))
    return a.join(other, fine_id, "full").select(fine_id, coarse_id, "other_zone", "share", "other_share", F.col(coarse_id).eqNullSafe(F.col("other_zone")).alias("same"))


def population_table(config: list[dict], spark: SparkSession) -> DataFrame:
    """The populations of a study as declared in its configuration."""
    keys = ("population_id", "units", "rows", "start", "end", "rule")
    return spark.createDataFrame([tuple(c.get(k) for k in keys) for c in config], "population_id string, units long, rows long, start string, end string, rule string")


def spatial_bundle(values: DataFrame, edges: DataFrame, unit: str, value: str, permutations: int = 9999, seed: int = 20260822) -> DataFrame:
    """One national row and one row a unit: statistics, p, q and class."""
    spark = values.sparkSession
    g = S.moran_permutation(values, edges, unit, value, permutations, seed)
    national = spark.createDataFrame([(g["moran_i"], g["p"], permutations, seed)], "moran_i double, permutation_p double, permutations int, seed int")
    local = S.local_moran_permutation(values, edges, unit, value, permutations, seed).select(unit, "local_i", "raw_p", "bh_q", "class")
    return K.union_records({"global": national, "local": local})


def seasonal_bundle(monthly: DataFrame, unit: list[str], value: str, support: str) -> dict[str, DataFrame]:
    """Annual rates, unit summaries, climatology and seasonality in one go."""
    annual = R.annual_rate(monthly, unit, value, support)
    clim = R.climatology(monthly, unit, value)
    return {"annual": annual, "summary": R.unit_summary(annual, unit), "climatology": clim, "seasonality": R.seasonality(clim, unit)}


def trend_bundle(annual: DataFrame, unit: list[str], alpha: float = 0.05, replications: int = 9999, seed: int = 20260822) -> DataFrame:
    """Slope, components, permutation p and q of each unit's complete years."""
    s = annual.where("status = 'ok'").select(*unit, "year", "rate")
    parts = D.sen_slope(s, unit, "year", "rate").join(D.mk_components(s, unit, "year", "rate").drop("t"), unit).join(D.mk_permutation(s, unit, "year", "rate", replications, seed), unit)
    tested = D.benjamini_hochberg(parts, "p", alpha=alpha)
    return parts.join(tested.select(*unit, "bh_q", "bh_rejected"), unit, "left")
