"""Files to and from an external scan-statistic program; clusters are never computed here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_period, period_months, scan_date

#: Fixed values of the parameter file.
MODELS = {"poisson": 0, "permutation": 2}


def cases(panel: DataFrame, locations: DataFrame, unit: str, count: str) -> DataFrame:
    """(location_id, cases, date, yyyymm): positive whole counts only."""
    rows = panel.where((F.col(count) > 0) & (F.col(count) % 1 == 0)).join(locations.select(unit, "location_id"), unit)
    return rows.select("location_id", F.col(count).cast("long").alias("cases"), scan_date("yyyymm").alias("date"), "yyyymm")


def populations(panel: DataFrame, locations: DataFrame, unit: str, exposure: str) -> DataFrame:
    rows = panel.join(locations.select(unit, "location_id"), unit)
    return rows.select("location_id", scan_date("yyyymm").alias("date"), F.col(exposure).cast("double").alias("population"), "yyyymm")


def time_index(start: int, end: int, spark: SparkSession) -> DataFrame:
    """(yyyymm, time_index, date) of a window, counted from 1."""
    from .panel import months_between

    base = start // 100 * 12 + start % 100 - 1
    m = months_between(spark, start, end)
    return m.select("yyyymm", (F.floor(F.col("yyyymm") / 100) * 12 + F.col("yyyymm") % 100 - base).alias("time_index"), scan_date("yyyymm").alias("date"))


def case_lines(rows: DataFrame) -> DataFrame:
    return rows.select("yyyymm", "location_id", F.format_string("%d %d %s", "location_id", "cases", "date").alias("value"))


def population_lines(rows: DataFrame) -> DataFrame:
    return rows.select("yyyymm", "location_id", F.format_string("%d %s %.9f", "location_id", "date", "population").alias("value"))


def coordinate_lines(rows: DataFrame) -> DataFrame:
    return rows.select("location_id", F.format_string("%d %.6f %.6f", "location_id", "x", "y").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file sorted by month and id (coordinates: by id). Written by one task, so it is for a unit universe's months, not for raw events."""
    keys = [c for c in ("yyyymm", "location_id") if c in lines.columns]
    lines.repartitionByRange(1, *keys).sortWithinPartitions(*keys).select("value").write.mode("errorifexists").text(path)


def parameter_file(model: str, case_file: str, coordinate_file: str, results_file: str, start: str, end: str, population_file: str = "", replicates: int = 999, max_spatial: int = 50, max_temporal: int = 12, seed: int | None = None) -> str:
    """An INI parameter file. Poisson needs a population, the permutation model must have none."""
    if model not in MODELS or (model == "poisson") != bool(population_file):
        raise ValueError("poisson needs a population file and permutation must have none")
    sections = {
        "Input": {"CaseFile": case_file, "PopulationFile": population_file, "CoordinatesFile": coordinate_file, "PrecisionCaseTimes": 2, "CoordinatesType": 0, "StartDate": start, "EndDate": end},
        "Analysis": {"AnalysisType": 3, "ModelType": MODELS[model], "ScanAreas": 1, "TimeAggregationUnits": 2, "TimeAggregationLength": 1, "MonteCarloReps": replicates},
        "Output": {"ResultsFile": results_file},
        "Spatial Window": {"MaxSpatialSizeInPopulationAtRisk": max_spatial, "SpatialWindowShapeType": 0},
        "Temporal Window": {"MaxTemporalSizeInterpretation": 1, "MaxTemporalSize": max_temporal},
    } | ({"Run Options": {"RandomlyGenerateSeed": "n", "RandomNumberSeed": seed}} if seed is not None else {})
    return "".join(f"[{name}]\n" + "".join(f"{k}={v}\n" for k, v in body.items()) + "\n" for name, body in sections.items())


def _tokens(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("t"))


def _need(n: int):
    return F.when(F.size("t") < n, F.raise_error(F.concat(F.lit(f"fewer than {n} fields: "), F.array_join("t", " "))).cast("array<string>")).otherwise(F.col("t"))


def parse_clusters(lines: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Clusters with p <= alpha of the lines (value) of a cluster file; a line with under 11 fields raises."""
    t = _tokens(lines).select(_need(11).alias("t"))
    num = lambda i, kind="double": F.try_element_at("t", F.lit(i)).try_cast(kind)
    p = F.regexp_replace(F.element_at("t", 11), "<", "").try_cast("double")
    out = t.select(
        num(1, "int").alias("cluster"), F.element_at("t", 2).alias("location"), num(3).alias("x"), num(4).alias("y"), num(5).alias("radius"), parse_period(F.element_at("t", 7)).alias("start"), parse_period(F.element_at("t", 8)).alias("end"),
        num(9, "int").alias("n_locations"), num(10).alias("statistic"), p.alias("p"), num(12).alias("observed"), num(13).alias("expected"), num(14).alias("relative_risk"),
    ).where(F.col("p") <= alpha)
    return out.withColumn("months", period_months("start", "end"))


def parse_members(lines: DataFrame, alpha: float = 0.05) -> DataFrame:
    t = _tokens(lines).select(_need(3).alias("t"))
    return t.select(F.element_at("t", 1).alias("location"), F.element_at("t", 2).try_cast("int").alias("cluster"), F.regexp_replace(F.element_at("t", 3), "<", "").try_cast("double").alias("p")).where(F.col("p") <= alpha)


def validate_results(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """One row a cluster with what does not hold: members counted against n_locations, centre among the members, end not before start."""
    got = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"), F.collect_set("location").alias("_set"))
    j = clusters.join(got, "cluster", "left")
    checks = F.concat_ws(";", F.when(F.coalesce("_n", F.lit(0)) != F.col("n_locations"), "member_count"), F.when(~F.coalesce(F.array_contains("_set", F.col("location")), F.lit(False)), "centre_not_member"), F.when(F.col("months") < 1, "reversed_period"))
    return j.select("cluster", checks.alias("problems"), (checks == "").alias("valid"))


def result_state(found: int, required: int) -> str:
    """No results yet, some of them (an error), or all."""
    if found == 0:
        return "EXTERNAL_RESULTS_REQUIRED"
    if found < required:
        raise ValueError(f"{found} of {required} result files")
    return "VALIDATED"


def recurrence(members: DataFrame, universe: DataFrame, unit: str = "location") -> DataFrame:
    """Distinct significant clusters of each unit, of all, and the share: an eligible unit in none has 0, an excluded one NULL."""
    per = members.groupBy(unit).agg(F.countDistinct("cluster").alias("k"))
    total = members.agg(F.countDistinct("cluster").alias("total"))
    j = universe.join(per, unit, "left").join(F.broadcast(total))
    k = F.when(F.col("eligible"), F.coalesce("k", F.lit(0)))
    return j.select(unit, k.alias("clusters"), "total", F.try_divide(k, F.col("total")).alias("fraction"))


def member_list(members: DataFrame, by: str, unit: str = "location") -> DataFrame:
    """Sorted distinct ids of each group joined by ``|``; numbers sort as numbers."""
    key = F.struct(F.col(unit).try_cast("long").alias("n"), F.col(unit).cast("string").alias("s"))
    return members.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_set(key)), lambda x: x["s"]), "|").alias("members"))


def key_problems(case_rows: DataFrame, population_rows: DataFrame | None, locations: DataFrame, times: DataFrame) -> DataFrame:
    """Counts of case and population keys without a location or a month."""
    def missing(df, dim, key):
        return df.join(dim.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))

    parts = [("case_location", missing(case_rows, locations, "location_id")), ("case_month", missing(case_rows, times, "yyyymm"))]
    if population_rows is not None:
        parts += [("population_location", missing(population_rows, locations, "location_id")), ("population_month", missing(population_rows, times, "yyyymm"))]
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def scenarios(config: list[dict]) -> list[dict]:
    """Checked scenario rows: Poisson has an exposure, permutation has none, the window is not reversed."""
    for s in config:
        if (s["model"] == "poisson") != bool(s.get("exposure")) or s["model"] not in MODELS or s["start"] > s["end"]:
            raise ValueError(f"scenario {s.get('id')}")
    return config
