"""The life of a run: queries written below one folder, each with a record, resumed and validated.

A query's table is complete if its record is there, which is written last. A
run that ended half-way is resumed by running what has none.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import list_files, read_json, stable_json, write_output


def parse_years(text: str) -> list[int]:
    """'2014,2016' or '2014-2016', or both together, sorted and each once."""
    out: set[int] = set()
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d{4})(?:-(\d{4}))?\s*", part)
        if not m or int(m[2] or m[1]) < int(m[1]):
            raise ValueError(f"no years: {part!r}")
        out.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(out)


def plan_years(sensors: list[str], years: str | None = None, of: dict[str, str] | None = None) -> dict[str, list[int]]:
    """The years of each sensor: its own if given, else the common ones; a sensor without either raises."""
    of = of or {}
    if set(of) - set(sensors):
        raise ValueError(f"unknown sensors {sorted(set(of) - set(sensors))}")
    if any(s not in of for s in sensors) and not years:
        raise ValueError("a sensor without years")
    return {s: parse_years(of.get(s, years or "")) for s in sensors}


def _digest(df: DataFrame) -> dict:
    """Rows and an order-free hash of them, in one aggregate."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).cast("string").alias("h")).first()
    return {"rows": one["n"], "hash": one["h"] or "0", "columns": df.columns}


def status(spark: SparkSession, out: str) -> dict[str, dict]:
    """The records of a run's complete queries."""
    return {p.rsplit("/", 1)[-1].removesuffix(".json"): read_json(spark, p) for p in list_files(spark, f"{out.rstrip('/')}/records/*.json")}


def run_all(spark: SparkSession, queries: dict[str, Callable], tables: str, out: str, resume: bool = False) -> dict[str, str]:
    """Runs each query and records it; 'done', or 'kept' where a resumed run has it already. Without ``resume`` a complete query raises."""
    have, result = status(spark, out), {}
    if have.keys() & queries.keys() and not resume:
        raise FileExistsError(f"complete already: {sorted(have.keys() & queries.keys())}")
    for name, query in queries.items():
        if name in have:
            result[name] = "kept"
            continue
        at = f"{out.rstrip('/')}/tables/{name}"
        query(spark, tables).write.mode("overwrite").parquet(at)  # what is there without a record is of a run that ended half-way
        write_output(f"records/{name}.json", stable_json(_digest(spark.read.parquet(at))).encode(), out)
        result[name] = "done"
    return result


def validate(spark: SparkSession, out: str) -> list[str]:
    """The queries whose table differs from its record."""
    return [name for name, record in sorted(status(spark, out).items()) if _digest(spark.read.parquet(f"{out.rstrip('/')}/tables/{name}")) != record]
