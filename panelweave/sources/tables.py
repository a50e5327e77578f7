"""Strict table sources and deterministic sinks."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import blank_to_null


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, by Hadoop, so any store will do."""
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [] if s.isFile())


def header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).first()
    return next(csv.reader([first[0]])) if first else []


def read_csv_strict(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as trimmed strings, blank and NA tokens NULL; with ``columns`` the header must be just that, in order. Gzip is read by its suffix."""
    if columns is not None:
        got = header(spark, path)
        if got != list(columns):
            raise ValueError(f"{path}: header {got[:5]}... is not the contract's")
        df = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns]), enforceSchema=False)
    else:
        df = spark.read.csv(path, header=True, inferSchema=False)
    return df.select(*[blank_to_null(c).alias(c) for c in df.columns])


def parse_violations(df: DataFrame, integers: list[str], numbers: list[str], sample: int = 20) -> DataFrame:
    """(column, value): the first values that do not parse, or are fractional where an integer is due."""
    def bad(c: str, whole: bool):
        x = F.col(c).try_cast("double")
        wrong = F.col(c).isNotNull() & (x.isNull() | ((x % 1 != 0) if whole else F.lit(False)))
        return F.when(wrong, F.struct(F.lit(c).alias("column"), F.col(c).alias("value")))

    rows = df.select(F.explode(F.array(*[bad(c, True) for c in integers], *[bad(c, False) for c in numbers])).alias("r")).where("r is not null").select("r.*")
    return rows.limit(sample)


def parse_types(df: DataFrame, integers: list[str], numbers: list[str]) -> DataFrame:
    """Strings to nullable longs and doubles; raises on what does not parse. Whole values never pass through a double unless written with a point."""
    bad = parse_violations(df, integers, numbers).collect()
    if bad:
        raise ValueError(f"does not parse: {[tuple(r) for r in bad]}")
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("long"), F.col(c).try_cast("double").cast("long")) for c in integers} | {c: F.col(c).try_cast("double") for c in numbers})


def one_file(spark: SparkSession, pattern: str, sensor: str, year: int) -> str:
    """The single file for a sensor and year; none or several raise."""
    found = [p for p in list_files(spark, pattern) if sensor.lower() in p.rsplit("/", 1)[-1].lower() and str(year) in p.rsplit("/", 1)[-1]]
    if len(found) != 1:
        raise ValueError(f"{sensor} {year}: {len(found)} files of {pattern}")
    return found[0]


def discover_family(spark: SparkSession, pattern: str, codes: list[str], forbidden: tuple[str, ...] = ("_ext", "_qa", "manifest")) -> dict[str, str]:
    """Exactly one base CSV for each partition code; files with a forbidden token are passed over, missing, double or unknown codes raise."""
    out: dict[str, str] = {}
    for p in list_files(spark, pattern):
        name = p.rsplit("/", 1)[-1].lower()
        if any(t in name for t in forbidden) or not re.search(r"\.csv(\.gz)?$", name):
            continue
        hit = [c for c in codes if re.search(rf"(^|[_\-.]){re.escape(c.lower())}([_\-.]|$)", name)]
        if len(hit) != 1 or hit[0] in out:
            raise ValueError(f"{p}: {'no' if not hit else 'ambiguous or double'} partition code")
        out[hit[0]] = p
    missing = sorted(set(codes) - set(out))
    if missing:
        raise ValueError(f"no file for {missing}")
    return out


def load_family(spark: SparkSession, files: dict[str, str], columns: list[str]) -> DataFrame:
    """All files of a family in one read, with their path; each must have one run_id and one schema_version."""
    for p in files.values():
        if header(spark, p) != list(columns):
            raise ValueError(f"{p}: another header")
    df = spark.read.csv(list(files.values()), header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns]), enforceSchema=False)
    df = df.select(*[blank_to_null(c).alias(c) for c in columns], F.col("_metadata.file_path").alias("source_path"))
    lineage = [c for c in ("run_id", "schema_version") if c in columns]
    if lineage:
        bad = df.groupBy("source_path").agg(*[F.countDistinct(c).alias(c) for c in lineage]).where(" or ".join(f"{c} <> 1" for c in lineage)).collect()
        if bad:
            raise ValueError(f"mixed lineage: {[r[0] for r in bad]}")
    return df


def read_year_partitions(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """Annual files read with only the columns asked for; one file a year."""
    years: dict[str, str] = {}
    for p in list_files(spark, pattern):
        y = re.search(r"(19|20)\d\d", p.rsplit("/", 1)[-1])
        if not y:
            raise ValueError(f"{p}: no year")
        if y[0] in years:
            raise ValueError(f"two files for {y[0]}")
        years[y[0]] = p
    reader = spark.read.parquet if next(iter(years.values())).endswith(".parquet") else (lambda *ps: spark.read.csv(list(ps), header=True))
    return reader(*years.values()).select(*columns)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small authority file, through Hadoop."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0][0])


def read_json(spark: SparkSession, path: str, digest: str | None = None) -> dict:
    """A JSON authority; with ``digest`` its SHA-256 must agree."""
    data = read_bytes(spark, path)
    if digest and hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"{path}: another digest")
    return json.loads(data)


def read_crosswalk(spark: SparkSession, path: str, columns: list[str], key: str, share: str) -> DataFrame:
    """A crosswalk with unique keys and shares in [0, 1]."""
    df = parse_types(read_csv_strict(spark, path, columns), [], [share])
    bad = df.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("double"), F.count_if(~F.coalesce(F.col(share).between(0, 1), F.lit(False))).alias("outside")).first()
    if bad["double"] or bad["outside"]:
        raise ValueError(f"{bad['double']} repeated keys, {bad['outside']} shares outside 0..1")
    return df


def first_existing(spark: SparkSession, candidates: list[str], contract: list[str]) -> DataFrame:
    """The first of the paths that exists, else an empty table; contract columns that are absent are NULL."""
    for p in candidates:
        if list_files(spark, p) or list_files(spark, p + "/*"):
            df = spark.read.parquet(p) if ".parquet" in p else spark.read.csv(p, header=True)
            return df.withColumns({c: F.lit(None).cast("string") for c in contract if c not in df.columns})
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in contract]))


# --- sinks ----------------------------------------------------------------------------------------


def write_csv_bytes(df: DataFrame, sort: list[str], columns: list[str], most_rows: int = 100_000) -> bytes:
    """Byte-stable CSV: sorted, exact columns, LF, UTF-8. For small results only; more than ``most_rows`` raise."""
    rows = df.select(*columns).orderBy(*sort).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"over {most_rows} rows: use write_csv_parts")
    buf = io.StringIO()
    w = csv.writer(buf, lineterminator="\n")
    w.writerow(columns)
    w.writerows([["" if v is None else v for v in r] for r in rows])
    return buf.getvalue().encode()


def gzip_bytes(data: bytes, level: int = 9) -> bytes:
    """Gzip without a time, so that equal data give equal bytes."""
    return gzip.compress(data, level, mtime=0)


def write_csv_parts(df: DataFrame, path: str, sort: list[str], columns: list[str], partition_by: list[str] | None = None) -> None:
    """Range-partitioned, sorted CSV parts, for results of any size; ``partition_by`` makes a folder a value."""
    rows = df.select(*columns).repartitionByRange(*sort).sortWithinPartitions(*sort)
    w = rows.write.option("header", True).mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_output(path: str, data: bytes, root: str, overwrite: bool = False) -> dict:
    """A write below ``root`` of a run, in any store that Hadoop reaches: to a name of its own, then renamed. What is there already is an error unless ``overwrite``. Returns path, bytes and SHA-256."""
    if path.startswith("/") or ".." in path.split("/") or ":" in path.split("/")[0]:
        raise ValueError(f"{path} leaves the run's folder")
    fs, full = _fs(SparkSession.active(), f"{root.rstrip('/')}/{path}")
    if fs.exists(full):
        if not overwrite:
            raise FileExistsError(full.toString())
    hadoop = SparkSession.active().sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(full.getParent())
    fs.setWriteChecksum(False)
    tmp = hadoop(full.getParent(), f".{uuid.uuid4().hex}.tmp")
    stream = fs.create(tmp, False)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    if overwrite:
        fs.delete(full, False)
    if not fs.rename(tmp, full):
        fs.delete(tmp, False)
        raise OSError(f"{full.toString()} cannot be written")
    return {"path": path, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}


def stable_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(stable_json(value).encode()).hexdigest()


def row_hashes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row_sha256) of each row's canonical text; NULL and the empty text differ."""
    cells = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return df.withColumn("row_sha256", F.sha2(F.concat_ws("\x1f", *cells), 256))


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of files, hashed on the executors."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_problems(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a recorded manifest."""
    j = now.select("path", F.col("sha256").alias("_now")).join(recorded.select("path", F.col("sha256").alias("_was")), "path", "full")
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_was").isNull(), "unregistered").when(F.col("_now") != F.col("_was"), "changed")
    return j.select("path", state.alias("problem")).where("problem is not null")


def check_field_names(columns: list[str]) -> list[str]:
    """Problems of attribute names for shapefiles: over 10 characters, or equal but for case."""
    low = [c.lower() for c in columns]
    return [f"{c}: over 10 characters" for c in columns if len(c) > 10] + [f"{c}: repeated but for case" for c in columns if low.count(c.lower()) > 1]
