"""Tables written to the shared folder, to cut lineage so that it survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one of our own only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="panelweave-")
    return _LOCAL[app]


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


class Scratch:
    """Written tables of one run of an operator. ``save`` writes and rereads; ``drop`` deletes what no plan needs any more."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/panelweave/{what}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: dict[int, str] = {}
        atexit.register(self._gone)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def save(self, df: DataFrame) -> DataFrame:
        at = self.path()
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.paths[id(out)] = at
        out._scratch_path = at
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            at = getattr(t, "_scratch_path", None)
            if at:
                fs, p = _fs(self.spark, at)
                fs.delete(p, True)

    def _gone(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                fs, p = _fs(self.spark, self.root)
                fs.delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            pass
