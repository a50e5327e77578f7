"""Folders for tables that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def workspace(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; below a temporary one only in local mode where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="panelweave-")
        _LOCAL[app] = base
    return f"{base.rstrip('/')}/panelweave/{what}-{uuid.uuid4().hex[:12]}"
