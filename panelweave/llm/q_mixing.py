"""op5: all documents mixed to target weights."""

from .mixing import mix

NAME = "op5_mixing"


def query(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("at", "source")


SQL = None
