"""op4: near-duplicate groups of all documents."""

from .simhash import simhash_dedup

NAME = "op4_simhash"


def query(spark, sf_dir):
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
