"""op6: near-duplicate groups of all embeddings."""

from .embedding_dedup import embedding_dedup

NAME = "op6_embedding_dedup"


def query(spark, sf_dir):
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = None
