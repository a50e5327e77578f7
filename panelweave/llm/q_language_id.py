"""op8: the language of every document."""

from .language_id import identify_documents

NAME = "op8_language_id"


def query(spark, sf_dir):
    return identify_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
