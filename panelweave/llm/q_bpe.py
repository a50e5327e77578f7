"""op10: every document encoded and decoded."""

import public_tokenizers

from .bpe import bpe_round_trip

NAME = "op10_bpe"


def query(spark, sf_dir):
    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


SQL = None
