"""op2: token counts of every document."""

import public_tokenizers

from .token_counts import token_counts

NAME = "op2_token_counts"


def query(spark, sf_dir):
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


SQL = None
