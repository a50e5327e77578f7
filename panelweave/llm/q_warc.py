"""op7: every page written to WARC archives and read back."""

from .warc import archive_and_read

NAME = "op7_warc"


def query(spark, sf_dir):
    return archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = None
