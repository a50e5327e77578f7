"""op3: every page's url judged."""

from .url_filter import judge

NAME = "op3_url_filter"


def query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


SQL = None
