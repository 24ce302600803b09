"""Sources: crawled pages, url lists, site profiles, queues."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of a pages table; absent ones are null.
PAGES = "page_id long, url string, html string, is_forum boolean, published_date date, saved_at timestamp, page_htmls array<struct<page:int,url:string,html:string>>"
PROFILES = "name string, domains array<string>, driver string, content_selector string, remove_selectors array<string>, headers map<string,string>, image_proxy_pattern string"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages with a fixed schema, from parquet, json or csv (csv: without page_htmls)."""
    schema = PAGES.split(", page_htmls")[0] if fmt == "csv" else PAGES
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn("page_htmls", F.lit(None).cast("array<struct<page:int,url:string,html:string>>"))
    return reader.format(fmt).load(path)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One url a line, trimmed; blank lines and lines that start with # are left out."""
    lines = spark.read.text(path)
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.trim("value").alias("url"))


def read_site_profiles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Profiles of JSON arrays, with their place in load order as priority."""
    parts = []
    for i, path in enumerate(paths):
        one = spark.read.schema(PROFILES).json(path, multiLine=True)
        parts.append(one.withColumn("file", F.lit(i)).withColumn("at", F.monotonically_increasing_id()))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    # a few files of a few rows each
    order = F.row_number().over(Window.orderBy("file", "at")) - 1
    return every.withColumn("priority", order).withColumn("name", F.coalesce("name", F.lit("Unknown"))).drop("file", "at")


def normalize_queue(queue: DataFrame, fallback_col: str = "fallback_saved_at") -> DataFrame:
    """Queue rows (pos, url, saved_at): urls trimmed, only http ones, saved_at filled from
    the fallback, the first row of each url by position."""
    named = queue.withColumn("url", F.trim("url")).where(F.col("url").startswith("http"))
    if fallback_col in queue.columns:
        named = named.withColumn("saved_at", F.coalesce("saved_at", fallback_col)).drop(fallback_col)
    first = F.row_number().over(Window.partitionBy("url").orderBy("pos"))
    return named.withColumn("k", first).where("k = 1").drop("k")
