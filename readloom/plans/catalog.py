"""Registry of the library's queries and of their SQL oracles."""

from pyspark.sql import functions as F

from . import page_plans, scalar_plans, table_plans

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Queries with a date column, which both sides give as text.
DATES = {"u5_date_from_url": "found", "u12_parse_date_text": "found", "x5_extract_published_date": "published_date", "x6_extract_post_links": "published_date", "x7_extract_feed_posts": "published_date", "d2_discover_posts": "published_date", "d3_hydrate_dates": "published_date"}


def _as_text(query, column: str):
    return lambda spark, sf_dir: query(spark, sf_dir).withColumn(column, F.col(column).cast("string"))


for _module in (scalar_plans, page_plans, table_plans):
    for _name, _query in _module.QUERIES.items():
        QUERIES[_name] = _as_text(_query, DATES[_name]) if _name in DATES else _query
    for _name, _sql in _module.ORACLES.items():
        ORACLES[_name] = f"SELECT * REPLACE (CAST(CAST({DATES[_name]} AS DATE) AS VARCHAR) AS {DATES[_name]}) FROM ({_sql})" if _name in DATES else _sql

site_bundles = page_plans.site_bundles
