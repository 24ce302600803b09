"""op4: a verdict on every page's url."""

from pyspark.sql import DataFrame, SparkSession

from . import util
from .url_filter import Rule, judged

RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = util.read(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, RULES, default="allow").drop("url")


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {
    "op4_url_filter": r"""
        WITH u AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, rhost, rpath)),
        f AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
              FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f ON u.page_id = f.page_id AND k = 1
    """
}
