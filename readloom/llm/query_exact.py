"""op6: exact duplicates of all documents."""

from pyspark.sql import DataFrame, SparkSession

from . import util
from .exact_dedup import exact_dedup


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, keep_columns=["doc_id"])


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept,
               sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """
}
