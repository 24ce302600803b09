"""op12: the best documents for each benchmark item."""

import string

from pyspark.sql import DataFrame, SparkSession

from . import util
from .lexical import ranked_search


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.read(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search(docs, util.read(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_TERMS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLES = {
    "op12_ranked_search": rf"""
        WITH dt AS (SELECT doc_id, {_TERMS} AS term FROM documents),
        n AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY 1),
        s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY 1, 2),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
        q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY 1, 2),
        score AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
                  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), s GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM score WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """
}
