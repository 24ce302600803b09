"""op13: the vectors of largest integer inner product with every fiftieth."""

from pyspark.sql import DataFrame, SparkSession

from . import util
from .topk import top_k


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = util.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors["vec_id"] % 50 == 0, k=5)


QUERIES = {"op13_top_k": op13_top_k}
ORACLES = {
    "op13_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """
}
