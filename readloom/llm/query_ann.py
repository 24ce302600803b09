"""op5: the nearest vectors of every twentieth."""

from pyspark.sql import DataFrame, SparkSession

from . import util
from .ann import nearest


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = util.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors["vec_id"] % 20 == 0, k=20)


QUERIES = {"op5_nearest_neighbours": op5_nearest_neighbours}
ORACLES = {
    "op5_nearest_neighbours": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """
}
