"""op10: components of near-duplicate documents."""

from pyspark.sql import DataFrame, SparkSession

from . import util
from .ngram_join import ngram_components


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(util.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
