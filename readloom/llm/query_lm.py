"""op1: scores of all documents."""

from pyspark.sql import DataFrame, SparkSession

from . import util
from .lm_score import lm_scores
from .query_bpe import ranks_path


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(util.read(spark, sf_dir, "documents").select("doc_id", "text"), ranks_path())


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
ORACLES: dict[str, str] = {}
