"""op9: a quality verdict on all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util
from .quality import judged


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.read(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
