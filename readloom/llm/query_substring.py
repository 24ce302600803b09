"""op7: passages that repeat, removed from all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util
from .substring_dedup import substring_dedup


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup(docs, carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES: dict[str, str] = {}
