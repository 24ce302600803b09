"""op2: secrets in all documents; the source stands for the owner."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util
from .secret_scan import BASE, listed, secret_scan


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # the text is not carried past the scan
    found = secret_scan(docs.select("doc_id", "source", "text"), carry=["doc_id"])
    count = lambda test: F.size(F.filter("secrets", test)).cast("long")
    of_kind = lambda kind: count(lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
    )


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES: dict[str, str] = {}
