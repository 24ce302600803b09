"""op8: byte-level BPE of all documents."""

from pyspark.sql import DataFrame, SparkSession

from . import util
from .bpe import bpe_digest


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digest(docs, ranks_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
