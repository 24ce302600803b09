"""The corpus pipeline: five operators in a row over documents.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a DataFrame; it is written as Parquet and read again for the next stage.

All stages bear nulls in any column, texts of any length, repeated rows and empty tables
(which give empty results), and keep extra columns whatever their names, but for the last
one, which returns its own.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import util
from readloom.llm.bpe import bpe_round_trip
from readloom.llm.exact_dedup import exact_dedup
from readloom.llm.mixing import mix_sources
from readloom.llm.ngram_join import one_of_each
from readloom.llm.quality import judged
from readloom.llm.query_bpe import ranks_path

#: No source is repeated more often than this by the mix.
MAX_REPEATS = 1.25


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on docs, rejects go. A null text is judged as
    an empty one; equal texts are judged alike."""
    return judged(docs).where("quality_kept").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, the one with the smallest id; null texts equal empty
    ones, null ids come last, and of repeated rows one stays."""
    return exact_dedup(docs).where("kept").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays. Null,
    empty and wordless texts have no near copies and stay."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them. A null source is one of its
    own; rows without words fill no budget and go; ties on a border are broken by id."""
    return mix_sources(docs, max_repeats=MAX_REPEATS).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text; a null text is an empty one."""
    coded = bpe_round_trip(docs.drop("round_trip", "token_ids"), ranks_path())
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources to target weights", mix), ("byte-level BPE encoding and decoding", encode)]

#: The classifier and the join have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = util.read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = util.stored(stage(spark, docs, sf_dir))
        if last is not None:
            util.dropped(last)  # the stage after it is written
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
