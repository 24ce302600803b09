"""op3: all documents, mixed by source."""

from pyspark.sql import DataFrame, SparkSession

from . import util
from .mixing import mix_sources, n_words

MAX_REPEATS = 1.25


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.read(spark, sf_dir, "documents")
    counted = docs.select("doc_id", "source", n_words(docs["text"]).alias("n_tokens"))
    return mix_sources(util.stored(counted), tokens_col="n_tokens", max_repeats=MAX_REPEATS)


QUERIES = {"op3_source_mixing": op3_source_mixing}
#: The mix of a table `mix_in` (doc_id, source, n_tokens) as SQL, for reuse.
MIX_SQL = r"""
    mix_d AS (SELECT *, md5('mix|' || doc_id) AS h FROM mix_in WHERE n_tokens > 0),
    mix_s AS (SELECT source, sum(n_tokens)::DOUBLE AS have FROM mix_d GROUP BY source),
    mix_l AS (SELECT list(have ORDER BY have) AS ts, sum(have) AS b FROM mix_s),
    mix_b AS (
        SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, ts, b FROM mix_l
        UNION ALL
        SELECT i + 1, CASE WHEN f > {limit} THEN mid ELSE lo END, CASE WHEN f > {limit} THEN hi ELSE mid END, ts, b
        FROM (SELECT *, list_max(list_transform(ts, lambda t: pow(t, mid - 1))) * b / list_sum(list_transform(ts, lambda t: pow(t, mid))) AS f
              FROM (SELECT *, (lo + hi) / 2 AS mid FROM mix_b WHERE i < 60))),
    mix_a AS (SELECT CASE WHEN list_max(list_transform(ts, lambda t: 1 / t)) * b / len(ts) > {limit} THEN hi ELSE 0.0 END AS alpha, ts, b FROM mix_b WHERE i = 60),
    mix_q AS (SELECT source, have, pow(have, alpha) / list_sum(list_transform(ts, lambda t: pow(t, alpha))) * b AS quota FROM mix_s, mix_a),
    mix_w AS (SELECT source, floor(quota / have)::INTEGER AS whole, quota - floor(quota / have) * have AS rest FROM mix_q),
    mix_o AS (SELECT mix_d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY source ORDER BY md5('mix|' || whole || '|' || h[1:3]), md5('mix|' || whole || '|' || h[4:6]), h, doc_id) - n_tokens AS before
              FROM mix_d JOIN mix_w USING (source)),
    mix_out AS (SELECT doc_id, source, n_tokens, unnest(range(whole + CASE WHEN before < rest THEN 1 ELSE 0 END))::INTEGER AS epoch FROM mix_o)
"""
ORACLES = {
    "op3_source_mixing": r"""WITH RECURSIVE mix_in AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents), """
    + MIX_SQL.replace("{limit}", str(MAX_REPEATS))
    + " SELECT * FROM mix_out"
}
