"""The queries of this subpackage and their SQL oracles."""

from . import query_ann, query_bpe, query_exact, query_lexical, query_lm, query_merkle, query_mixing, query_ngrams, query_pipeline, query_quality, query_secrets, query_substring, query_topk, query_urls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (query_lm, query_secrets, query_mixing, query_urls, query_ann, query_exact, query_substring, query_bpe, query_quality, query_ngrams, query_merkle, query_lexical, query_topk, query_pipeline):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
