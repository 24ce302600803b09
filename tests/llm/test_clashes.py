"""Every operator on a table whose extra columns have all names that its module uses."""

import inspect
import re

import pytest

from readloom.llm import ann, bpe, exact_dedup, lexical, lm_score, merkle, mixing, ngram_join, quality, secret_scan, substring_dedup, topk, url_filter
from readloom.llm.query_bpe import ranks_path

RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/")]


def rules_table(spark):
    return spark.createDataFrame([tuple(r) for r in RULES], "verdict string, host string, path string")


#: Operator by name: its module, what runs it, and whether it keeps the extra columns.
OPERATORS = {
    "lm_scores": (lm_score, lambda s, d: lm_score.lm_scores(d, ranks_path()), False),
    "secret_scan": (secret_scan, lambda s, d: secret_scan.secret_scan(d), True),
    "mix_sources": (mixing, lambda s, d: mixing.mix_sources(d), True),
    "judged urls": (url_filter, lambda s, d: url_filter.judged(d, RULES), True),
    "judged_by_join": (url_filter, lambda s, d: url_filter.judged_by_join(d, rules_table(s)), True),
    "nearest": (ann, lambda s, d: ann.nearest(d, d["doc_id"] == 1, k=2, id_col="doc_id"), False),
    "exact_dedup": (exact_dedup, lambda s, d: exact_dedup.exact_dedup(d), True),
    "substring_dedup": (substring_dedup, lambda s, d: substring_dedup.substring_dedup(d, width=5), True),
    "bpe": (bpe, lambda s, d: bpe.bpe_decode(bpe.bpe_encode(d, ranks_path()), ranks_path()), True),
    "judged": (quality, lambda s, d: quality.judged(d), True),
    "merkle_manifest": (merkle, lambda s, d: merkle.merkle_manifest(d, ["doc_id", "source", "text"], group_col="source"), False),
    "ranked_search": (lexical, lambda s, d: lexical.ranked_search(d, d.selectExpr("doc_id AS benchmark_id", "text"), k=3, item_id_col="benchmark_id"), False),
    "top_k": (topk, lambda s, d: topk.top_k(d, d["doc_id"] == 1, k=2, id_col="doc_id"), False),
    "one_of_each": (ngram_join, lambda s, d: ngram_join.one_of_each(d), True),
}
ROWS = [(i, f"a b c d e f g h {i // 2} token = abcdefgh{i // 3}", "s", "http://www.example.net/en/x", [1.0, float(i)]) for i in range(9)] + [(None, None, None, None, None), (3, "", "s", "x", [1.0, 2.0])]


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_of_any_name(spark, name):
    module, run, keeps = OPERATORS[name]
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, url string, embedding array<double>").repartition(3)
    plain = run(spark, df)
    made = set(plain.columns) | set(df.columns)
    words = set(re.findall(r'"(_?[a-z][a-z_0-9]*)"', inspect.getsource(module))) - {c.lower() for c in made}
    extra = sorted(words)
    wide = run(spark, df.selectExpr("*", *[f"{k} AS `{w}`" for k, w in enumerate(extra)]))
    assert set(wide.columns) == set(plain.columns) | (set(extra) if keeps else set())
    rows = [sorted(map(repr, x.select(plain.columns).collect())) for x in (plain, wide)]
    assert rows[0] == rows[1]
    if keeps and rows[0]:
        first = wide.select(*[f"`{w}`" for w in extra]).first()
        assert list(first) == list(range(len(extra)))
