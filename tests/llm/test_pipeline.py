"""run() against a plain walk through its stages; the classifier's verdicts are taken as
they are (it has its own test of held-out accuracy), all else is done by brute force."""

import base64
import re
from collections import Counter

import public_tokenizers as P
import tiktoken
from test_mixing import brute as mixed
from test_ngram_join import brute as components

import corpus_pipeline
from readloom.llm import util


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = util.read(spark, sf, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.quality(spark, docs, sf).collect()]
    assert 0 < len(rows) < docs.count()
    first = {}
    for i, t, s in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t, s))
    rows = list(first.values())
    stay = {i for i, _, c in components([(i, t) for i, t, _ in rows]) if i == c}
    rows = [r for r in rows if r[0] in stay]
    drawn = mixed([(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t, s in rows])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {i: t for i, t, _ in rows}
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter((str(r.doc_id), r.source) for r in out) == drawn
    for r in out:
        assert r.token_ids == coder.encode_ordinary(texts[r.doc_id]) and r.round_trip and r.n_tokens == len(r.token_ids)


def test_stages_keep_the_columns_and_bear_edge_rows(spark):
    rows = [(1, None, "en", None, 0), (None, "", None, "s", None), (2, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (3, "x " * 20_000, "en", "s", 1)]
    kind = util.read(spark, "/root/testdata/sf0.001", "documents").schema
    for data in (rows, []):
        docs = spark.createDataFrame(data, kind)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = util.stored(stage(spark, docs, ""))
            assert docs.columns == kind.names
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
