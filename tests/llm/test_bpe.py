import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.llm import bpe, query_bpe, util

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
VOCAB = bpe.vocabulary(bpe.read_ranks(PATH))


def encode(texts):
    data, offsets = util.utf8(pa.array(texts, pa.string()))
    return list(bpe.encode_batch(data, offsets, VOCAB))


SIGNS = st.text(alphabet=st.sampled_from(list("aestrvlmdREé中1² \t\n\r 　'’!.,-😀́​")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(SIGNS, st.text(max_size=30).filter(lambda x: x.isprintable())), min_size=1, max_size=6))
def test_equals_public_library(texts):
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    assert encode(texts) == [REFERENCE.encode_ordinary(x) for x in texts]


def test_long_slices_and_blocks():
    texts = ["a" * 5000, "don't you'll we've 've' 'tis   x\n\n y 'll", "", " " * 1000, "ab " * 4000, "'" * 300 + "s"]
    assert encode(texts) == [REFERENCE.encode_ordinary(x) for x in texts]


def test_round_trip_and_offsets(spark):
    rows = [(1, "Hé 中 don't\n"), (2, None), (3, ""), (3, ""), (None, "x" * 10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as made")
    out = bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).collect()
    assert len(out) == 5
    for r in out:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.decoded_offsets[-1] == len(r.decoded) and len(r.decoded_offsets) == len(r.token_ids) + 1
        assert r.made == 1
    both = bpe.bpe_round_trip(df.withColumn("token_ids", F.lit(1)), PATH).collect()
    assert [(r.doc_id, r.text, r.made, r.token_ids) for r in both] == [(r.doc_id, r.text, r.made, r.token_ids) for r in out] and all(r.round_trip for r in both)
    assert bpe.bpe_round_trip(df.limit(0), PATH).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in util.read(spark, sf, "documents").collect()}
    out = query_bpe.op8_byte_bpe(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = REFERENCE.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_digest(df, PATH).count() == 0


def test_scan_equals_a_plain_walk():
    symbols = np.random.default_rng(1).integers(0, 8, 3000).astype(np.uint8)
    state, want = bpe.DONE, []
    for s in symbols:
        want.append(state)
        state = int(bpe.STEP[s, state])
    assert bpe.scan(symbols).tolist() == want
