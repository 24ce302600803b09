import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import exact_dedup as x
from readloom.llm import util


def hashed(texts):
    data, offsets = util.utf8(pa.array(texts))
    return list(zip(*[h.tolist() for h in x.hashes(data, offsets)]))


@settings(deadline=None)
@given(st.text(max_size=50), st.text(max_size=50))
def test_pieces_combine(a, b):
    a, b = a.encode("utf-8", "ignore").decode(), b.encode("utf-8", "ignore").decode()
    (ha, hb, hab) = hashed([a, b, a + b])
    n = len(b.encode())
    assert hab == tuple(x.combined(p, q, n, point) for p, q, point in zip(ha, hb, x.POINTS))


def test_long_texts_hash_as_plain_polynomial():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé中 ") for _ in range(n)) for n in (0, 1, 1023, 1024, 1025, 300_000)]
    for text, got in zip(texts, hashed(texts)):
        for point, h in zip(x.POINTS, got):
            want = 0
            for byte in text.encode():
                want = (want * point + byte) % x.MOD
            assert h == want


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            out.append((i, first, len(ids), left and i == first, hashlib.sha256(t.encode()).hexdigest()))
            left = left and i != first
    return out


ROWS = [(1, "a  b"), (2, "a b"), (3, "a\t\nb"), (3, "a b"), (5, None), (6, ""), (7, " "), (8, "  "), (9, "long " * 40_000), (4, "long  " * 40_000), (None, "n"), (None, "n"), (1, "a b"), (10, "A b")]


def check(out, rows):
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in out), key=key) == sorted(brute(rows), key=key)


def test_whole_table_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' as norm", "1 as kept", "2 as h1")
    out = x.exact_dedup(df)
    assert {"norm", "h1", "text"} <= set(out.columns)
    check(out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect(), ROWS)


def test_collisions_are_split_by_content(spark, monkeypatch):
    def weak(texts: pa.Array) -> pa.Array:
        n = len(texts)
        return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int64))] * 3, ["h1", "h2", "size"])

    from pyspark.sql import functions as F

    monkeypatch.setattr(x, "fingerprint", F.arrow_udf(weak, x.fingerprint.returnType))
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    check(x.exact_dedup(df, keep_columns=["doc_id"]).collect(), ROWS)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert x.exact_dedup(df).count() == 0
