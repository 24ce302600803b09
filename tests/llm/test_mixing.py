import hashlib
import math
from collections import Counter, defaultdict

import pytest

from readloom.llm.mixing import mix_sources

md5 = lambda x: hashlib.md5(x.encode()).hexdigest()


def brute(rows, budget=None, max_repeats=1.25, entropy=None, seed="mix"):
    """Draws of (id, source) by a plain walk over each source's permuted documents."""
    docs = defaultdict(list)
    for i, s, n in rows:
        if n:
            docs[s].append(("" if i is None else str(i), n))
    have = {s: sum(n for _, n in x) for s, x in docs.items()}
    budget = budget or sum(have.values())

    def flat(a):
        z = sum(t**a for t in have.values())
        if entropy is not None:
            return -sum(t**a / z * math.log(t**a / z) for t in have.values()) > entropy
        return max(t ** (a - 1) for t in have.values()) * budget / z > max_repeats

    lo, hi = 0.0, 1.0
    if flat(0.0):
        for _ in range(60):
            lo, hi = ((lo + hi) / 2, hi) if flat((lo + hi) / 2) else (lo, (lo + hi) / 2)
    else:
        hi = 0.0
    z, out = sum(t**hi for t in have.values()), Counter()
    for s, x in docs.items():
        quota = have[s] ** hi / z * budget
        whole = int(quota // have[s])
        rest, before = quota - whole * have[s], 0
        hashed = sorted((md5(f"{seed}|{whole}|{h[:3]}"), md5(f"{seed}|{whole}|{h[3:6]}"), h, i, n) for i, n in x for h in [md5(f"{seed}|{i}")])
        for *_, i, n in hashed:
            out[i, s] += whole + (before < rest)
            before += n
    return +out


ROWS = [(i, "big" if i % 3 else f"s{i % 5}", (i * 7919) % 50) for i in range(3000)] + [(9001, None, 40), (9002, None, 3), (None, "s1", 30)]


@pytest.mark.parametrize("how", [{}, {"entropy": 1.2, "max_repeats": None}, {"max_repeats": 3.0}, {"budget": 150_000, "max_repeats": 4.0}, {"budget": 1000}, {"budget": 10**6, "max_repeats": 1.0}])
def test_equals_a_plain_walk(spark, how):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, n long").selectExpr("*", "'x' as epoch", "1 as mix_source", "2 as h")
    out = mix_sources(df, tokens_col="n", **how)
    assert "h" in out.columns
    got = Counter(("" if r.doc_id is None else str(r.doc_id), r.source) for r in out.collect())
    assert got == brute(ROWS, **how)


def test_words_are_counted_and_empty_texts_fill_nothing(spark):
    df = spark.createDataFrame([(1, "a", "x y  z"), (2, "a", None), (3, "a", " "), (4, "b", "q " * 30_000)], "doc_id long, source string, text string")
    out = mix_sources(df, max_repeats=1.0)
    assert {r.doc_id for r in out.collect()} == {1, 4}


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
