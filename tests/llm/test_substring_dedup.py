import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from readloom.llm import query_substring, util
from readloom.llm import substring_dedup as x


def brute(rows, width):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in split for k in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = " ".join(v for k, v in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(out):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect())


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdeé") * rng.randint(1, 2)
    passages = [[word() for _ in range(rng.choice([4, 6, 9, 40, 90]))] for _ in range(8)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(1, 5)):
            text += rng.choice(passages) if rng.random() < 0.4 else [word() for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n\t"]).join(text)))
    return rows


EDGE = [(900, None), (901, ""), (902, "a " * 300), (903, "b " * 36), (904, "c " * 35), (905, "d " * 34), (906, "e f " * 18), (907, "x y z"), (907, "x y z"), (None, "q " * 7), (908, "u v w " * 20_000)]


def test_factors_are_the_longest_and_greedy():
    rng = np.random.default_rng(4)
    for _ in range(200):
        size = int(rng.integers(1, 40))
        h, block = rng.integers(0, 4, size).astype(np.uint64), np.sort(rng.integers(0, 5, size))
        ends = np.searchsorted(block, block, side="right")
        longest = [max([0, *[next((k for k in range(min(ends[i] - i, ends[j] - j)) if h[i + k] != h[j + k]), min(ends[i] - i, ends[j] - j)) for j in range(size) if j != i]]) for i in range(size)]
        want, at = [], 0
        while at < size:
            if longest[at]:
                want.append((at, at + longest[at] - 1))
            at += max(longest[at], 1)
        first, last = x.factors(block, h, np.zeros(size, np.uint32), np.zeros(0, np.uint64))
        assert list(zip(first.tolist(), last.tolist(), strict=True)) == want


@pytest.mark.parametrize(("width", "hot"), [(2, 3), (5, 10**6), (5, 3), (35, 2), (35, 10**6)])
def test_equals_brute_force(spark, monkeypatch, width, hot):
    monkeypatch.setattr(x, "HELD", 500)
    monkeypatch.setattr(x, "HOT", hot)
    rows = made(width) + EDGE
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k1", "'a' as found", "2 as spans").repartition(5)
    out = x.substring_dedup(df, width=width)
    assert {"k1", "found"} <= set(out.columns)
    assert got(out) == brute(rows, width)


def test_many_equal_rows_of_one_id(spark, monkeypatch):
    """Each copy finds the spans of all; they count once, so a row meets few of them."""
    monkeypatch.setattr(x, "HELD", 2000)
    text = " ".join(f"w{k}" for k in range(520))
    rows = [(7, text)] * 1000 + [(None, text[5:])] * 500 + [(8, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    runs = x.repeated_windows(df.selectExpr("coalesce(doc_id, -1) AS k1", "xxhash64(text) AS k2", "text"), 35)
    assert all(r["count"] < 520 for r in runs.distinct().groupBy("k1", "k2").count().collect())
    assert got(x.substring_dedup(df)) == brute(rows, 35)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in util.read(spark, sf, "documents").collect()]
    out = query_substring.op7_substring_dedup(spark, sf).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == brute(rows, 35)
    assert sum(r.n_removed for r in out) > 0


def test_empty_table(spark):
    assert x.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
