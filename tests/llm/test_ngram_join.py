import random
import re

import pytest

from readloom.llm import ngram_join, query_ngrams, util


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    index = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(k)
    for k, (_, s) in enumerate(sets):
        for m in {m for g in s for m in index[g] if m < k}:
            both = len(s & sets[m][1])
            if 100 * both >= 75 * (len(s) + len(sets[m][1]) - both):
                parent[root(k)] = root(m)
    ids = {}
    for k, (i, s) in enumerate(sets):
        if i is not None and s:
            ids[root(k)] = min(ids.get(root(k), i), i)
    return sorted((i if i is not None else -1, len(s), (ids.get(root(k), -1) if s else (i if i is not None else -1))) for k, (i, s) in enumerate(sets))


def got(out):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out.collect())


def near_copies(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 20, 60, 200]))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text).capitalize() if i % 3 else " ".join(text)))
    return rows


EDGE = [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1003, "one"), (1004, "One"), (None, "one"), (1005, "one two"), (1006, "é é é é é é é"), (1007, "w " * 30_000), (1008, "w " * 29_000)]


@pytest.mark.parametrize("small", [ngram_join.SMALL, 2])
def test_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "TILE", 10_000)
    rows = near_copies(260, 5) + EDGE
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as n").repartition(3)
    assert got(ngram_join.ngram_components(df)) == brute(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in util.read(spark, sf, "documents").collect()]
    assert got(query_ngrams.op10_ngram_jaccard_join(spark, sf)) == brute(rows)


def test_empty_table(spark):
    assert ngram_join.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
