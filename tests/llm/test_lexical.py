import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from readloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    total, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (i, b), n in zip(bags, sizes, strict=True):
            score = 0
            for t in terms(text):
                if t in b:
                    m = 25 + 75 * n * total // length
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(found[:k])]
    return out


def tables(seed):
    rng = random.Random(seed)
    words = ["the", "é", "Été", "x1", "Zoo", "a", "of", "ñandú", "q9", "long"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[int(rng.random() ** 3 * len(words))] + rng.choice(["", ",", "-b", "'", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randrange(40))) for i in range(600)]
    docs += [(700, None), (None, text(5)), (None, text(5)), (701, ""), (702, "--- \t"), (3, text(9)), (704, "the " * 150_000)]
    docs += [(800 + i, "a common copy of w50") for i in range(300)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)] + [(50, None), (51, "??"), (None, "w50 common"), (3, "copy copy the"), (3, "copy"), (60, " ".join(words * 2)), (61, " ".join(f"v{i}" for i in range(90)) + " q9")]
    return docs, items


@pytest.mark.parametrize("k", [1, 10])
def test_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "SEGMENT", 64)
    docs, items = tables(k)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as item", "'x' as score").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item", "2 as rank").repartition(2)
    got = sorted(map(tuple, lexical.ranked_search(d, i, k=k).collect()), key=repr)
    assert got == sorted(brute(docs, items, k), key=repr)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "AT_ONCE", 3)
    docs, items = tables(5)
    got = lexical.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(docs, items, 4), key=repr)


def test_masks_group_equal_columns():
    bits = np.random.default_rng(3).random((150, 40)) < 0.5
    bits = bits[:, np.random.default_rng(4).integers(0, 40, 400)]
    masks, group = lexical.masks_of(bits)
    assert (masks[:, group] == bits).all()
    assert masks.shape[1] == len({tuple(c) for c in bits.T})


def test_few_groups_are_scored(monkeypatch):
    """The search ends before groups whose bound is below the k-th best."""
    asked = []
    add = lexical._Best.add
    monkeypatch.setattr(lexical._Best, "add", lambda self, s, *a: (asked.append(len(s)), add(self, s, *a)))
    rng = np.random.default_rng(0)
    n, known = 4000, 12
    doc = np.repeat(np.arange(n), 3)
    term = np.sort(rng.random((n, known)).argsort(axis=1)[:, :3], axis=1).ravel()
    segment = lexical._segment([(np.arange(n), np.zeros(n, bool), np.full(n, 3), doc, term, np.ones(3 * n, np.int64))])
    best = {}
    lexical._searched(segment.to_pylist()[0], [(0, np.arange(known), 2 ** np.arange(known))], n, 3 * n, best, 10)
    assert len(best[0].ids) == 10
    assert sum(asked) < n / 2


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(docs, items).count() == 0
    assert lexical.ranked_search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0
