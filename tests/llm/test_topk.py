import math

import numpy as np
import pytest

from readloom.llm import topk


def brute(rows, k, every):
    ok = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i in sorted({i for i, _ in ok if i % every == 0}):
        score = {}
        for _, q in (x for x in ok if x[0] == i):
            for j, v in ok:
                if j != i and len(v) == len(q):
                    score[j] = max(score.get(j, -(2**63)), sum(a * b for a, b in zip(q, v, strict=True)))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted((-s, j) for j, s in score.items())[:k])]
    return out


@pytest.mark.parametrize("k", [1, 5])
def test_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, np.float32(rng.standard_normal(6)).tolist()) for i in range(300)]
    same = rows[0][1]
    rows += [(i, same) for i in range(300, 420)]  # a very common vector
    rows += [(i, [0.0] * 6) for i in (500, 501, 505)] + [(510, None), (515, [1.0, None] + [0.0] * 4), (520, [float("nan")] * 6), (525, [float("-inf")] * 6), (None, same)]
    rows += [(530, [1.0, 2.0]), (531, [2.0, 1.0]), (535, []), (536, []), (0, same), (10, same), (10, [9.0] * 6), (540, [1e6, -1e6] * 3), (541, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as x", "3 as score").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df["vec_id"] % 5 == 0, k=k).collect())
    assert got == sorted(brute(rows, k, 5))


def test_many_tiles_and_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.standard_normal(4)).tolist()) for i in range(5000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    got = {}
    for r in topk.top_k(df, df["vec_id"] % 7 == 0, k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    for q in range(0, 5000, 7):
        s = x @ x[q]
        s[q] = -(2**62)
        order = np.lexsort((np.arange(5000), -s))[:3]
        assert sorted(got[q]) == [(r + 1, int(j), int(s[j])) for r, j in enumerate(order)]


def test_no_block_or_tile_is_broadcast(spark):
    """Blocks are repeated for every group of tiles, so their file's size says little of them."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-9, 9, 4).astype(float).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    plan = topk.top_k(df, df["vec_id"] % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("held", [1, 3])
def test_more_tiles_than_a_group_holds(spark, monkeypatch, held):
    monkeypatch.setattr(topk, "HELD", held)
    monkeypatch.setattr(topk, "TILE", 50)
    rng = np.random.default_rng(5)
    rows = [(i, np.float32(rng.standard_normal(4 + i % 2)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df["vec_id"] % 9 == 0, k=5).collect())
    assert got == sorted(brute(rows, 5, 9))


def test_stops_on_proof():
    """With a good score known, low levels of impact are not summed; the result is exact."""
    rng = np.random.default_rng(3)
    x = np.floor(32 * rng.standard_normal((2000, 64))).astype(np.int64)
    q = x[:50]
    exact = x @ q.T
    exact[np.arange(50), np.arange(50)] = topk.NONE
    floors = np.sort(exact, axis=0)[-5]
    best = topk.Best(np.arange(50), q, floors, 5)
    parts = topk.postings(x)
    summed = topk.searched(best, np.arange(2000), x, *parts)
    assert summed < 0.8 * len(parts[0])
    assert best.pairs[2].tolist() == np.sort(exact, axis=0)[:-6:-1].T.ravel().tolist()
    assert (np.abs(parts[2][0]) > 0).all() and (parts[2][-1] == 0).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df["vec_id"] % 50 == 0).count() == 0
