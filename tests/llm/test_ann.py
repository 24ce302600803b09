import itertools

import numpy as np
import pytest

from readloom.llm import ann


def test_hilbert_walks_through_neighbouring_cells():
    for axes, depth in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << depth), repeat=axes)))
        key = ann.hilbert(cells, depth)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, k):
    ok = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i in sorted({i for i, _ in ok if i % 5 == 0}):
        score = {}
        for _, q in (x for x in ok if x[0] == i):
            for j, v in ok:
                if j != i and len(v) == len(q):
                    score[j] = max(score.get(j, -np.inf), float(np.cumsum(np.array(q) * np.array(v))[-1]))
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(((-s, j) for j, s in score.items()))[:k]) for s in [-s]]
    return out


@pytest.mark.parametrize("k", [1, 7])
def test_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "AT_ONCE", 10)
    rng = np.random.default_rng(k)
    rows = [(i, np.float32(rng.standard_normal(6)).tolist()) for i in range(300)]
    same = rows[0][1]
    rows += [(i, same) for i in range(300, 420)]  # a very common vector
    rows += [(500, None), (505, []), (510, [0.0] * 6), (515, [1.0, None] + [0.0] * 4), (520, [float("nan")] * 6), (525, [float("inf")] * 6), (None, same), (530, [1.0, 2.0]), (531, [2.0, 1.0]), (0, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v").repartition(3)
    out = ann.nearest(df, df["vec_id"] % 5 == 0, k=k).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out)
    assert got == sorted(brute(rows, k))


def test_windows_alone_find_clustered_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16)) * 4
    rows = [(i, (centres[i % 60] + rng.standard_normal(16) * 0.2).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    full = {(r.query_id, r.vec_id) for r in ann.nearest(df, df["vec_id"] % 20 == 0, k=10).collect()}
    part = {(r.query_id, r.vec_id) for r in ann.nearest(df, df["vec_id"] % 20 == 0, k=10, complete=False).collect()}
    assert len(part & full) / len(full) > 0.9


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df, df["vec_id"] % 20 == 0).count() == 0
