import numpy as np
import pyarrow as pa

from readloom.llm import quality, query_quality, util


def test_held_out_accuracy(spark):
    """No label is used in training; all of them are held out."""
    sf = "/root/testdata/sf0.1"
    docs = util.read(spark, sf, "documents").join(util.read(spark, sf, "labels"), "doc_id")
    out = quality.judged(docs).select("quality", "quality_kept").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good.quality_kept.mean() > 0.995
    assert (~bad.quality_kept).mean() > 0.95


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7])
    n = len(right)
    say_bad = np.where(truth[:, None], rng.random((20_000, n)) < 0.03, rng.random((20_000, n)) < right * 0.5)
    votes = np.where(say_bad, 2, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, says, good = quality.em(patterns, counts)
    assert abs(good - 0.8) < 0.05
    assert np.allclose(says[:, 0, 2], right * 0.5, atol=0.08)
    assert np.all(np.diff(posterior[np.argsort((patterns == 2).sum(axis=1))])[-1:] <= 0)


def test_statistics_by_hand():
    texts = ["a a a b\nx y\nx y\n", "ABC ### d!! e|", "", "é"]
    found, count, doc, shape = quality.statistics(*util.utf8(pa.array(texts)))
    assert count.tolist() == [8, 4, 0, 1] and len(doc) == len(shape) == 13
    assert np.isclose(found["top"][0], 3 / 8) and np.isclose(found["stutter"][0], 2 / 8)
    assert np.isclose(found["lines"][0], 1 / 3) and np.isclose(found["repeats"][0], 4 / 8)
    assert np.isclose(found["signs"][1], 6 / 14) and np.isclose(found["bare"][1], 1 / 4) and np.isclose(found["ends"][1], 3 / 4)
    assert np.isclose(found["upper"][1], 3 / 5) and found["upper"][3] == 0


def test_edge_rows(spark):
    rows = [(1, None), (1, ""), (2, "word " * 40_000), (3, "A plain line of some words that says a thing or two, and no more than that."), (3, "x"), (None, "### $$$ " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pattern", "2 as quality_score")
    out = quality.judged(df).collect()
    assert len(out) == 6 and all(0 <= r.quality_score <= 1 for r in out)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judged(empty).count() == 0


def test_query_keeps_every_document_once(spark):
    sf = "/root/testdata/sf0.001"
    assert query_quality.op9_quality_classifier(spark, sf).count() == util.read(spark, sf, "documents").count()


def test_query_equals_a_plain_recomputation(spark):
    """EM and scorer redone document by document, without patterns, sparse arrays or Spark:
    rates by sums over all documents, a dense matrix of features for the regression."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in util.read(spark, sf, "documents").collect()}
    ids = sorted(texts)
    own = [util.utf8(pa.array([texts[i]], pa.string())) for i in ids]
    say = [[int(quality.votes(*quality.statistics(*x)[:2])[0]) // 3**j % 3 for j in range(len(quality.LABELLERS))] for x in own]
    n, k = len(ids), len(quality.LABELLERS)
    bad = [[0.5] * k, [0.16] * k]
    pooled = [(sum(v[j] == 1 for v in say) + 1) / (sum(v[j] != 2 for v in say) + 2) for j in range(k)]
    prior, good = 0.7, []
    for _ in range(200):
        good = []
        for v in say:
            odds = [1 - prior, prior]
            for c in (0, 1):
                for j in range(k):
                    odds[c] *= bad[c][j] if v[j] == 2 else (1 - bad[c][j]) * (pooled[j] if v[j] == 1 else 1 - pooled[j])
            good.append(odds[1] / sum(odds))
        for c in (0, 1):
            mass = [p if c else 1 - p for p in good]
            bad[c] = [min(max(sum(m for m, v in zip(mass, say, strict=True) if v[j] == 2) / sum(mass), 1e-3), 0.5) for j in range(k)]
        prior = min(max(sum(good) / n, 0.01), 0.99)
    dense = np.zeros((n, quality.DIMENSIONS))
    for i, x in enumerate(own):
        _, dims, values = quality.hashed(*quality.statistics(*x), quality.pairs(*x))
        np.add.at(dense[i], dims, values)
    # equal texts count once in the fit, which takes all rows of a table this small
    once = list({texts[i]: at for at, i in enumerate(ids)}.values())
    w, g2, target = np.zeros(quality.DIMENSIONS + 1), np.full(quality.DIMENSIONS + 1, 1e-8), np.array(good)[once]
    for _ in range(300):
        error = 1 / (1 + np.exp(-(dense[once] @ w[:-1] + w[-1]))) - target
        g = np.append(dense[once].T @ error, error.sum()) / len(once)
        g[:-1] += 1e-4 * w[:-1]
        g2 += g * g
        w -= 0.2 * g / np.sqrt(g2)
    want = dict(zip(ids, 1 / (1 + np.exp(-(dense @ w[:-1] + w[-1]))), strict=True))
    out = query_quality.op9_quality_classifier(spark, sf).collect()
    assert max(abs(r.score - want[r.doc_id]) for r in out) < 1e-3
    assert all(r.kept == (r.score >= quality.THRESHOLD) for r in out)
