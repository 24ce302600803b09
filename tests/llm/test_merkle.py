import hashlib

import numpy as np
from pyspark.sql import functions as F

from readloom.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def test_compression_equals_the_library():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 32, (9, 8)).astype(np.uint32)
    for n in range(1, 9):
        made = merkle.digests(merkle.parents(words[:n], [n]))[0]
        assert made.astype(">u4").tobytes() == hashlib.sha256(words[:n].astype(">u4").tobytes().hex().encode()).digest()
    records = merkle.parents(words, [9])
    assert records["count"].tolist() == [8, 1]
    swapped = words.copy()
    swapped[3] = 7
    got = merkle.resumed(records, np.array([0]), np.array([3]), swapped[3:4])
    assert (got == merkle.digests(merkle.parents(swapped[:8], [8]))).all()


def digest(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in COLUMNS)]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def joined(hexes):
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def brute(rows, tampered):
    """Each row's leaf, subroot, root, proof hash, folded root."""
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, digest(r)))
        trees[g] = levels_of([digest(r) for r in by[g]])
    top = levels_of([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for pos, r in enumerate(by[g]):
            claim = digest(dict(r, text=r["text"].lower() if r["text"] is not None and r["text"].isascii() else r["text"])) if tampered(r) else digest(r)
            proof, fold = "", claim
            for levels, p in ((trees[g], pos), (top, k)):
                for level in levels[:-1]:
                    run = level[p // 8 * 8 : p // 8 * 8 + 8]
                    proof += "".join(x for i, x in enumerate(run) if i != p % 8)
                    fold = joined([fold if i == p % 8 else x for i, x in enumerate(run)])
                    p //= 8
            out.append((r["doc_id"], digest(r), trees[g][-1][0], top[-1][0], hashlib.sha256(proof.encode()).hexdigest(), fold, fold == top[-1][0]))
    return out


def run(df, levels=merkle.LEVELS):
    odd = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    return merkle.merkle_manifest(df, COLUMNS, changed=odd, changes={"text": F.lower("text")}, levels=levels)


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def test_equals_brute_force(spark):
    rows = [dict(doc_id=i, source=f"s{i % 3}", lang="en" if i < 700 else "de", n_chars=i, text=f"Text {i}" if i % 5 else None) for i in range(1300)]
    rows += [dict(doc_id=9000 + i, source=None, lang=g, n_chars=None, text="A") for i, g in enumerate([None, None, "", "é", "one", "z" * 40, "a", "b", "c", "d", "e"])]
    rows += [dict(doc_id=None, source="x", lang="en", n_chars=1, text="Null"), dict(doc_id=3, source="x", lang="en", n_chars=1, text="again")]
    rows += [dict(doc_id=6, source="x", lang="en", n_chars=1, text="Copy")] * 40
    rows.append(dict(doc_id=77777, source="x", lang="de", n_chars=1, text="Long " * 200_000))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as pos", "3 as digest", "'x' as id").repartition(5)
    got = sorted(map(tuple, run(df).collect()), key=repr)
    want = sorted(brute(rows, lambda r: r["doc_id"] is not None and r["doc_id"] % 3 == 0), key=repr)
    assert got == want
    assert 0 < sum(x[-1] for x in got) < len(got)


def test_many_rounds_of_packs(spark):
    rows = [dict(doc_id=i, source="s", lang=f"g{i % 11}" if i > 600 else "one", n_chars=1, text="T" * (i % 4)) for i in range(700)]
    got = sorted(map(tuple, run(spark.createDataFrame(rows, SCHEMA).repartition(4), levels=1).collect()))
    assert got == sorted(brute(rows, lambda r: r["doc_id"] % 3 == 0))


def test_small_tables(spark):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    one = dict(doc_id=5, source="s", lang="en", n_chars=1, text="T")
    r = run(spark.createDataFrame([one], SCHEMA)).first()
    assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (digest(one), digest(one), digest(one), hashlib.sha256(b"").hexdigest())
    assert r["verified"]
