import hashlib
import re

from readloom.llm import query_secrets, util
from readloom.llm.secret_scan import secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


HARD = [
    "password: token: abcdef secret=token=abcdef", "é中 😀 API_KEY = 'abc.def-1' apikey:abcdefg", "AKIA" + "A1" * 8 + " AKIAAKIAX AKIA" + "B" * 16 + "é",
    "token = \"" + "0a" * 20 + "\" " + "f" * 23 + " " + "f" * 24, "", None, "passwd=12345 passwd=123456", "x" * 50_000 + " secret: qwertyuiop", "token=" + "a" * 40, "SECRET\"=\"abcdef",
]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(HARD)], "doc_id long, source string, text string").selectExpr("*", "1 as spans", "2 as secrets")
    for r in secret_scan(df).collect():
        got = [f"{s.kind}:{s.start}:{s.stop}" for s in r.secrets if s.kind in ("assign", "access", "hex")]
        assert got == base(r.text), r.text
        assert r.spans == 1


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in util.read(spark, sf, "documents").collect()}
    out = query_secrets.op2_secret_scan(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        spans = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))
        assert set(spans) <= set(r.spans.split(",") if r.spans else [])


def test_ownership_separates_examples_from_live_values(spark):
    text = "token = abcdefgh12345678"
    rows = [(i, f"s{i}", text) for i in range(4)] + [(9, "s9", "secret=qwertyuiop1234"), (9, "s9", "secret=qwertyuiop1234"), (10, None, "secret=aaaaaaaa"), (None, "s1", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = [(r.doc_id, s.verdict, s.n_repos, s.n_owners) for r in secret_scan(df).collect() for s in r.secrets]
    assert sorted(out) == [*[(i, "example", 4, 4) for i in range(4)], (9, "live", 1, 1), (9, "live", 1, 1), (10, "unclear", 1, 0)]


def test_empty_table(spark):
    assert secret_scan(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
