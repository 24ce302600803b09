from readloom.llm.query_urls import RULES
from readloom.llm.url_filter import Rule, judged

URLS = [
    "http://a.b.example.net/en/x?y#z", "http://example.net/de/", "HTTP://EXAMPLE.COM/de/1", "https://example.com/dex", "x://org/fr/", "x://org/fr", "x://norg/fr/q",
    "no scheme", "", None, "http://net", "http://net/", "http://a.net?x", "://", "x://user@h.net:80/a", "http://xexample.net/en/", "http://example.com/de/1", "http://example.com/de/1",
]


def brute(url, rules):
    url = url or ""
    if "://" not in url:
        return None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail.split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return (best.host + best.path, best.verdict) if best else (None, "allow")


def test_trie_and_join_agree_with_brute_force(spark):
    rules = [*RULES, Rule("allow", "net", "/a"), Rule("block", "net", "/a"), Rule("block", "com", ""), Rule("allow", "example.com", "/de")]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string").selectExpr("*", "1 as rule", "2 as url_in")
    want = {i: brute(u, rules) for i, u in enumerate(URLS)}
    for limit in (100, 0):
        out = judged(df, rules, trie_rules=limit).collect()
        assert len(out) == len(URLS)
        assert {r.page_id: (r.rule, r.verdict) for r in out} == want, limit
        assert out[0].url_in == 2


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert judged(df, RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert judged(one, [], default="block").first().verdict == "block"
