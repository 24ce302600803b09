import datetime

import pytest
from pyspark.sql import functions as F

from readloom.functions import classify, dates, text, urls
from readloom.functions.tables import stored

D = datetime.date


def values(spark, fn, inputs, *more):
    """fn over a column of inputs, as one job."""
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"), *more)).collect()]


def check(spark, fn, cases, *more):
    got = values(spark, fn, list(cases), *more)
    assert dict(zip(cases, got)) == cases


def test_url_match_key(spark):
    check(spark, urls.url_match_key, {
        "https://www.Example.com/A/b/?x=1#y": "example.com/a/b", "": "", "http://x.com/.netlify/images?url=https%3A%2F%2Fcdn.y.com%2Fp.jpg&w=3": "cdn.y.com/p.jpg",
        "http://x.com/i?src=/rel.png": "x.com/i", "http://a.com/?image=http://b.com/?img=http://c.com/z/": "c.com/z", "HTTP://www.a.com/": "http://www.a.com", "http://a.com/%zz?url=%zz": "a.com/%zz",
    })
    assert values(spark, urls.url_match_key, [None]) == [""]


def test_canonical_url(spark):
    check(spark, urls.canonical_url, {
        "HTTPS://Ex.com//a///b/?q=1#f": "https://ex.com/a/b", "http://ex.com": "http://ex.com/", "http://ex.com/a;p=1": "http://ex.com/a",
        "https://www.crazyguyonabike.com/doc/?v=2&doc_id=7&x=1": "https://www.crazyguyonabike.com/doc?doc_id=7&v=2", "http://ex.com/A%20b/": "http://ex.com/A%20b",
    })


def test_site_and_article_urls(spark):
    base = F.lit("https://ex.com/")
    check(spark, urls.is_internal_url, {"http://blog.ex.com:80/": True, "http://u@ex.com/": True, "http://notex.com/": False, "/a": False}, base)
    check(spark, urls.is_article_url, {
        "https://ex.com/2024/1/2/x": True, "https://ex.com/p/abc": True, "https://ex.com/about": False, "https://ex.com/my-post": True, "https://ex.com/post": False, "https://ex.com/a/b-c": False,
        "https://ex.com/issue/12": False, "https://ex.com/issue/spring": True, "https://ex.com/": False, "https://other.com/my-post": False, "https://ex.com/privacy-policy": False,
    }, base)


def test_thread_urls(spark):
    check(spark, urls.thread_url, {"http://f.com/t.1/page-3/": "http://f.com/t.1", "http://f.com/t?page=2": "http://f.com/t", "http://f.com/t?a=1&page=2": "http://f.com/t?a=1"})
    check(spark, urls.thread_page_number, {"x/page-12": 12, "x?page=3": 3, "x": None})
    check(spark, urls.thread_page_url, {"http://f.com/t.1": "http://f.com/t.1/page-4", "http://f.com/t/page-2": "http://f.com/t/page-4", "http://f.com/?threads/a.1/": "http://f.com/?threads/a.1/page-4"}, F.lit(4))
    assert values(spark, urls.thread_page_url, ["u"], F.lit(1)) == ["u"]


def test_video_id(spark):
    check(spark, urls.video_id, {"https://youtu.be/abc": "abc", "https://www.youtube.com/watch?v=x1&t=3": "x1", "https://m.youtube.com/embed/q/r": "q", "https://youtube-nocookie.com/v/z": "z", "https://vimeo.com/1": None})


def test_image_origin(spark):
    check(spark, urls.image_origin_url, {
        "https://a.com/.netlify/images?src=s&url=u": "u", "https://a.com/imrs.php?src=https%3A%2F%2Fb.com%2Fc.jpg": "https://b.com/c.jpg", "https://a.com/p.jpg?w=300": "https://a.com/p.jpg", "https://a.com/p?w=3": None, "https://a.com/p.jpg": None,
    })
    assert values(spark, urls.image_origin_url, ["https://a.com/img/x?url=u"], F.lit("/img/")) == ["u"]


def test_dates(spark):
    check(spark, dates.parse_date_text, {
        "18th June 2026": D(2026, 6, 18), "June 18, 2026": D(2026, 6, 18), "Thursday, Jun 18, 2026": D(2026, 6, 18), "Jun 16": D(2026, 6, 16), "2025-08-15T12:30:00Z": D(2025, 8, 15), "2025.08.15": D(2025, 8, 15),
        "2025/8/5": D(2025, 8, 5), "15 Aug 2025": D(2025, 8, 15), "Aug. 15th, 2025": D(2025, 8, 15), "2025-13-01 and 2025/1/2": D(2025, 1, 2), "Fri, 15 Aug 25 12:30:00 +0000": D(2025, 8, 15), "none": None, "": None, "20250815": D(2025, 8, 15), "February 30, 2024": None,
    }, F.lit(2026))
    check(spark, dates.date_from_url, {
        "http://a.com/2025/08/15.html": D(2025, 8, 15), "http://a.com/posts/2025/08/15/slug": D(2025, 8, 15), "http://a.com/2025-08-15-slug": D(2025, 8, 15), "http://a.com/?date=2025-08-15": D(2025, 8, 15),
        "http://a.com/?year=2025&month=8&day=15": D(2025, 8, 15), "http://a.com/2025/13/40/?date=2025-01-01": None, "http://a.com/x": None,
    })
    check(spark, urls.archive_context, {"http://a.com/2025/08/": (2025, 8), "http://a.com/2025/13": None, "http://a.com/x": None})


def test_date_bounds():
    assert dates.parse_bound("2025") == D(2025, 1, 1) and dates.parse_bound("2025", True) == D(2025, 12, 31)
    assert dates.parse_bound("2025-08") == D(2025, 8, 1) and dates.parse_bound("2025-08", True) == D(2025, 8, 31)
    for bad in ("2025-13", "x", "2025-02-30"):
        with pytest.raises(ValueError):
            dates.parse_bound(bad)
    with pytest.raises(ValueError):
        dates.in_date_range(None, "2026", "2025")


def test_names(spark):
    check(spark, text.safe_filename, {'a/b:c  d\x01': "abc_d", "": "untitled", "x" * 200: "x" * 150})
    assert values(spark, text.safe_filename, [None]) == ["untitled"]
    got = values(spark, text.image_basename, ["http://a.com/p/sunset-view.jpg?x", "http://a.com/image.png", "http://a.com/12.jpg"])
    assert got[0] == "sunset-view" and got[1].startswith("image_") and len(got[1]) == 16 and got[2].startswith("image_")
    check(spark, text.page_spec, {"1,3-5": [1, 3, 4, 5], "5-3, 4": [3, 4, 5], "x,2,1-2-3": [2], "": None, "0": [], "a": None})


def test_titles_and_authors(spark):
    check(spark, text.normalized_title, {" “A”  b's ": "a bs", "": ""})
    check(spark, lambda x: text.titles_equivalent(x, F.lit("A long enough title here")), {"a long enough title here | Site": True, "A LONG enough title here": True, "A long enough": False, "": False})
    check(spark, text.clean_author, {" by  Jane Doe |": "Jane Doe", "Words by X": "X", "Author": None, "": None, "y" * 121: None})
    check(spark, text.is_low_quality_author, {"Jane": False, "Site Admin": True, "staff": True, "": True})


def test_srcset(spark):
    got = values(spark, text.srcset_candidates, ["http://c.ca/a,w_860,x.jpg 860w, http://c.ca/b,w.jpg 1280w", "a.jpg, b.jpg", None])
    assert [[(c.width, c.url) for c in x] for x in got] == [[(1280, "http://c.ca/b,w.jpg"), (860, "http://c.ca/a,w_860,x.jpg")], [(0, "a.jpg"), (0, "b.jpg")], []]


def test_languages_and_times(spark):
    check(spark, text.language_key, {"English": "en", "zh_TW": "zh", "chinese simplified": "zh", "auto": "auto", "": ""})
    check(spark, lambda x: text.languages_match(x, F.lit("en-GB")), {"English": True, "auto": False, "": False, "fr": False})
    check(spark, text.format_saved_at, {"2026-06-25T12:34:00Z": "2026-06-25 12:34 UTC", "2026-06-25T14:34:00+02:00": "2026-06-25 12:34 UTC", "2026-06-25 01:02:03": "2026-06-25 01:02 UTC", " soon ": "soon", "": ""})
    check(spark, text.is_low_value_alt, {"": True, "Photo": True, "IMG_1234 x": True, "a.jpg": True, "http://x": True, "deadbeefcafe": True, "A cat on a mat": False})


def test_blocks(spark):
    got = values(spark, lambda x: text.meta_block(x, F.lit("A & B"), F.lit(None), F.lit("Site"), F.lit("h")), ["http://x/?a=1&b"])[0]
    assert got == '<div class="post-meta"><p><strong>Source:</strong> <a href="http://x/?a=1&amp;b">Site</a></p><p><strong>Author:</strong> A &amp; B</p></div>'
    page = values(spark, lambda x: text.article_wrapper(x, F.lit("<p>b</p>"), F.lit(""), F.lit("fr")), ["<T>"])[0]
    assert "<title>&lt;T&gt;</title>" in page and 'lang="fr"' in page and "<p>b</p></body>" in page


def test_routes(spark):
    def route(x):
        return classify.driver(x, F.lit("<div class=\"comment-list\">"), F.lit(False))

    check(spark, route, {"https://news.ycombinator.com/item?id=1": "hn", "https://old.reddit.com/r/x": "reddit", "https://redd.it/1": "reddit", "https://a.substack.com/": "substack", "https://x.com/p/y": "substack", "https://b.wordpress.com/": "wordpress", "https://youtu.be/1": "youtube", "https://a.com": "wordpress"})
    one = lambda html, forum=False, alias=None: values(spark, lambda x: classify.driver(x, F.lit(html), F.lit(forum), F.lit(alias)), ["https://a.com/"])[0]
    assert one("x", True) == "forum" and one("XenForo") == "forum" and one("x") == "generic" and one(None, True, "HackerNews") == "hn" and one("x", True, "odd") == "forum"
    check(spark, classify.challenge, {"<p>DataDome": "datadome", "fine": None})


def test_profiles(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.org"), (3, None), (4, "http://A.com"), (5, "")], "page_id int, url string")
    profiles = spark.createDataFrame([("one", ["a\\.com", "("], 0), ("two", ["/x$"], 1), ("bad", ["["], 2)], "name string, domains array<string>, priority int")
    matched = lambda p: {r.page_id: r.profile and r.profile.name for r in classify.match_site_profile(pages, p).collect()}
    assert matched(profiles) == {1: "two", 2: None, 3: None, 4: None, 5: None}
    odd = spark.createDataFrame([("any", [""], 0), ("named", ["(?P<n>b)\\.o"], 1), ("any case", ["(?i)a\\.COM"], 2)], "name string, domains array<string>, priority int")
    assert matched(odd) == {1: "any case", 2: "named", 3: None, 4: "any case", 5: "any"}
    assert set(matched(profiles.limit(0)).values()) == {None}


def test_profiles_join_by_parts_of_urls_alone(spark):
    pages = stored(spark.createDataFrame([(1, "http://a.com/x", "<p>")], "page_id int, url string, html string"))
    profiles = spark.createDataFrame([("one", ["a\\.com"], 0)], "name string, domains array<string>, priority int")
    plan = classify.profile_matches(pages, profiles)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "html" not in plan


@pytest.mark.parametrize(("pattern", "part"), [("washington.com", "wash"), (r"a\.com", "a.co"), ("x|y", ""), ("(?i)abcd", ""), ("ab(cd)e", "abcd"), ("a(?:b)?cd", "cd"), ("a{2}bc", "bc"), ("^/de/$", "/de/"), ("(?:ab|cd)efg", "efg"), ("[a]bc", "abc"), ("", ""), ("(", None), (None, None), ("abc*d", "ab"), ("a(?i:bc)d", "a")])
def test_required_parts(pattern, part):
    assert classify.required_part(pattern) == part


def test_image_classes(spark):
    df = spark.createDataFrame([("http://a/spacer.gif", ""), ("data:x", ""), (None, None), ("http://a/p.jpg?blur=3", "ok"), ("http://f/styles/x.png", "Site logo"), ("http://a/reactions/emojione/1.png", "")], "src string, alt string")
    got = [tuple(r)[2:] for r in classify.classify_image_url(df).collect()]
    assert got == [(True, False, True, False, False), (True, False, True, False, True), (True, False, True, True, True), (False, True, False, False, False), (False, False, False, True, True), (False, False, True, True, True)]


def test_nested_proxies_at_any_depth(spark):
    from urllib.parse import quote

    nested = {}
    for depth in range(1, 7):
        url = "https://real.org/pic?x=1"
        for k in range(depth):
            url = f"https://p{k}.com/i?url={quote(url, safe='')}&w=1"
        nested[url] = "real.org/pic"
    check(spark, urls.url_match_key, nested)


def test_one_srcset_parser_for_columns_and_pages(spark):
    for value in ["https://x.com/w_1280,c_limit/a.jpg 1280w, https://x.com/w_640,c_limit/a.jpg 640w", "a.jpg 1x, b.jpg 2x", "a.jpg, b.jpg", "", "x.jpg 100w"]:
        got = spark.createDataFrame([(value,)], "v string").select(F.transform(text.srcset_candidates(F.col("v")), lambda x: x["url"]).alias("u")).first().u
        assert got == text.srcset_urls(value)
    assert text.srcset_urls("https://x.com/w_640,c/a.jpg 640w, https://x.com/w_1280,c/a.jpg 1280w") == ["https://x.com/w_1280,c/a.jpg", "https://x.com/w_640,c/a.jpg"]


def test_each_form_of_a_date_finds_its_groups_once(spark):
    plan = spark.range(1).select(dates.parse_date_text(F.col("id").cast("string"), F.lit(2026)).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 3 * len(dates.FORMS)
