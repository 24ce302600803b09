import datetime
import random

import numpy as np
import pytest
from conftest import parts_of
from pyspark.sql import functions as F

from readloom.operators import assets, bundle, discovery, forum, jobs, threads, transcripts, translate
from readloom.sources import readers, sinks

D = datetime.date


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# no\n\n  https://a.com  \n # kept\nhttps://b.com\n")
    assert sorted(r.url for r in readers.read_url_list(spark, str(tmp_path / "u.txt")).collect()) == ["# kept", "https://a.com", "https://b.com"]
    (tmp_path / "p.json").write_text('[{"name":"A","domains":["a.com"]},{"domains":["b.com"],"driver":"forum"}]')
    assert rows(readers.read_site_profiles(spark, [str(tmp_path / "p.json")]).select("name", "driver", "priority"), "priority") == [("A", None, 0), ("Unknown", "forum", 1)]
    (tmp_path / "pages.json").write_text('{"url":"https://a.com","html":"<p>"}\n')
    got = readers.read_pages(spark, str(tmp_path / "pages.json"), "json").first()
    assert got.url == "https://a.com" and got.is_forum is None and got.page_htmls is None
    queue = spark.createDataFrame([(1, " https://a.com", None), (0, "https://a.com", None), (2, "ftp://x", None)], "pos int, url string, saved_at string")
    assert rows(readers.normalize_queue(queue).select("pos", "url")) == [(0, "https://a.com")]
    ch = spark.createDataFrame([("b", 1, "two"), ("b", 0, "one")], "bundle_id string, spine int, title string")
    own = spark.createDataFrame([("b", "f", 2, "late"), ("b", "f", 1, "early")], "bundle_id string, filename string, asset_no int, v string")
    sinks.write_bundle(ch, own, ch.select("bundle_id", "title"), str(tmp_path / "out"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "out/assets")).collect()] == ["early"]


ITEM = "thread_id int, id long, by string, text string, time long, kids array<long>, deleted boolean, dead boolean"


def test_forest_and_navigation(spark):
    data = [(1, 1, "a", "t", 9, [3, 4, 99], None, None), (1, 2, "b", "t", 5, [], None, None), (1, 3, None, "t", 1, [5], True, None), (1, 4, "d", "t", 1, [1, 6], None, False), (1, 5, "e", "t", 1, [], None, None), (1, 6, "f", "t", 1, None, None, None)]
    items = spark.createDataFrame(data, ITEM)
    roots = items.where("id IN (1, 2)").select("thread_id", "id")
    forest = threads.build_comment_forest(items, roots)
    assert rows(forest.select("id", "parent_id", "depth"), "path") == [(2, None, 0), (1, None, 0), (4, 1, 1), (6, 4, 2)]
    assert threads.build_comment_forest(items, roots, max_depth=0).count() == 0
    assert threads.build_comment_forest(items, roots, max_depth=1).count() == 2
    nav = {r.id: (r.parent_id, r.root_id, r.next_sibling_id, r.next_root_id) for r in threads.comment_navigation(forest).collect()}
    assert nav == {2: (None, None, None, 1), 1: (None, None, None, None), 4: (1, 1, None, None), 6: (4, 1, None, None)}
    html = rows(threads.render_threads(threads.comment_navigation(forest)), "root_pos")
    assert len(html) == 2 and all(h.count("<div") == h.count("</div>") for *_, h in html) and html[1][2].index("c_1") < html[1][2].index("c_6")


def walked(items, roots, max_depth):
    """(thread, id, parent, path) by a plain walk, level by level."""
    live = {(t, i): (time, kids or []) for t, i, _, _, time, kids, deleted, dead in items if not deleted and not dead}
    level = []
    for t in sorted({t for t, _ in roots}):
        tops = sorted((live[t, i][0] or 0, i) for _, i in {r for r in roots if r[0] == t} if (t, i) in live)
        level += [((t, i), None, [n]) for n, (_, i) in enumerate(tops)]
    out, depth = {}, 0
    while level and (max_depth is None or depth < max_depth):
        new = {}
        for node, parent, path in level:
            out[node] = (parent, path)
        for (t, i), _, path in sorted(level, key=lambda x: (x[0][0], x[2])):
            for pos, kid in enumerate(live[t, i][1]):
                if (t, kid) in live and (t, kid) not in out:
                    new.setdefault((t, kid), ((t, kid), i, [*path, pos]))
        level, depth = list(new.values()), depth + 1
    return sorted((*node, *rest) for node, rest in out.items())


@pytest.mark.parametrize("max_depth", [None, 3])
def test_forest_equals_a_walk(spark, max_depth):
    rng, data = random.Random(7), []
    for t in range(12):
        n = 30
        kids = {i: [] for i in range(n)}
        for i in range(1, n):  # a tree; in some threads items are shared, in some loops hang loose
            kids[rng.randrange(i)].append(i)
            if t % 4 == 1 and rng.random() < 0.2:
                kids[rng.randrange(n)].append(i)
        if t % 4 == 2:
            kids |= {100: [101, 103], 101: [100], 103: [], 104: [104]}
        data += [(t, i, "a", "t", rng.randrange(9), k, rng.random() < 0.05, None) for i, k in kids.items()]
    items = spark.createDataFrame(data, ITEM)
    roots = [(t, 0) for t in range(12)] + [(3, 5), (7, 0)]
    got = threads.build_comment_forest(items, spark.createDataFrame(roots, "thread_id int, id long"), max_depth)
    assert sorted((r.thread_id, r.id, r.parent_id, r.path) for r in got.collect()) == walked(data, roots, max_depth)


def test_deep_chains_take_few_rounds(spark, monkeypatch):
    depth, written = 3000, []
    items = spark.createDataFrame([(1, i, "a", "t", i, [i + 1], None, None) for i in range(depth)], ITEM)
    keep = threads.stored
    monkeypatch.setattr(threads, "stored", lambda df: (written.append(1), keep(df))[1])
    got = threads.build_comment_forest(items, items.where("id = 0").select("thread_id", "id"))
    assert got.count() == depth and got.agg(F.max("depth")).first()[0] == depth - 1
    assert len(written) < 24


def test_flatten_comments(spark):
    reddit = '[{"data":{"children":[]}},{"data":{"children":[{"kind":"t1","data":{"id":"a","author":"x","body_html":"&lt;p&gt;hi&lt;/p&gt;","created_utc":1,"replies":{"data":{"children":[{"kind":"t1","data":{"id":"b"}}]}}}},{"kind":"more"}]}}]'
    sub = '{"comments":[{"id":1,"body":"q","children":[{"id":2,"name":"N","body":"r"}]}]}'
    df = spark.createDataFrame([(1, reddit), (2, "broken"), (3, None)], "thread_id int, payload string")
    assert rows(threads.flatten_comments(df, "reddit").select("id", "parent_id", "author", "text"), "id") == [("a", None, "u/x", "<p>hi</p>"), ("b", "a", "[deleted]", "<p>[deleted]</p>")]
    one = spark.createDataFrame([(1, sub)], "thread_id int, payload string")
    assert rows(threads.flatten_comments(one, "substack").select("id", "parent_id", "author"), "id") == [("1", None, "Anonymous"), ("2", "1", "N")]


def test_top_roots(spark):
    data = [("v", 0, "a.1", "a"), ("v", 1, "a", None), ("v", 2, "a.2", "a"), ("v", 3, "b", None), ("v", 4, "x", "a"), ("v", 5, "c", None), ("v", 6, "c.1", "c")]
    df = spark.createDataFrame(data, "thread_id string, pos int, id string, parent_id string")
    assert [r[2] for r in rows(threads.top_roots_with_replies(df, 2), "pos")] == ["a", "a.2", "b"]


def test_stitching(spark):
    pages = spark.createDataFrame([("t", 1, 0, "x", "u1"), ("t", 1, 1, "y", "u1"), ("t", 2, 2, "x", "u2"), ("t", 4, 3, "x", "u4"), ("r", 1, 0, "x", "u"), ("r", 2, 0, "x", "u"), ("n", 2, 0, "x", "u"), ("s", 1, 0, " ", "u")], "thread_url string, page int, seq int, html string, final_url string")
    posts = spark.createDataFrame([(t, p, i) for t in "trns" for p in (1, 2, 4) for i in (0, 1)], "thread_url string, page int, pos int")
    got = lambda **k: [r[:3] for r in rows(forum.stitch_forum_threads(pages, posts, **k), "thread_url", "spine")]
    assert got() == [("r", 1, 0), ("r", 1, 1), ("t", 1, 0), ("t", 1, 1), ("t", 2, 0), ("t", 2, 1)]
    assert got(page_spec="4,1", max_posts=3)[-3:] == [("t", 1, 0), ("t", 1, 1), ("t", 4, 0)]
    assert len(got(max_pages=1)) == 4


def test_quote_links(spark):
    html = '<a class="bbCodeBlock-sourceJump" rel="nofollow" href="/goto/post?id=7#post-7">up</a><a href="#post-7">plain</a>'
    df = spark.createDataFrame([("t", 0, "post-7", "7", "post-7", "<p>x</p>"), ("t", 1, "post-8", "8", "post-8", html), ("u", 0, "post-8", "8", "post-8", html)], "thread_url string, spine int, id string, numeric_id string, anchor_id string, html string")
    got = {(r.thread_url, r.spine): r.html for r in forum.rewrite_quote_links(df).collect()}
    assert 'href="#p_post-7"' in got["t", 1] and 'href="#post-7"' in got["t", 1] and "nofollow" not in got["t", 1] and "#p_" not in got["u", 0]


def test_discovery_parses_the_frontier_alone(spark, monkeypatch):
    """A crawl of many pages, of which only those that a seed stands on are parsed."""
    html = lambda n: f'<a href="/list/{n}">Next</a><a href="/a-post-{n}">Post</a>'
    data = [(n, f"https://ex.com/list/{n}", html(n + 1)) for n in range(200)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    asked = []
    parse = discovery.extract.extract_next_page
    monkeypatch.setattr(discovery.extract, "extract_next_page", lambda p, *a: (asked.append(p.count()), parse(p, *a))[1])
    seeds = spark.createDataFrame([(0, "https://ex.com/list/0"), (1, "https://ex.com/list/100"), (2, "https://ex.com/none")], "seed_idx int, url string")
    for fetch in (1000, 0):  # by ids, and joined
        monkeypatch.setattr(discovery, "FETCH", fetch)
        asked.clear()
        got = discovery.follow_listing_pages(seeds, pages, max_pages=4)
        assert sorted((r.seed_idx, r.page_idx, r.page_id) for r in got.collect()) == [(0, k, k) for k in range(4)] + [(1, k, 100 + k) for k in range(4)]
        assert asked == [2, 2, 2]


def test_discovery(spark):
    listing = '<p><a href="/post-b">B</a> 2025-08-16</p><p><a href="/post-a">A</a> 2025-08-15</p><p><a href="/post-c">C</a></p><a href="/list/2">Next</a>'
    pages = spark.createDataFrame([(1, "https://ex.com/list", listing), (2, "https://ex.com/list/2", '<p><a href="/post-d">D</a> 2025-08-20</p><a href="/list">Next</a>'), (3, "https://ex.com/post-c", "<time datetime='2025-08-17'>x</time>")], "page_id long, url string, html string")
    seeds = spark.createDataFrame([(0, "https://ex.com/list"), (1, "https://ex.com/list/")], "seed_idx int, url string")
    got = [(r.url[-6:], r.published_date) for r in discovery.discover_posts(seeds, pages).orderBy("rank").collect()]
    assert got == [("post-a", D(2025, 8, 15)), ("post-b", D(2025, 8, 16)), ("post-c", D(2025, 8, 16)), ("post-d", D(2025, 8, 20))]
    got = [r.url[-6:] for r in discovery.discover_posts(seeds, pages, start="2025-08-16", end="2025-08-17", descending=True, mode="shallow", include_undated=True).orderBy("rank").collect()]
    assert got == ["post-b", "post-c"]
    with pytest.raises(ValueError):
        discovery.discover_posts(seeds.where("false"), pages)
    feeds = spark.createDataFrame([("https://ex.com/rss", "<rss><item><link>/post-z</link></item></rss>")], "feed_url string, xml string")
    assert [r.url for r in discovery.feed_fallback(seeds.where("seed_idx = 0"), seeds.where("false"), feeds).collect()] == ["https://ex.com/post-z"]


ASSET = "bundle_id string, book_idx int, asset_idx int, filename string, content binary, original_url string, alt_urls array<string>"


def greedy(data):
    hashes, keys, out = {}, {}, {}
    for _, b, i, name, content, url, alts in sorted(data, key=lambda r: (r[1], r[2])):
        own = [u for x in [url, *(alts or [])] if x for u in (x, x.replace("https://", "").replace("http://", "").rstrip("/").lower())]
        hit = hashes.get(content) if content else None
        hit = hit or next((keys[k] for k in own if k in keys), None)
        out[b, i] = hit or name
        if not hit:
            keys.update(dict.fromkeys(own, name))
            if content:
                hashes[content] = name
    return out


def test_asset_dedupe_is_greedy(spark):
    import random

    rng = random.Random(4)
    data = [("x", n // 9, n, f"f{n}", rng.choice([None, b"", b"1", b"2", b"3", bytes([n])]), rng.choice([None, f"https://a.com/{rng.randrange(9)}/", f"http://a.com/{rng.randrange(40)}"]), rng.choice([None, [f"https://b.com/{rng.randrange(30)}"]])) for n in range(90)]
    got = {(r.book_idx, r.asset_idx): r.kept_filename for r in assets.dedupe_assets(spark.createDataFrame(data, ASSET).repartition(3)).collect()}
    assert got == greedy(data)


def test_filenames_equal_naming_in_order(spark):
    import random

    rng, data = random.Random(5), []
    for n in range(300):
        name = rng.choice(["a", "src1_a", "a_2", "src1_a_2", "src2_src1_a", "b", "", "c_d", "src_e", "src1", "2", "src1_2"]) + rng.choice([".png", ".jpg"])
        data.append((rng.choice(["x", "y"]), rng.randrange(4), n, rng.choice(["images/", "", "images/deep/"]) + name, b"1", None, None))
    data.append(("y", 1, 300, None, None, None, None))
    got = {(r.bundle_id, r.book_idx, r.asset_idx): r.new_filename for r in assets.assign_filenames(spark.createDataFrame(data, ASSET).repartition(5)).collect()}
    assert len(got) == len(data) == len({(k[0], v) for k, v in got.items()})
    used = set()
    for bundle_id, book, n, path, *_ in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        folder, _, base = (path or "").rpartition("/")
        dot = base.rfind(".")
        root, ext = (base[:dot], base[dot:]) if dot > 0 else (base, "")
        if base.startswith("."):
            root, ext = base, ""
        want = got[bundle_id, book, n]
        head, tail = want.rpartition("/")[::2]
        assert head == (folder or "images")
        if ext and root:
            tries = [f"{root}{ext}", f"src{book}_{root}{ext}", *[f"src{book}_{root}_{k}{ext}" for k in range(2, 400)]]
            assert tail == next(t for t in tries if (bundle_id, head, t) not in used)
        used.add((bundle_id, head, tail))


def test_assets(spark):
    data = [("x", 1, 0, "images/a.png", b"1", "https://a.com/photo-final.jpg", None), ("x", 2, 0, "images/a.png", b"22", None, None), ("x", 2, 1, "images/a.png", b"", None, None), ("x", 2, 2, "b", b"1", None, None)]
    df = spark.createDataFrame(data, ASSET)
    assert [r.new_filename for r in assets.assign_filenames(df).orderBy("book_idx", "asset_idx").collect()] == ["images/a.png", "images/src2_a.png", "images/src2_a_2.png", "images/b.img"]
    got = assets.check_image_budget(df, "compact", max_images=3).first()
    assert (got.images, got.bytes, got.over) == (4, 4, True) and got.largest[0].filename == "images/a.png"
    assert not assets.check_image_budget(df, "full").first().over
    th = df.select(F.lit("t").alias("thread_url"), (F.col("book_idx") * 10 + F.col("asset_idx")).alias("asset_idx"), "filename", "content")
    assert [r.kept for r in assets.dedupe_thread_assets(th).orderBy("asset_idx").collect()] == [True, True, True, False]
    own = df.withColumn("book_id", F.lit(1))
    images = spark.createDataFrame([(1, 0, "http://www.a.com/photo-final.jpg?x"), (1, 1, "https://b.org/photo-final.jpg"), (1, 2, "https://b.org/image.jpg")], "book_id int, image_idx int, url string")
    assert [r.filename for r in assets.match_assets(images, own).orderBy("image_idx").collect()] == ["images/a.png", "images/a.png", None]
    ch = spark.createDataFrame([(1, '<img alt="" src="images/b">')], "book_id int, content_html string")
    two = spark.createDataFrame([(1, "images/b"), (1, "images/c"), (2, "images/d")], "book_id int, filename string")
    assert rows(assets.retain_referenced_assets(ch, two), "book_id") == [(1, "images/b"), (2, "images/d")]
    names = spark.createDataFrame([(1, "images/b", "images/z")], "book_id int, old string, new string")
    assert 'src="images/z"' in assets.remap_image_refs(ch, names).first().content_html


def test_bundles(spark):
    books = spark.createDataFrame([("b", 1, "Article One", "https://www.a.com/1", D(2025, 8, 15), "S"), ("b", 2, "Two", "https://a.com/2", None, "S2")], "bundle_id string, book_idx int, title string, url string, published_date date, saved_at string")
    ch = spark.createDataFrame([("b", 1, 0, "t", "article.xhtml", True, False, None), ("b", 1, 1, "c", "comments.xhtml", False, True, None), ("b", 2, 0, "x", "x.xhtml", False, False, None)], "bundle_id string, book_idx int, chapter_idx int, title string, filename string, is_article boolean, is_comments boolean, saved_at string")
    spine, toc = bundle.build_bundle(books, ch)
    assert [r.filename for r in spine.orderBy("spine").collect()] == ["b1_article.xhtml", "b1_comments.xhtml", "b2_x.xhtml"]
    got = toc.collect()
    assert [(r.label, r.filename, [c.title for c in r.children]) for r in got] == [("2025-08-15 - Article One", "b1_article.xhtml", ["c"])]
    assert bundle.bundle_titles(books, start="2025", end="2026").first().title == "a.com_2025_to_2026"
    assert bundle.bundle_titles(books, today="2026-01-01").first().title == "a.com_2026-01-01"
    assert [r.saved_at for r in bundle.apply_saved_at(books, ch).orderBy("book_idx", "chapter_idx").collect()] == ["S", None, "S2"]
    toc_in = spark.createDataFrame([("b", 0, "u", "", "Book title", None, "Book title", [(1, "p1"), (2, "p1")]), ("b", 1, "u", "", "Second", "Short", "Book title", None)], "bundle_id string, spine int, uid string, filename string, title string, toc_title string, bundle_title string, page_labels array<struct<page:int,id:string>>")
    assert rows(bundle.toc_entries(toc_in).select("anchor", "label"), "label") == [("u", "Book title"), ("p1", "Page 1"), ("u-1", "Short")]


def test_translation(spark):
    html = '<h1>Head</h1><p>Body line</p><ul><li>Item</li><li><p>In item</p></li></ul><figcaption>Cap</figcaption><div class="post-meta"><p>meta</p></div><pre><p>code</p></pre><div class="comment-body">comment</div><p>12 - 3</p>'
    ch = spark.createDataFrame([(1, 0, "Head", html, True, False)], "book_id int, chapter_idx int, title string, content_html string, is_article boolean, is_comments boolean")
    texts = lambda scope: [(r.kind, r.text) for r in translate.extract_translation_units(ch, scope).orderBy("unit_idx").collect()]
    assert texts("article-captions") == [("body", "Head"), ("body", "Body line"), ("body", "Item"), ("body", "In item"), ("caption", "Cap")]
    assert ("caption", "Cap") not in texts("article") and ("body", "comment") in texts("all-readable")
    units = translate.extract_translation_units(ch)
    memory = spark.createDataFrame([("x", "y")], "cache_key string, translated_text string")
    plan = translate.plan_translation(units, memory, "llm", "auto:", "en", "de")
    assert plan.where("missing").count() == 5
    assert translate.plan_translation(units, memory, "llm", "auto:", "English", "en-GB").where("NOT missing AND translated_text = text").count() == 5
    done = translate.translate_missing(translate.batch_texts(plan.where("missing"), most=2), lambda t: [x.upper() for x in t])
    full = translate.apply_translations(ch, units, done, "popup_footnote").first().content_html
    assert full.count("noteref") == 5 and 'id="tr5"' in full
    out = translate.apply_translations(ch, units, done, "replace").first()
    assert out.title == "HEAD" and "<p>BODY LINE</p>" in out.content_html and "code" in out.content_html
    assert "original" in translate.apply_translations(ch, units, done, "side_by_side").first().content_html
    with pytest.raises(Exception, match="no translation"):
        translate.apply_translations(ch, units, done.limit(0)).collect()


def packed(sizes, most, chars):
    """Batch numbers, text by text."""
    out, n, held, batch = [], 0, 0, 0
    for w in sizes:
        if n and (n >= most or held + w > chars):
            batch, n, held = batch + 1, 0, 0
        n, held = n + 1, held + w
        out.append(batch)
    return out


@pytest.mark.parametrize(("most", "chars"), [(20, 9000), (4, 50), (1, 10), (500, 700)])
def test_one_bucket_over_many_parts(spark, most, chars):
    rng = random.Random(most)
    sizes = [rng.choice([1, 3, 17, 60, rng.randrange(1, 400)]) for _ in range(3000)]
    data = [(("b", i // 100, i % 100), f"{i:04d}" + "x" * n) for i, n in enumerate(sizes)]
    want = packed([n + 4 for n in sizes], most, chars)
    rng.shuffle(data)
    df = spark.createDataFrame(data, "first_seen struct<book_id:string,chapter_idx:int,unit_idx:int>, text string").repartition(3)
    with parts_of(spark, 11):
        got = {int(r.text[:4]): r.batch for r in translate.batch_texts(df, most, chars).collect()}
        chunks = {int(r.text[:4]): r.batch for r in translate.chunk_texts(df, 7).collect()}
    assert [got[i] for i in range(3000)] == want
    assert [chunks[i] for i in range(3000)] == [i // 7 for i in range(3000)]


def test_batches_of_parts_compose():
    rng = np.random.default_rng(2)
    for most, chars in ((20, 300), (3, 1000), (50, 90)):
        machine = translate.Packing(most, chars)
        for n in (1, 2, 19, 300):
            sizes = rng.integers(0, 80, n)
            flags, after = machine.run(None, sizes)
            assert np.cumsum(flags).tolist() == [b + 1 for b in packed(sizes.tolist(), most, chars)]
            assert machine.after(None, machine.summary(sizes)) == (after, flags.sum())
            for state in ((1, 5), (most, 40), (1, 5000), (min(2, most), chars)):
                flags, after = machine.run(state, sizes)
                assert machine.after(state, machine.summary(sizes)) == (after, flags.sum())


def test_batches_and_glossary(spark):
    df = spark.createDataFrame([(("b", 0, i), "x" * n) for i, n in enumerate([5, 5, 5, 9, 1])], "first_seen struct<book_id:string,chapter_idx:int,unit_idx:int>, text string")
    got = translate.batch_texts(df, most=2, chars=10).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [2, 1, 2]
    assert sorted(r.batch for r in translate.chunk_texts(df, 2).collect()) == [0, 0, 1, 1, 2]
    assert translate.parse_glossary("# c\nab=x\nabc\tY\nq\n") == [("abc", "Y"), ("ab", "x"), ("q", "q")] and translate.parse_glossary('{"k": ""}') == [("k", "k")]
    terms = [("abc", "Y"), ("ab", "x")]
    held = translate.protect_terms(F.lit("abc ab"), terms)
    assert spark.range(1).select(held, translate.restore_terms(held, terms)).first()[:] == ("__TERM_0__ __TERM_1__", "Y x")
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(texts) > 2:
            raise RuntimeError
        return texts

    assert translate._halved(list("abcd"), flaky) == list("abcd") and calls == [4, 4, 2, 2]
    mem = spark.createDataFrame([("k", "old", 9), ("m", "keep", 1)], "cache_key string, translated_text string, created_at int")
    new = spark.createDataFrame([("k", "a", 1), ("k", "b", 2)], "cache_key string, translated_text string, created_at int")
    assert rows(translate.upsert_memory(mem, new), "cache_key") == [("k", "b", 2), ("m", "keep", 1)]


def test_transcripts(spark):
    tracks = spark.createDataFrame([("v", 0, "fr", False), ("v", 1, "en-US", True), ("v", 2, "en", False)], "video_id string, track_idx int, language_code string, is_generated boolean")
    assert transcripts.select_track(tracks, ["en"]).first().track_idx == 2 and transcripts.select_track(tracks, ["en"], prefer_auto=True).first().track_idx == 1 and transcripts.select_track(tracks, []).first().track_idx == 0
    seg = spark.createDataFrame([("v", float(s), 10.0, "t") for s in (0, 10, 20, 80, 90)], "video_id string, start double, duration double, text string")
    assert rows(transcripts.thumbnail_slots(seg), "ratio") == [("v", 0.25, 80.0), ("v", 0.5, 90.0)]
    assert transcripts.thumbnail_slots(seg.where("start < 20")).count() == 0


def test_jobs(spark):
    t = spark.createDataFrame([("j", i, f"u{i}", 10 * (i % 3), i != 2, None) for i in range(7)], "job_id string, seq int, url string, duration_ms long, success boolean, error_type string")
    r = jobs.job_summary(t).first()
    assert (r.total, r.processed, r.failed) == (7, 6, 1) and r.failed_sources[0] == ("u2", "Unknown") and [s.url for s in r.slowest] == ["u2", "u5", "u1", "u4", "u0"]
    j = spark.createDataFrame([("a", "completed", "1000"), ("b", "running", "0"), ("c", "failed", "9000"), ("d", "failed", "x")], "job_id string, status string, updated_at string")
    assert [x.job_id for x in jobs.expire_jobs(j, now=9000.0).orderBy("job_id").collect()] == ["b", "c"]


STAGE = "job_id string, seq int, event_ts timestamp, event string, stage string"


def test_stages_open_repeated_and_late(spark, tmp_path):
    from readloom.streaming import streams

    at = lambda n: datetime.datetime(2025, 1, 1, 0, 0, n)
    data = [("j", 1, at(0), "job_start", None), ("j", 2, at(1), "stage_start", "a"), ("j", 3, at(4), "stage_done", "a"), ("j", 9, at(9), "stage_start", "a"), ("j", 5, at(5), "stage_start", "a"), ("j", 6, at(6), "stage_done", "b"), ("j", 7, at(8), "stage_done", "b"), ("k", 1, at(3), "stage_done", "a"), ("k", 2, at(3), "stage_start", "a"), ("k", 3, None, "stage_done", "a"), ("k", 4, at(4), "other", "a")]
    events = spark.createDataFrame(data, STAGE)
    got = [(r.job_id, r.stage, r.state, r.duration_ms) for r in jobs.stage_durations(events).orderBy("job_id", "stage", "run").collect()]
    assert got == [("j", "a", "closed", 3000), ("j", "a", "restarted", None), ("j", "a", "open", None), ("j", "b", "unstarted", 2000), ("j", "b", "unstarted", 2000), ("k", "a", "unstarted", None), ("k", "a", "open", None)]
    t = spark.createDataFrame([("j", 0, "u", 5, True, None), ("z", 0, "u", 5, True, None)], "job_id string, seq int, url string, duration_ms long, success boolean, error_type string")
    stages = {r.job_id: r.stages and [tuple(x) for x in r.stages] for r in jobs.job_summary(t, stages=events).collect()}
    assert stages == {"j": [("a", 1, 3000), ("b", 2, 4000)], "z": None}
    # as a stream, file by file: a start waits for its done, or is told as open
    hour = lambda n, **k: datetime.datetime(2025, 1, 1 + n // 24, n % 24, **k)
    files = [[("j", 1, hour(1), "stage_start", "a"), ("j", 2, hour(1), "stage_start", "b")], [("j", 3, hour(2), "stage_done", "a"), ("j", 4, hour(20), "stage_start", "c")], [("j", 5, hour(40), "stage_done", "c")], [("j", 7, hour(41), "stage_start", "d")], [("j", 6, hour(1), "stage_done", "b")]]
    for n, part in enumerate(files):
        spark.createDataFrame(part, STAGE).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    feed = spark.readStream.schema(STAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    streams.stream_stage_durations(feed, late="1 hour", longest="20 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.stage, r.state, r.duration_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "closed", 3_600_000), ("b", "open", None), ("c", "closed", 72_000_000)]


def test_memory_store_rewrites_touched_buckets_only(spark, tmp_path):
    path, kind = str(tmp_path / "store"), "cache_key string, translated_text string, created_at int"
    memory = spark.createDataFrame([(f"k{i}", "old", i) for i in range(200)], kind)
    translate.write_memory(memory, path, 16)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([("k3", "new", 1), ("k3", "newer", 2), ("fresh", "x", 3)], kind)
    translate.upsert_memory_store(spark, path, new)
    want = translate.upsert_memory(memory, new)
    assert rows(translate.read_memory(spark, path).select(want.columns), "cache_key") == rows(want, "cache_key")
    gone = {f.parent.name for f in before.keys() - files().keys()}
    assert 1 <= len(gone) <= 2 and all(files()[f] == t for f, t in before.items() if f.parent.name not in gone)
    translate.upsert_memory_store(spark, path, new.limit(0))
    assert translate.read_memory(spark, path).count() == 201


def test_streams_drop_late_rows_and_repeats(spark, tmp_path):
    from readloom.streaming import streams

    src = tmp_path / "in"
    for n, (hour, url) in enumerate([(1, "https://a.com"), (5, " https://a.com "), (5, "https://a.com"), (1, "https://b.com")]):
        spark.createDataFrame([(url, datetime.datetime(2025, 1, 1, hour), 5, False)], "url string, ts timestamp, ms long, ok boolean").coalesce(1).write.mode("append").parquet(str(src / f"{n}"))
    read = lambda: spark.readStream.schema("url string, ts timestamp, ms long, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    run = lambda s, name: s.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start().awaitTermination()
    run(streams.stream_queue(read().select("url", F.col("ts").alias("saved_at")), "12 hours"), "q")
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "q")).collect()) == ["https://a.com", "https://b.com"]
    run(streams.stream_job_timings(read().select(F.lit("j").alias("job_id"), F.col("ms").alias("duration_ms"), F.col("ok").alias("success"), F.col("ts").alias("event_ts"))), "t")
    # the last row comes after the watermark has passed its window
    assert [(r.total, r.failed) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [(1, 1)]


def test_merged_stories_keep_all_comments(spark):
    stories = spark.createDataFrame([(1, "A", "http://www.ex.com/a?x", None), (2, "B", None, "self"), (3, "C", "http://ex.com/c", None)], "story_id int, title string, url string, text string")
    books = spark.createDataFrame([(7, "https://ex.com/a/"), (8, "https://ex.com/c")], "book_id int, source_url string")
    ch = spark.createDataFrame([(7, 0, "a.xhtml", "x", False), (7, 1, "c.xhtml", "said there", True), (8, 0, "c.xhtml", "only", True)], "book_id int, chapter_idx int, filename string, content_html string, is_comments boolean")
    comments = spark.createDataFrame([(1, 1, "<b>"), (1, 0, "<a>"), (3, 0, "<c>")], "story_id int, root_pos int, html string")
    merged = threads.merge_linked_articles(stories, books, ch, comments)
    assert rows(merged.drop("title"), "story_id", "chapter_idx") == [
        (1, "article", 0, "linked_a.xhtml", "x"), (1, "source_comments", 1, "linked_c.xhtml", "said there"), (1, "story_comments", 2, "story_comments.xhtml", "<a><b>"),
        (2, "article", 0, "article.xhtml", "self"), (3, "source_comments", 0, "linked_c.xhtml", "only"), (3, "story_comments", 1, "story_comments.xhtml", "<c>"),
    ]
    toc = [(r.story_id, r.label, r.filename, [tuple(c) for c in r.children]) for r in threads.linked_toc(merged).orderBy("story_id", "place").collect()]
    source, story = ("Source comments", "linked_c.xhtml"), ("Story comments", "story_comments.xhtml")
    assert toc == [(1, "Article", "linked_a.xhtml", [source, story]), (2, "Article", "article.xhtml", []), (3, *source, []), (3, *story, [])]


def test_a_folder_of_bundles_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(64).selectExpr("id % 16 AS bundle_id", "id AS spine", "id AS asset_no", "CAST(id AS string) AS filename")
    with parts_of(spark, 4):
        sinks.write_bundle(rows, rows, rows, str(tmp_path), parts=1)
    files = sorted((tmp_path / "chapters" / "part=0").glob("*.parquet"))
    held = [{r.bundle_id for r in spark.read.parquet(str(f)).select("bundle_id").distinct().collect()} for f in files]
    assert len(files) > 1 and sum(map(len, held)) == 16 and len(set().union(*held)) == 16


def test_saved_times_sort_chapters_once(spark):
    with parts_of(spark, 4):
        chapters = spark.range(8).selectExpr("0 AS bundle_id", "id % 2 AS book_idx", "id AS chapter_idx", "id % 3 = 1 AS is_article", "CAST(NULL AS string) AS saved_at")
        books = spark.range(2).selectExpr("0 AS bundle_id", "id AS book_idx", "'t' AS saved_at")
        out = bundle.apply_saved_at(books, chapters)
        assert {(r.book_idx, r.chapter_idx) for r in out.where("saved_at = 't'").collect()} == {(0, 4), (1, 1)}
        assert out._jdf.queryExecution().sparkPlan().toString().count("Window [") >= 1
        sorted_by = [line for line in out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines() if "Sort [" in line and "chapter_idx" in line.split("Sort [")[1].split("]")[0]]
        assert len(sorted_by) == 1 and not any("able" in line.split("Sort [")[1].split("]")[0] for line in sorted_by)


def test_a_url_is_asked_for_by_two_keys_at_most(spark):
    """The raw url is a key of its own only where the match key is empty."""
    rows = ["http://www.Ex.com/a/Picture-1.JPG?w=1#b", "https://ex.com/img.jpg", "https://", "", None, "a/b/\n", "https://ex.com/12345678.png", "?x=/long-name.jpg", "http://e.com/p?url=https%3A%2F%2Fo.org%2Fsome-name.gif"]
    out = spark.createDataFrame(list(enumerate(rows)), "i int, u string").select("i", assets.reference_keys(F.col("u")).alias("k")).orderBy("i").collect()
    assert [r.k for r in out] == [
        ["key ex.com/a/picture-1.jpg", "name picture-1.jpg"], ["key ex.com/img.jpg"], ["raw https://"], ["raw "], [], ["key a/b\n"], ["key ex.com/12345678.png"], ["raw ?x=/long-name.jpg"], ["key o.org/some-name.gif"],
    ]


def test_stages_that_share_a_bucket_are_paired_apart(spark, tmp_path):
    """With few buckets the state has as many rows, whatever the stages."""
    from readloom.streaming import streams

    hour = lambda n: datetime.datetime(2025, 1, 1 + n // 24, n % 24)
    first = [(f"j{i}", 1, hour(1), "stage_start", None if i % 2 else "a") for i in range(40)]
    second = [(f"j{i}", 2, hour(2), "stage_start" if i % 3 else "stage_done", None if i % 2 else "a") for i in range(20)] + [("k", 0, None, "stage_done", "a"), ("k", 1, hour(2), "stage_done", "a")]
    third = [("late", 3, hour(60), "stage_start", "a")]
    # in the batch after the watermark has passed the starts, their bucket gets another event
    for n, part in enumerate([first, second, third, [("more", 4, hour(61), "stage_start", "a")]]):
        spark.createDataFrame(part, STAGE).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    feed = spark.readStream.schema(STAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = streams.stream_stage_durations(feed, late="1 hour", longest="20 hours", buckets=3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.job_id, r.stage or "", r.state, r.started_at.hour, r.duration_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    name = lambda i: (f"j{i}", "" if i % 2 else "a")
    want = [(*name(i), "restarted" if i % 3 else "closed", 1, None if i % 3 else 3_600_000) for i in range(20)]
    want += [(*name(i), "open", 2, None) for i in range(20) if i % 3] + [(*name(i), "open", 1, None) for i in range(20, 40)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3
