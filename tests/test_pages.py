import datetime

from pyspark.sql import functions as F

from readloom.functions.dom import parse
from readloom.operators import clean, extract, pagefacts

D = datetime.date
LONG = "Sentence with several words in it. " * 12


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def pages(spark, *htmls, url="https://ex.com/a"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_dom_recovers_from_broken_html():
    root = parse('<p>one<p>two<li>x<li>y</ul></b><script>var t="</p>"</script><img src=a><br/>z &amp; <b>q')
    assert [p.text() for p in root.find_all("p")][0] == "one" and "z &" in root.text() and root.find("img").attrs["src"] == "a"
    assert parse(None).text() == "" and parse("<" * 50).text()
    tree = parse('<div class="a b" id="i"><p data-x="FOObar">1</p><span><p>2</p></span></div>')
    texts = lambda s: [n.text() for n in tree.select(s)]
    assert texts("div p") == ["1", "2"] and texts("div > p") == ["1"] and texts(".b > span p") == ["2"] and texts("#i p, b") == ["1", "2"]
    assert texts("[data-x*='oob' i]") == ["1"] and texts("p[data-x^='FOO']") == ["1"] and texts("p[data-x$=bar]") == ["1"] and texts("[data-x='no']") == []
    deep = parse("<div>" * 5000 + "x")
    assert deep.text() == "x" and len(deep.html()) > 5000


def test_articles(spark):
    body = f'<html><head><title>Head</title><meta property="og:title" content="T &amp; U"><meta property="og:site_name" content="Site"></head><body><nav>menu</nav><article><h1>T</h1><p>{LONG}</p><div class="share">Share me</div><script>x()</script><div></div><p>Related stories</p></article></body></html>'
    wall = f'<body><article><p>{LONG * 6}</p></article><div class="paywall-content">pay</div></body>'
    plain = f"<body><div><p>{LONG}</p></div></body>"
    df = pages(spark, body, "<p>short</p>", None, wall, plain, "", "\x00<<<")
    got = {r.page_id: r for r in extract.extract_articles(df).collect()}
    assert got[0].success and got[0].title == "T & U" and got[0].sitename == "Site" and "Share me" not in got[0].text and "x()" not in got[0].article_html and "Related" not in got[0].text
    assert not got[1].success and got[1].error == "Content too short"
    assert not got[2].success and not got[5].success and not got[6].success
    assert got[3].is_paywall and not got[3].success and got[3].content_usable
    assert got[4].success and got[4].sitename == "ex.com"


def test_authors(spark):
    df = pages(
        spark, '<meta name="author" content="admin"><p class="byline">By Jane Doe</p>', '<meta name="author" content="Joe"><p class="byline">By Jane Doe</p>', '<a rel="author">A B</a><a rel="author">C D</a><a rel="author">a b</a>', "<p>x</p>", None,
        '<a class="author-link" href="/tag/x">Tag</a><p class="byline">By Ann</p>', '<a class="author-link" href="/author/z">Zed</a><p class="byline">By Ann</p>', '<meta name="author" content="Staff"><p class="byline">About</p>',
    )
    want = ["Jane Doe", "Joe", "A B & C D", None, None, "Ann", "Zed", "Staff"]
    assert [r.author for r in extract.extract_author(df).orderBy("page_id").collect()] == want
    assert [r.author for r in extract.extract_articles(df).orderBy("page_id").collect()] == want


def test_removal_of_widgets():
    made = lambda html: pagefacts.strip_boilerplate(parse(html).find("article")).html()
    # a heading takes the largest short block around it along, but not the article
    assert made(f"<article><p>{LONG}</p><div><div><h3>Related stories</h3></div><ul><li>one</li></ul></div></article>") == f"<article><p>{LONG}</p></article>"
    # a marked block that is long stays, unless what goes before it makes it short
    long = LONG * 7
    assert "Sentence" in made(f'<article><div class="share"><p>{long}</p></div></article>')
    assert "Sentence" not in made(f'<article><div class="popular"><p>{LONG}</p><div class="share"><p>{LONG * 5}</p></div></div></article>')
    # a note takes its box; labels go alone
    assert made("<article><section><p>This audio was generated by x.</p></section><p>Play</p><p>body</p></article>") == "<article><p>body</p></article>"
    assert made("<article>Advertisement</article>") == "<article>Advertisement</article>"


def test_published_dates(spark):
    df = pages(spark, '<script type="application/ld+json">{"a":[{"datePublished":"2025-08-15T10:00:00Z"}]}</script>', "<time datetime='2025-08-16'>x</time>", "<meta name='dc.date.issued' content='2025-08-17'>", "<meta property='article:modified_time' content='2025-08-18'>", "<p>Aug 19, 2025</p>", "none", None)
    assert [r[-1] for r in rows(extract.extract_published_date(df), "page_id")] == [D(2025, 8, 15), D(2025, 8, 16), D(2025, 8, 17), D(2025, 8, 18), D(2025, 8, 19), None, None]


def test_post_links(spark):
    html = '<a href="/about">About</a><li><a href="/first-post">First</a> <span>12</span></li><div><a href="/2024/1/2/x">X</a></div><a href="/first-post#c">again</a><a href="http://other.org/a-b">o</a>'
    df = pages(spark, html, None, url="https://ex.com/2025/08/")
    assert [r[3:] for r in rows(extract.extract_post_links(df), "page_id", "link_idx")] == [("https://ex.com/first-post", "First", D(2025, 8, 12)), ("https://ex.com/2024/1/2/x", "X", D(2024, 1, 2))]


def test_feeds(spark):
    rss = "<rss><channel><item><title>A</title><link>https://ex.com/post-a</link><pubDate>Fri, 15 Aug 2025 12:30:00 +0000</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link href="/post-b"/><updated>2025-08-16T00:00:00Z</updated></entry></feed>'
    df = spark.createDataFrame([("https://ex.com/feed", rss), ("https://ex.com/atom.xml", atom), ("https://ex.com/bad", "<x"), ("https://ex.com/none", None)], "feed_url string, xml string")
    assert sorted(r[2:] for r in rows(extract.extract_feed_posts(df), "feed_url")) == [("https://ex.com/post-a", "A", D(2025, 8, 15)), ("https://ex.com/post-b", "B", D(2025, 8, 16))]


def test_next_pages(spark):
    df = pages(spark, '<link rel="next" href="/a?p=2">', '<a href="/b/">Older posts</a>', "<p>end</p>")
    assert [r.next_url for r in extract.extract_next_page(df).orderBy("page_id").collect()] == ["https://ex.com/a", "https://ex.com/b", None]
    df = pages(spark, '<a href="/t/page-3">3</a>', '<a class="pageNav-jump--next" href="/t/page-9">n</a>', url="https://f.com/t/page-2")
    assert [r.next_url for r in extract.extract_next_page(df, forum=True).orderBy("page_id").collect()] == ["https://f.com/t/page-3", "https://f.com/t/page-9"]
    last = lambda url: extract.extract_next_page(pages(spark, '<a href="/t/z">Next ></a>', None, url=url), forum=True).orderBy("page_id").collect()
    assert [r.next_url for u in ("https://f.com/t/page-500", "https://f.com/t/page-501", "https://f.com/t/page-99999999999") for r in last(u)] == ["https://f.com/t/z", None, None, None, None, None]


def test_images(spark):
    html = """<head><meta property="og:image" content="/og.jpg"></head><article><a href="/v"><img src="/hero.jpg?x=1" alt="Hero"></a><img src="/logo.png"><img data-src="/lazy.jpg" src="data:x"><img srcset="/s.jpg 300w, /l.jpg 1200w" src="/s.jpg">
    <figure><img src="/fig.jpg"><figcaption>A caption</figcaption></figure><!-- <img src="/hidden.jpg"> --><svg data-src="/map.svg"></svg></article>"""
    df = pages(spark, html, None)
    got = extract.extract_images(df).orderBy("image_idx").collect()
    assert [r.url.removeprefix("https://ex.com") for r in got] == ["/hero.jpg?x=1", "/lazy.jpg", "/l.jpg", "/fig.jpg", "/map.svg", "/og.jpg", "/hidden.jpg"]
    assert got[0].viewer_url == "https://ex.com/v" and got[3].caption == "A caption"
    assert [r.caption for r in extract.extract_captions(df).where("url LIKE '%fig.jpg'").collect()] == ["A caption"]
    ranked = extract.rank_image_candidates(spark.createDataFrame([("https://a.com/p.jpg?w=3", "https://a.com/w.jpg 900w, https://a.com/n.jpg 90w")], "url string, srcset string"), most=9).first()
    assert ranked.candidates == ["https://a.com/w.jpg", "https://a.com/p.jpg", "https://a.com/p.jpg?w=3", "https://a.com/n.jpg"]
    meta = pages(spark, '<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","image":["/1.jpg",{"url":"/2.jpg"}]}]}</script><meta name="twitter:image" content="/3.jpg"><meta property="og:image" content="/spacer.gif">')
    assert [r.url for r in extract.extract_metadata_images(meta).orderBy("image_idx").collect()] == ["https://ex.com/1.jpg", "https://ex.com/2.jpg", "https://ex.com/3.jpg"]


def test_image_sequences(spark):
    seq = [(1, i, 0, f"https://a.com/f_{y}.jpg") for i, y in enumerate((2000, 2001, 2002, 2024))] + [(1, 9, 1, "https://a.com/x_1999.jpg")]
    df = spark.createDataFrame(seq, "page_id int, image_idx int, container int, url string")
    assert [r.url[-8:] for r in extract.collapse_image_sequences(df).orderBy("image_idx").collect()] == ["2024.jpg", "1999.jpg"]


def test_forum_and_blog_pages(spark):
    html = '<article class="message message--post" id="post-7" data-author="Ann,"><div class="message-body">Hi <b>x</b></div><time datetime="2025-01-01">t</time></article><article class="message" id="post-8"></article><article class="message" id="post-8"><div class="message-body">late</div></article>'
    df = spark.createDataFrame([("t", 1, "u", html)], "thread_url string, page int, url string, html string")
    got = extract.extract_forum_posts(df).collect()
    assert [(r.anchor_id, r.numeric_id, r.author, r.text, r.time) for r in got] == [("post-7", "7", "Ann", "Hi x", "2025-01-01")]
    blog = '<ol class="comment-list"><li class="comment" id="c1"><div class="comment-author"><span class="fn">User A</span></div><div class="comment-content">one</div><ol class="children"><li class="comment" id="c2"><div class="comment-content">two</div></li></ol></li></ol>'
    got = extract.extract_blog_comments(pages(spark, blog)).orderBy("id").collect()
    assert [(r.id, r.parent_id, r.author) for r in got] == [("c1", None, "User A"), ("c2", "c1", "Anonymous")]


def test_newsletter_ids(spark):
    df = pages(spark, r'<script>window._preloads = JSON.parse("{\"post\":{\"id\":12},\"pub\":{\"id\":3,\"subdomain\":\"ex\"}}")</script>', '<meta property="og:url" content="https://news.substack.com/p/x"><meta name="substack:post_id" content="5">')
    assert [(r.post_id, r.publication_id, r.subdomain) for r in extract.extract_newsletter_ids(df).orderBy("page_id").collect()] == [("12", "3", "ex"), ("5", None, "news")]


def test_tables(spark):
    html = "<h2>Scores</h2><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><table><tr><td>one</td></tr></table>"
    df = spark.createDataFrame([(0, "https://ex.com/results", html), (1, "https://ex.com/a", '<a href="/results">Full results</a>')], "page_id long, url string, html string")
    got = extract.extract_tables(df).collect()
    assert [(r.page_id, r.heading, r.rows) for r in got] == [(0, "Scores", [["a", "b"], ["1", "2"]])]
    assert [(r.page_id, r.table_page_id) for r in extract.linked_tables(df).collect()] == [(1, 0)]


def test_summaries(spark):
    ch = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "book_id int, chapter_idx int, text string")
    assert extract.summary_input(ch).first().summary_text == "a\nb"
    posts = spark.createDataFrame([("t", 1, i, f"A{i}", f"x{i}") for i in range(7)], "thread_url string, page int, pos int, author string, text string")
    many = spark.createDataFrame([(1, i, c * 9) for i, c in enumerate("abcdefgh")] + [(1, 1, "b" * 9), (2, 0, None), (3, 0, "x" * 99), (None, 5, "n")], "book_id int, chapter_idx int, text string")
    assert {r.book_id: r.summary_text for r in extract.summary_input(many, 35).collect()} == {1: "a" * 9 + "\n" + "b" * 9 + "\n" + "b" * 9 + "\n" + "c" * 5, 2: "", 3: "x" * 35, None: "n"}
    assert extract.forum_summary_input(posts).first().summary_text.split("\n\n") == [f"Post by A{i}: x{i}" for i in range(5)]


def test_cleaning(spark):
    html = f'<nav>menu</nav><h1>Title of this page</h1><h2>Title of this page</h2><p>{LONG}</p><div class="social-links"><a href="#">Share</a></div><div class="footer"><p>Related</p><a>one long link text</a><a>two long link text</a><a>three long link text</a></div><div class="newsletter-wrap"><p>{LONG * 2}</p></div><span> </span>'
    df = spark.createDataFrame([(html, "Title of this page"), (None, None)], "content_html string, title string")
    got = [r.content_html for r in clean.clean_chapters(df).collect()]
    assert "menu" not in got[0] and "Share" not in got[0] and "three long" not in got[0] and got[0].count("Title of this page") == 1 and got[0].count(LONG.strip()[:40]) >= 2 and "<span>" not in got[0]
    assert got[1] is None
    tidy = lambda html, title=None: clean.cleaned(html, title)
    body = f"<p>{LONG}</p>"
    assert tidy(f'<section><h2>More on this story</h2><ul><li><a href="/a">Background timeline</a></li><li><a href="/b">What happens next</a></li><li><a href="/c">Analysis and reaction</a></li></ul></section>{body}') == body
    assert tidy(f'<div data-testid="x-byline"><img src="h.jpg"></div><section><h3>Most read</h3><p>Other one</p></section><p>Share this Tweet Email</p>{body}') == f'<div data-testid="x-byline"></div>{body}'
    assert tidy("<p>Share this with your friends, said the man.</p>") == "<p>Share this with your friends, said the man.</p>"
    contextual = f'<ul><li><a href="/a">Texas</a> {LONG}</li><li><a href="/b">Chicago</a> {LONG}</li><li><a href="/c">Spokane</a> {LONG}</li></ul>'
    assert tidy(contextual) == contextual
    title = "A title of some length"
    assert tidy(f'<body><h1>{title}</h1><div class="post-meta">Own</div><article><header class="entry-header"><h1>{title} - Site</h1><p class="byline">By X</p><img src="a"></header>{body}</article><p>Publié le 3 mai</p></body>', title) == f'<body><h1>{title}</h1><div class="post-meta">Own</div><article><header class="entry-header"><img src="a"></header>{body}</article></body>'
    assert tidy(f'<article><header><h2>{title}</h2><p>By X</p></header>{body}</article>', title) == f"<article>{body}</article>"
    assert tidy(f"<p>Posted by X</p>{body}") == f"<p>Posted by X</p>{body}"
    shot = '<figure><img src="a" alt="IMG_1"><figcaption class="wp-caption-text big" style="s">Dusk <i>here</i></figcaption><p>Dusk here</p></figure><p class="caption"> </p><div class="upper-caption caption" align="x">Up</div>'
    assert tidy(shot) == '<figure><img alt="IMG_1" src="a"><p class="image-caption big">Dusk here</p></figure><div class="upper-caption">Up</div>'
    assert clean.without_images(tidy(shot)).startswith("<p>Dusk here</p>")
    figs = spark.createDataFrame([('<figure><img src="a.jpg" alt="A red barn"><figcaption>Barn at dusk</figcaption></figure><img src="b" alt="IMG_1234"><p><a><img src=c alt="Map of town"></a></p>',)], "content_html string")
    out = clean.text_only(figs).first().content_html
    assert "Barn at dusk" in out and "[Image: A red barn]" in out and "[Image: Map of town]" in out and "1234" not in out and "<img" not in out


def test_empty_pages(spark):
    df = pages(spark)
    for job in (extract.extract_articles, extract.extract_post_links, extract.extract_images, extract.extract_published_date, extract.extract_next_page):
        assert job(df).count() == 0
    assert F is not None


def test_references_without_semicolons_are_text():
    root = parse('<title>and&amp;&amp</title><p title="x&amp;y&amp">b &lt;&quot;&eacute;&copy &ampfoo; &#65;</p><script>if (a &&b &amp) x</script><!--&amp-->')
    assert root.find("title").text() == "and&&amp" and root.find("p").attrs["title"] == "x&y&amp" and root.find("p").text() == 'b <"é&copy &ampfoo; A'
    assert root.find("script").children[0].data == "if (a &&b &amp) x" and "<!--&amp-->" in root.html()


def test_short_articles_give_their_body(spark):
    """An article of 200 characters is refused, also where it is longer with blanks between
    its pieces; one of 201 is taken, a blank at the end of a piece being one of them."""
    made = lambda n: f'<body><div class="ad">Ad</div><article><h1>One </h1><p>{"a" * (n - 14)}</p>\n <p>x</p><p>y</p><p>z</p><p>end</p><p>last</p></article></body>'
    got = [r.text for r in extract.extract_articles(pages(spark, made(200), made(201))).orderBy("page_id").collect()]
    assert got[0].startswith("Ad One aaa") and got[1].startswith("One aaa")


def test_short_pages_are_content(spark):
    """A page of 100 characters or fewer gives its body's text, unless nothing of it stays or
    a chosen body was cleaned away."""
    short = '<body><nav>Go</nav><div class="ad">Ad</div><article><h1>One</h1><p><b>One<br></article><footer>end</footer></body>'
    empty = '<body><nav>Go</nav><footer>end</footer><img src="/a-long-name-of-an-image-without-any-words.jpg"></body>'
    cleaned = f"<body><article><nav>{'go ' * 99}</nav></article></body>"
    bare = f"<body><article>{'<nav>' + 'g' * 201 + '</nav>'}</article><p>{'kept ' * 5}</p></body>"
    got = extract.extract_articles(pages(spark, short, empty, cleaned, bare)).orderBy("page_id").collect()
    assert got[0].success and got[0].text == "Ad One One" and got[0].title == "One" and "Go" not in got[0].article_html
    assert not got[1].success and got[1].error == "Content too short"
    assert not got[2].success and not got[3].success


def test_summaries_cut_after_a_line_end(spark):
    """A chapter that begins right at the cut leaves the line end before it."""
    ch = spark.createDataFrame([(1, 0, "a" * 9), (1, 1, "b" * 9), (2, 0, "a" * 9), (3, 0, "a" * 10), (3, 1, "b")], "book_id int, chapter_idx int, text string")
    assert rows(extract.summary_input(ch, 10), "book_id") == [(1, "a" * 9 + "\n"), (2, "a" * 9), (3, "a" * 10)]
