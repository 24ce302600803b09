"""Queries over page extraction, cleaning and discovery. Where the given pages lack what an
operator reads, the query adds it to the page's html from table columns."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions import urls
from readloom.functions.tables import stored
from readloom.operators import clean, discovery, extract

from .scalar_plans import _HOST, _PATH, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", "html")


def with_html(spark, d, *before):
    """pages with html pieces put in front of their own."""
    return pages(spark, d).withColumn("html", F.concat(*[F.lit(b) if isinstance(b, str) else b for b in before], "html"))


def _id():
    return F.col("page_id").cast("string")


_CANON = rf"""lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || {_HOST} ||
    CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace({_PATH}, '/+', '/', 'g'), '/$', '') END"""
_TEXT = r"""trim(regexp_replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""
_SOLID = r"""replace(replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', '', 'g'), '\s*\n\s*', '', 'g'), '&quot;', '"'), '&amp;', '&')"""
_AD = r"""trim(regexp_replace(replace(replace(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""
_BUNDLE_SQL = rf"""
    WITH c AS (SELECT *, {_CANON} AS canonical, {_HOST} AS host, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS raw FROM pages),
    f AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY page_id) AS k FROM c)
    SELECT host AS bundle_id, (row_number() OVER (PARTITION BY host ORDER BY page_id) - 1)::INTEGER AS spine, page_id, replace(replace(raw, '&quot;', '"'), '&amp;', '&') AS label FROM f WHERE k = 1"""


def site_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each site, the articles its bundle would contain, in order: one page of each
    canonical url, extracted, grouped by host. html stays out of the ranking's shuffle."""
    rows = pages(spark, sf_dir)
    key = rows.select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))
    first = key.groupBy("canonical").agg(F.min("page_id").alias("page_id")).select("page_id")
    articles = extract.extract_articles(rows.join(first, "page_id", "left_semi")).where("success")
    place = F.row_number().over(Window.partitionBy("bundle_id").orderBy("page_id")) - 1
    return articles.select(urls.host(F.col("url")).alias("bundle_id"), "page_id", F.col("title").alias("label")).withColumn("spine", place).select("bundle_id", "spine", "page_id", "label")


plan("w1_site_bundles", _BUNDLE_SQL)(site_bundles)


def _body(added: int = 0) -> str:
    """The text of each page in SQL. An article of 200 characters or fewer, counting those
    added to it, gives its body's text: what its <div class="ad"> has comes first."""
    return rf"""
    WITH t AS (SELECT page_id, url, {_TEXT} AS text, length({_SOLID}) AS solid, {_AD} AS ad FROM pages)
    SELECT page_id, url, CASE WHEN solid + {added} > 200 THEN text ELSE trim(ad || ' ' || text) END AS text FROM t"""


@plan("x1_extract_articles", rf"SELECT page_id, true AS success, {_HOST} AS sitename, text FROM ({_body()})")
def _(spark, d):
    out = extract.extract_articles(pages(spark, d))
    return out.select("page_id", "success", "sitename", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def _plain(spark, d):
    """documents with the letters of their text, words one space apart."""
    return table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")).alias("words"))


_WORDS = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'))"


@plan("x2_select_content", f"SELECT doc_id, length({_WORDS}) > 200 AS by_selector FROM documents")
def _(spark, d):
    """A content block is taken if it has more than 200 characters."""
    html = F.concat(F.lit('<body><div class="post-content"><p>'), "words", F.lit("</p></div><div><p>"), F.repeat(F.lit("other "), 90), F.lit("</p></div></body>"))
    out = extract.extract_articles(_plain(spark, d).select("doc_id", F.lit("https://ex.com/a").alias("url"), html.alias("html"), "words"))
    return out.select("doc_id", F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")) == F.col("words"), F.lit(False)).alias("by_selector"))


@plan("x3_strip_boilerplate", rf"SELECT page_id, text FROM ({_body(len('ShareRelated storiesgoxf'))})")
def _(spark, d):
    junk = '<article><div class="social-share">Share</div><p>Related stories</p><nav>go</nav><script>x</script><form>f</form>'
    rows = pages(spark, d).withColumn("html", F.replace("html", F.lit("<article>"), F.lit(junk)))
    return extract.extract_articles(rows).select("page_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@plan("x8_forum_next_page", "SELECT conv_id, turn, CASE WHEN turn <= 2 THEN 'https://f.com/t/' || conv_id || '/page-' || (turn + CASE WHEN turn = 2 THEN 7 ELSE 1 END) END AS next_url FROM conversations")
def _(spark, d):
    """Pages of forum threads, one a turn, that go on by a link tag, by the next number and by
    a jump link; later ones end."""
    n, to = F.col("turn"), lambda k: F.concat(F.lit('href="/t/'), F.col("conv_id").cast("string"), F.lit("/page-"), (F.col("turn") + k).cast("string"), F.lit('"'))
    last = F.concat(F.lit("<a "), to(9), F.lit(">Last</a>"))
    goes = F.when(n == 0, F.concat(F.lit("<link rel='prefetch next' "), to(1), F.lit(">"))).when(n == 1, F.concat(F.lit("<a "), to(1), F.lit("> <b>2</b> </a>"))).when(n == 2, F.concat(F.lit("<a class='pageNav-jump pageNav-jump--next' "), to(7), F.lit(">on</a><a "), to(1), F.lit(">Next</a>"))).otherwise("")
    url = F.concat(F.lit("https://f.com/t/"), F.col("conv_id").cast("string"), F.when(n > 0, F.concat(F.lit("/page-"), n.cast("string"))).otherwise(""))
    made = table(spark, d, "conversations").select("conv_id", "turn", url.alias("url"), F.concat(last, goes).alias("html"))
    return extract.extract_next_page(made, forum=True).select("conv_id", "turn", "next_url")


@plan("x1_profile_articles", rf"""
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Taken ' ELSE '' END || CASE WHEN page_id % 3 > 0 THEN 'Aside ' ELSE '' END || repeat('word ', 60) || 'end' || CASE WHEN page_id % 2 = 0 THEN '' ELSE ' ' || text END AS text FROM ({_body(1000)})""")
def _(spark, d):
    """A site profile's content selector takes its block, else the article; its removed
    selectors go before that."""
    words = F.concat(F.repeat(F.lit("word "), 60), F.lit("end"))
    aside = F.lit("<p class='gone'>Aside</p>")
    block = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<article><div id='own'><p>Taken</p>"), aside, F.lit("<p>"), words, F.lit("</p></div>"))).otherwise(F.concat(F.lit("<article>"), aside, F.lit("<p>"), words, F.lit("</p>")))
    rows = pages(spark, d).withColumn("html", F.replace("html", F.lit("<article>"), block))
    removed = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("p.gone"))).otherwise(F.array().cast("array<string>"))
    out = extract.extract_articles(rows.withColumn("profile", F.struct(F.lit("#own").alias("content_selector"), removed.alias("remove_selectors"))), "profile")
    return out.select("page_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@plan("x4_extract_author", "SELECT page_id, 'Writer ' || (page_id % 9) || CASE WHEN page_id % 2 = 0 THEN '' ELSE ' & Second' END AS author FROM pages")
def _(spark, d):
    n = (F.col("page_id") % 9).cast("string")
    one = F.concat(F.lit('<meta name="author" content="admin"><a rel="author">By Writer '), n, F.lit("</a>"), F.when(F.col("page_id") % 2 == 1, '<a rel="author">Second</a>').otherwise(""))
    return extract.extract_author(with_html(spark, d, one)).select("page_id", "author")


@plan("x5_extract_published_date", "SELECT page_id, DATE '2024-01-01' + (page_id % 300)::INTEGER AS published_date FROM pages")
def _(spark, d):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")).cast("string")
    forms = F.array(F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T08:00:00Z">')), F.concat(F.lit("<time datetime='"), day, F.lit("'>x</time>")), F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"datePublished":"'), day, F.lit('"}]}</script>')))
    return extract.extract_published_date(with_html(spark, d, F.get(forms, (F.col("page_id") % 3).cast("int")))).select("page_id", "published_date")


def _links():
    return [F.lit('<p><a href="/my-post-'), "page", F.lit('">Post</a> <time datetime="2024-05-06">x</time></p><p><a href="/about/">A</a><a href="/2023/4/5/a-'), "page", F.lit('?utm=1">Dated</a></p>')]


def _with_links(spark, d):
    return with_html(spark, d, *[_id() if isinstance(x, str) else x for x in _links()])


@plan("x6_extract_post_links", rf"""
    WITH b AS (SELECT page_id, regexp_extract(url, '^[a-z]+://', 0) || {_HOST} AS base FROM pages)
    SELECT page_id, base || '/my-post-' || page_id AS url, 'Post' AS title, DATE '2024-05-06' AS published_date FROM b
    UNION ALL SELECT page_id, base || '/2023/4/5/a-' || page_id, 'Dated', DATE '2023-04-05' FROM b""")
def _(spark, d):
    return extract.extract_post_links(_with_links(spark, d)).select("page_id", "url", "title", "published_date")


def _feeds(spark, d):
    site = F.concat(F.regexp_extract("url", "^[a-z]+://", 0), urls.host(F.col("url")))
    item = F.concat(F.lit("<item><title>T"), _id(), F.lit("</title><link>"), site, F.lit("/feed-post-"), _id(), F.lit("</link><pubDate>Fri, 15 Mar 2024 12:30:00 +0000</pubDate></item>"))
    return pages(spark, d).select(F.concat(site, F.lit("/feed")).alias("feed_url"), "page_id", item.alias("item")).groupBy("feed_url").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "item"))), lambda x: x["item"]), ""), F.lit("</channel></rss>")).alias("xml"))


@plan("x7_extract_feed_posts", rf"""
    SELECT regexp_extract(url, '^[a-z]+://', 0) || {_HOST} || '/feed-post-' || page_id AS url, 'T' || page_id AS title, DATE '2024-03-15' AS published_date FROM pages""")
def _(spark, d):
    return extract.extract_feed_posts(_feeds(spark, d)).select("url", "title", "published_date")


@plan("x8_extract_next_page", rf"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^[a-z]+://', 0) || {_HOST} || '/list/' || (page_id + 1) END AS next_url FROM pages")
def _(spark, d):
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<a href="/list/'), (F.col("page_id") + 1).cast("string"), F.lit('/?q=1">Older posts</a>'))).otherwise("")
    return extract.extract_next_page(with_html(spark, d, link)).select("page_id", "next_url")


def _with_images(spark, d):
    figure = F.concat(F.lit('<article><figure><img srcset="/s.jpg 300w, /wide-'), _id(), F.lit('.jpg 1200w" src="/s.jpg" alt="A view"><figcaption>Seen from '), _id(), F.lit('</figcaption></figure><img src="/logo.png"><img data-src="/lazy.jpg?w=9">'))
    return pages(spark, d).withColumn("html", F.concat(F.lit('<meta property="og:image" content="/og.jpg">'), F.replace("html", F.lit("<article>"), figure)))


_SITE = f"regexp_extract(url, '^[a-z]+://', 0) || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@plan("x9_extract_images", f"""
    SELECT page_id, unnest([0, 1, 2])::INTEGER AS image_idx, unnest([{_SITE} || '/wide-' || page_id || '.jpg', {_SITE} || '/lazy.jpg?w=9', {_SITE} || '/og.jpg']) AS url FROM pages""")
def _(spark, d):
    return extract.extract_images(_with_images(spark, d)).select("page_id", "image_idx", "url")


@plan("x10_rank_image_candidates", f"""
    SELECT page_id, unnest([0, 1, 2])::INTEGER AS image_idx,
           unnest([{_SITE} || '/wide-' || page_id || '.jpg', {_SITE} || '/lazy.jpg', {_SITE} || '/og.jpg']) AS best FROM pages""")
def _(spark, d):
    images = extract.extract_images(_with_images(spark, d)).withColumn("srcset", F.when(F.col("image_idx") == 0, F.concat("url", F.lit(" 1200w"))))
    return extract.rank_image_candidates(images).select("page_id", "image_idx", F.get("candidates", 0).alias("best"))


@plan("x11_extract_metadata_images", f"SELECT page_id, unnest([0, 1])::INTEGER AS image_idx, unnest([{_SITE} || '/j-' || page_id || '.jpg', {_SITE} || '/og.jpg']) AS url FROM pages")
def _(spark, d):
    block = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","image":{"url":"/j-'), _id(), F.lit('.jpg"}}]}</script><meta property="og:image" content="/og.jpg"><meta name="twitter:image" content="/spacer.gif">'))
    return extract.extract_metadata_images(with_html(spark, d, block)).select("page_id", "image_idx", "url")


@plan("x12_extract_captions", "SELECT page_id, 'Seen from ' || page_id AS caption FROM pages")
def _(spark, d):
    return extract.extract_captions(_with_images(spark, d)).where("image_idx = 0").select("page_id", "caption")


@plan("x13_text_only", """
    SELECT page_id, 0 AS images, concat_ws('|', CASE WHEN page_id % 4 <> 3 THEN 'Seen from ' || page_id END, CASE page_id % 4 WHEN 0 THEN '[Image: View ' || page_id || ']' WHEN 3 THEN '[Image: Map ' || page_id || ']' END,
           CASE WHEN page_id % 3 = 1 THEN '[Image: Chart ' || page_id || ']' END) AS said FROM pages""")
def _(spark, d):
    """Alt texts that say something, that say little, and that the caption holds; figures with
    and without captions."""
    n, text = F.col("page_id") % 4, lambda words: F.concat(F.lit(words), _id())
    alt = F.when(n == 0, text("View ")).when(n == 1, F.lit("image")).when(n == 2, text("FROM ")).otherwise(text("Map "))
    note = F.when(n != 3, F.concat(F.lit("<figcaption>Seen from "), _id(), F.lit("</figcaption>"))).otherwise("")
    other = F.when(F.col("page_id") % 3 == 0, "IMG_123").when(F.col("page_id") % 3 == 1, text("Chart ")).otherwise("")
    block = F.concat(F.lit('<article><figure><img src="/a.jpg" alt="'), alt, F.lit('">'), note, F.lit('</figure><img src="/b.jpg" alt="'), other, F.lit('">'))
    out = clean.text_only(pages(spark, d).withColumn("content_html", F.replace("html", F.lit("<article>"), block)))
    said = F.array_join(F.regexp_extract_all("content_html", F.lit(r"<p>(Seen from \d+|\[Image: [^\]]*\])</p>"), F.lit(1)), "|")
    return out.select("page_id", F.size(F.regexp_extract_all("content_html", F.lit("<img"), F.lit(0))).alias("images"), said.alias("said"))


@plan("x14_collapse_image_sequences", "SELECT p_partkey // 10 AS page_id, max(1990 + p_partkey % 10)::INTEGER AS year FROM part GROUP BY 1")
def _(spark, d):
    year = (1990 + F.col("p_partkey") % 10).cast("string")
    images = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).alias("page_id"), (F.col("p_partkey") % 10).cast("int").alias("image_idx"), F.lit(0).alias("container"), F.concat(F.lit("https://i.ex.com/frame_"), year, F.lit(".png")).alias("url"))
    return extract.collapse_image_sequences(images).select("page_id", F.regexp_extract("url", r"\d{4}", 0).cast("int").alias("year"))


def _table_html():
    return [F.lit("<h2>Scores</h2><table><tr><th>id</th><th>n</th></tr><tr><td>"), "page", F.lit("</td><td>1</td></tr></table>")]


@plan("x15_extract_tables", "SELECT page_id, 0::INTEGER AS table_idx, 'Scores' AS heading, page_id::VARCHAR AS cell FROM pages WHERE page_id % 2 = 0")
def _(spark, d):
    made = F.when(F.col("page_id") % 2 == 0, F.concat(*[_id() if isinstance(x, str) else x for x in _table_html()])).otherwise("")
    return extract.extract_tables(with_html(spark, d, made)).select("page_id", "table_idx", "heading", F.col("rows")[1][0].alias("cell"))


@plan("x16_extract_forum_posts", "SELECT conv_id, turn, role AS author, 'post-' || turn AS anchor_id FROM conversations")
def _(spark, d):
    return forum_posts(spark, d).select("conv_id", (F.col("page") * 2 - 2 + F.col("pos")).cast("long").alias("turn"), "author", "anchor_id")


def forum_pages(spark, d):
    """conversations as forum pages of two turns each."""
    c = table(spark, d, "conversations")
    post = F.concat(F.lit('<article class="message message--post" id="post-'), F.col("turn").cast("string"), F.lit('" data-author="'), "role", F.lit('"><div class="message-body"><p>'), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></div></article>"))
    rows = c.select("conv_id", F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("thread_url"), (F.floor(F.col("turn") / 2) + 1).cast("int").alias("page"), "turn", post.alias("post"))
    return rows.groupBy("conv_id", "thread_url", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "post"))), lambda x: x["post"]), "").alias("html")).withColumns({"url": F.concat("thread_url", F.lit("/page-"), F.col("page").cast("string")), "seq": F.col("page"), "final_url": F.lit(None).cast("string")})


def forum_posts(spark, d):
    return extract.extract_forum_posts(forum_pages(spark, d).select("conv_id", "thread_url", "page", "url", "html"))


@plan("x17_extract_blog_comments", "SELECT 'https://b.ex.com/' || conv_id AS thread_id, 'c' || turn AS id, CASE WHEN turn % 4 > 0 THEN 'c' || (turn - 1) END AS parent_id, role AS author FROM conversations")
def _(spark, d):
    """Turns in fours: each but the first is the reply to the one before it, a level deeper."""
    turn = F.col("turn").cast("string")
    opened = F.concat(F.when(F.col("turn") % 4 > 0, '<ol class="children">').otherwise(""), F.lit('<li class="comment" id="c'), turn, F.lit('"><div class="comment-author"><cite>'), "role", F.lit('</cite></div><div class="comment-content">x</div>'))
    closed = F.when(F.col("turn") % 4 > 0, "</li></ol>").otherwise("</li>")
    said = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 4).alias("four"), opened.alias("opened"), closed.alias("closed"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "opened", "closed")))
    fours = said.groupBy("conv_id", "four").agg(F.concat(F.array_join(F.transform(parts, lambda x: x["opened"]), ""), F.array_join(F.transform(F.reverse(parts), lambda x: x["closed"]), "")).alias("html"))
    lists = fours.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("four", "html"))), lambda x: x["html"]), "").alias("html"))
    made = lists.select(F.concat(F.lit("https://b.ex.com/"), F.col("conv_id").cast("string")).alias("url"), F.concat(F.lit('<ol class="comment-list">'), "html", F.lit("</ol>")).alias("html"))
    return extract.extract_blog_comments(made).select("thread_id", "id", "parent_id", "author")


@plan("x18_extract_newsletter_ids", "SELECT page_id, page_id::VARCHAR AS post_id, CASE WHEN page_id % 2 = 0 THEN 'sub' || page_id END AS subdomain FROM pages")
def _(spark, d):
    preload = F.concat(F.lit('<script>window._preloads = JSON.parse("{\\"post\\":{\\"id\\":'), _id(), F.lit('},\\"pub\\":{\\"subdomain\\":\\"sub'), _id(), F.lit('\\"}}")</script>'))
    tag = F.concat(F.lit('<meta name="substack:post_id" content="'), _id(), F.lit('">'))
    return extract.extract_newsletter_ids(with_html(spark, d, F.when(F.col("page_id") % 2 == 0, preload).otherwise(tag))).select("page_id", "post_id", "subdomain")


@plan("x19_clean_chapters", f"""
    SELECT doc_id, false AS nav, length({_WORDS}) > 360 AS menu, length({_WORDS}) > 360 AS bar, length({_WORDS}) > 500 AS cluster, true AS body FROM documents""")
def _(spark, d):
    """Menus and social bars of at most 360 characters go, longer ones are the body; so do
    clusters where links are most of at most 900 characters and words tell of a footer."""
    block = lambda name, inner: F.concat(F.lit(f'<div class="{name}" id="is-{name}"><p>'), inner, F.lit("</p></div>"))
    # 390 linked characters and 10 more: 65 % of up to 600
    links = F.concat(*[F.lit(f'<a href="/{k}">{"x" * 130}</a> ') for k in range(3)], F.lit("read more "), F.when(F.length("words") > 500, F.col("words")).otherwise(""))
    rows = _plain(spark, d).select("doc_id", F.concat(F.lit("<nav>Go</nav><div id='is-body'><p>kept</p></div>"), block("menu", F.col("words")), block("social-bar", F.col("words")), block("plain", links)).alias("content_html"), F.lit(None).cast("string").alias("title"))
    out = clean.clean_chapters(rows)
    has = lambda x: F.col("content_html").contains(x)
    return out.select("doc_id", has("<nav").alias("nav"), has("is-menu").alias("menu"), has("is-social-bar").alias("bar"), has("is-plain").alias("cluster"), has("is-body").alias("body"))


@plan("x19_chapter_titles", f"""
    SELECT doc_id, doc_id % 3 = 2 AS subtitle, length({_WORDS}) NOT BETWEEN 1 AND 170 AS line, nullif({_WORDS}, '') AS caption, true AS own, false AS meta, false AS widget FROM documents""")
def _(spark, d):
    """Titles that repeat the chapter's, alone or with the site's name, or do not; lines of
    author and day of up to 180 characters; captions, which stay whole; widgets."""
    title = F.concat(F.lit("A report of document number "), F.col("doc_id").cast("string"))
    second = F.get(F.array(title, F.concat(title, F.lit(" | Site")), F.concat(F.lit("More on "), title)), (F.col("doc_id") % 3).cast("int"))
    html = F.concat(
        F.lit("<body><h1>"), title, F.lit('</h1><div class="entry-meta">by me</div><h2>'), second, F.lit('</h2><p id="line">Posted on '), "words", F.lit('</p><figure><img src="/a.jpg"><figcaption style="x"> <b>'), "words",
        F.lit('</b> </figcaption></figure><section id="widget"><p>Most read</p><p>Other</p></section><p>Share on Facebook Tweet</p><p>'), F.repeat(F.lit("body of the text "), 200), F.lit("</p></body>"),
    )
    out = clean.clean_chapters(_plain(spark, d).select("doc_id", title.alias("title"), html.alias("content_html")))
    has = lambda x: F.col("content_html").contains(x)
    caption = F.nullif(F.regexp_extract("content_html", '<figure><img src="/a.jpg"><p class="image-caption">([^<]*)</p></figure>', 1), F.lit(""))
    return out.select("doc_id", has("<h2>").alias("subtitle"), has('id="line"').alias("line"), caption.alias("caption"), has("<h1>A report").alias("own"), (has("entry-meta") | has("Share")).alias("meta"), has("widget").alias("widget"))


@plan("x20_summary_input", "SELECT doc_id // 10 AS book_id, left(string_agg(text, chr(10) ORDER BY doc_id), 25000) AS summary_text FROM documents GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("book_id"), F.col("doc_id").alias("chapter_idx"), "text")
    return extract.summary_input(rows)


@plan("x20_forum_summary", r"""
    SELECT 't' || conv_id AS thread_url, string_agg('Post by ' || role || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY turn) AS summary_text FROM conversations WHERE turn < 5 GROUP BY 1""")
def _(spark, d):
    """The first five posts of each thread, as the summary has them."""
    return extract.forum_summary_input(forum_posts(spark, d).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))))


@plan("x15_linked_tables", f"""
    WITH p AS (SELECT page_id, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS n FROM pages)
    SELECT b.page_id, a.page_id AS table_page_id, 0::INTEGER AS table_idx, 'Scores' AS heading FROM p a JOIN p b ON a.host = b.host AND a.n % 2 = 1 AND b.n = a.n + 1""")
def _(spark, d):
    """Pages of each site in twos: the first has a table, the second links to it."""
    host = urls.host(F.col("url"))
    n = F.row_number().over(Window.partitionBy(host).orderBy("page_id"))
    rows = pages(spark, d).select("page_id", F.concat(F.lit("https://"), host, F.lit("/p-"), n.cast("string")).alias("url"), n.alias("n"), F.concat(F.lit("https://"), host, F.lit("/p-"), (n - 1).cast("string")).alias("before"))
    html = F.when(F.col("n") % 2 == 1, F.concat(*[_id() if isinstance(x, str) else x for x in _table_html()])).otherwise(F.concat(F.lit('<p><a href="'), F.col("before"), F.lit('">All statistics and results</a></p>')))
    return extract.linked_tables(rows.select("page_id", "url", html.alias("html"))).select("page_id", "table_page_id", "table_idx", "heading")


@plan("p7_detect_paywall", "SELECT page_id FROM pages WHERE page_id % 5 = 0")
def _(spark, d):
    return extract.detect_paywall(with_html(spark, d, F.when(F.col("page_id") % 5 == 0, '<div id="gateway-content"></div>').otherwise(""))).select("page_id")


def _chain(spark, d):
    """Pages of each site in a chain by page id: listing pages /list/0, /list/1 ..."""
    p = pages(spark, d)
    site = F.concat(F.lit("https://"), urls.host(F.col("url")))
    n = F.row_number().over(Window.partitionBy(urls.host(F.col("url"))).orderBy("page_id")) - 1
    rows = p.select("page_id", site.alias("site"), n.alias("n"))
    url = F.concat("site", F.lit("/list/"), F.col("n").cast("string"))
    nxt = F.concat("site", F.lit("/list/"), (F.col("n") + 1).cast("string"))
    html = F.concat(F.lit('<p><a href="/post-'), F.col("n").cast("string"), F.lit('">P</a> 2024-02-0'), (F.col("n") % 9 + 1).cast("string"), F.lit('</p><p><a href="/post-0">again</a></p><a href="'), nxt, F.lit('">Next</a>'))
    return rows.select("page_id", url.alias("url"), nxt.alias("next_url"), html.alias("html"), "site", "n")


@plan("d1_follow_listing_pages", rf"""
    WITH c AS (SELECT {_HOST} AS host, page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) - 1 AS n FROM pages)
    SELECT 'https://' || host || '/list/' || n AS url, n::INTEGER AS page_idx, page_id FROM c WHERE n < 5""")
def _(spark, d):
    chain = _chain(spark, d)
    seeds = chain.where("n = 0").select(F.col("page_id").alias("seed_idx"), "url")
    return discovery.follow_listing_pages(seeds, chain, max_pages=5).select("url", "page_idx", "page_id")


@plan("d2_discover_posts", rf"""
    WITH c AS (SELECT {_HOST} AS host, page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) - 1 AS n FROM pages),
    s AS (SELECT host, min(page_id) AS seed FROM c GROUP BY host),
    f AS (SELECT 'https://' || host || '/post-' || n AS url, DATE '2024-02-01' + (n % 9)::INTEGER AS published_date, row_number() OVER (ORDER BY seed, n) AS place FROM c JOIN s USING (host) WHERE n < 3),
    k AS (SELECT * FROM f WHERE place <= 40)
    SELECT row_number() OVER (ORDER BY published_date, place)::INTEGER AS rank, url, published_date FROM k WHERE published_date >= DATE '2024-02-02'""")
def _(spark, d):
    chain = stored(_chain(spark, d))
    seeds = chain.where("n = 0").select(F.col("page_id").alias("seed_idx"), "url")
    return discovery.discover_posts(seeds, chain.select("page_id", "url", "html"), start="2024-02-02", max_pages=3, max_posts=40, mode="shallow").select("rank", "url", "published_date")


@plan("d3_hydrate_dates", rf"SELECT {_CANON} AS url, min_by(DATE '2024-01-01' + (page_id % 300)::INTEGER, page_id) AS published_date FROM pages GROUP BY 1")
def _(spark, d):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")).cast("string")
    known = with_html(spark, d, F.concat(F.lit("<time datetime='"), day, F.lit("'>x</time>")))
    posts = pages(spark, d).select(urls.canonical_url(F.col("url")).alias("url")).distinct().withColumn("published_date", F.lit(None).cast("date"))
    return discovery.hydrate_dates(posts, known)


@plan("d4_feed_fallback", rf"""
    WITH s AS (SELECT min(page_id) AS seed_idx, regexp_extract(url, '^[a-z]+://', 0) || {_HOST} AS site FROM pages GROUP BY 2)
    SELECT seed_idx, site || '/feed-post-' || page_id AS url FROM s JOIN pages ON site = regexp_extract(url, '^[a-z]+://', 0) || {_HOST} WHERE seed_idx % 2 = 0""")
def _(spark, d):
    site = F.concat(F.regexp_extract("url", "^[a-z]+://", 0), urls.host(F.col("url")))
    seeds = pages(spark, d).groupBy(site.alias("site")).agg(F.min("page_id").alias("seed_idx")).select("seed_idx", F.concat("site", F.lit("/blog/")).alias("url"))
    return discovery.feed_fallback(seeds, seeds.where("seed_idx % 2 = 1"), _feeds(spark, d)).select("seed_idx", "url")
