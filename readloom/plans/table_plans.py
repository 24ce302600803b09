"""Queries over threads, forums, assets, bundles, translation, transcripts, jobs, streams
and sources."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from readloom.functions.tables import stored
from readloom.operators import assets as A
from readloom.operators import bundle, forum, jobs, threads, transcripts, translate
from readloom.sources import readers, sinks
from readloom.streaming import streams

from .page_plans import forum_pages, forum_posts
from .scalar_plans import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _shared(spark) -> str:
    stored(spark.range(1))  # sets the folder where none is
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


# Sources and sinks


@plan("s1_read_pages", "SELECT page_id, url, length(html) AS chars FROM pages WHERE true")
def _(spark, d):
    return readers.read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("chars"))


@plan("s2_read_url_list", "SELECT url FROM pages WHERE page_id % 5 <> 0")
def _(spark, d):
    line = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("#"), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit(" ")))
    path = _shared(spark)
    table(spark, d, "pages").select(F.explode(F.array(line, F.lit("   "))).alias("value")).write.text(path)
    return readers.read_url_list(spark, path)


@plan("s3_read_site_profiles", "SELECT coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'Unknown') AS name, n_nationkey AS priority FROM nation")
def _(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name"), F.array(F.lower("n_name")).alias("domains")).alias("p"))
    path = _shared(spark)
    # 25 profiles in one file
    rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "p"))), lambda x: x["p"])).alias("value")).write.text(path)
    return readers.read_site_profiles(spark, [path]).select("name", "priority")


@plan("s4_normalize_queue", """
    SELECT 'https://ex.com/' || user_id AS url, min(event_id) AS pos, count(*) > 0 AS filled FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def _(spark, d):
    e = table(spark, d, "events")
    queue = e.select(F.col("event_id").alias("pos"), F.concat(F.when(F.col("event_type") == "error", "ftp://").otherwise(" https://"), F.lit("ex.com/"), F.col("user_id").cast("string"), F.lit(" ")).alias("url"), F.lit(None).cast("timestamp").alias("saved_at"), F.col("ts").alias("fallback_saved_at"))
    return readers.normalize_queue(queue).select("url", "pos", F.col("saved_at").isNotNull().alias("filled"))


# Threads: conversations, the parent of turn t being turn floor((t - 1) / 2)


def _items(spark, d, dead: bool = False):
    c = table(spark, d, "conversations")
    kids = F.filter(F.array(2 * F.col("turn") + 1, 2 * F.col("turn") + 2), lambda k: k < F.col("size"))
    size = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    rows = c.withColumn("size", size)
    return rows.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("id"), F.col("role").alias("by"), "text", F.col("turn").alias("time"), kids.alias("kids"), (F.lit(dead) & (F.col("turn") == 1)).alias("deleted"), F.lit(False).alias("dead"))


_TREE = """
    WITH RECURSIVE s AS (SELECT conv_id, count(*) AS size FROM conversations GROUP BY 1),
    t AS (SELECT c.conv_id, c.turn, NULL::BIGINT AS parent, 0 AS depth FROM conversations c WHERE turn = 0
          UNION ALL SELECT c.conv_id, c.turn, t.turn, t.depth + 1 FROM conversations c JOIN t ON c.conv_id = t.conv_id AND (c.turn = 2 * t.turn + 1 OR c.turn = 2 * t.turn + 2) WHERE {live})"""


@plan("c1_flatten_comments", "SELECT conv_id AS thread_id, turn || CASE WHEN turn = 0 THEN '' ELSE '.r' END AS id, CASE WHEN turn > 0 THEN turn::VARCHAR END AS parent_id, role AS author FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations")
    item = F.struct(F.concat(F.col("turn").cast("string"), F.when(F.col("turn") == 0, "").otherwise(".r")).alias("cid"), F.col("role").alias("author"), "text", F.lit("now").alias("time"))
    payloads = c.groupBy(F.col("conv_id").alias("thread_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("c")))), lambda x: x["c"])).alias("payload"))
    return threads.flatten_comments(payloads, "youtube").select("thread_id", "id", "parent_id", "author")


@plan("c1_nested_comments", """
    SELECT site, conv_id AS thread_id, turn::VARCHAR AS id, CASE WHEN turn % 4 > 0 THEN (turn - 1)::VARCHAR END AS parent_id, CASE WHEN turn % 4 > 0 THEN 0 ELSE turn // 4 END::INTEGER AS pos,
           CASE WHEN site = 'reddit' THEN 'u/' ELSE '' END || role AS author, text FROM conversations, (VALUES ('reddit'), ('substack')) AS s(site)""")
def _(spark, d):
    """Turns in fours, each the reply to the one before it, in the nesting of two sites."""

    def nested(site, opened, between, closed):
        said = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 4).alias("four"), opened.alias("opened"))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "opened"))), lambda x: x["opened"])
        four = F.concat(F.array_join(parts, between), F.array_join(F.transform(parts, lambda _: F.lit(closed[1])), closed[0]))
        fours = said.groupBy("conv_id", "four").agg(four.alias("c"))
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("four", "c"))), lambda x: x["c"]), ",")
        return fours.groupBy(F.col("conv_id").alias("thread_id")).agg(whole.alias("payload")).select(F.lit(site).alias("site"), "thread_id", "payload")

    def begun(**fields):
        return F.regexp_replace(F.to_json(F.struct(*[F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in fields.items()])), r"\}$", "")

    name = F.col("turn").cast("string")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    listing = '{"data":{"children":['
    reddit = nested("reddit", F.concat(F.lit('{"kind":"t1","data":'), begun(id=name, author="role", body_html=escaped)), ',"replies":' + listing, ("]}}", "}}")).withColumn("payload", F.concat(F.lit(listing), "payload", F.lit("]}}")))
    substack = nested("substack", begun(id=name, name="role", body="text"), ',"children":[', ("]", "}")).withColumn("payload", F.concat(F.lit('{"comments":['), "payload", F.lit("]}")))
    both = [threads.flatten_comments(x, site).withColumn("site", F.lit(site)) for x, site in ((reddit, "reddit"), (substack, "substack"))]
    return both[0].unionByName(both[1]).select("site", "thread_id", "id", "parent_id", "pos", "author", "text")


@plan("c2_build_comment_forest", _TREE.replace("{live}", "c.turn <> 1") + "SELECT conv_id AS thread_id, turn AS id, parent::VARCHAR AS parent_id, depth::INTEGER AS depth FROM t")
def _(spark, d):
    items = _items(spark, d, dead=True)
    return threads.build_comment_forest(items, items.where("id = 0")).select("thread_id", "id", F.col("parent_id").cast("string").alias("parent_id"), "depth")


@plan("c3_comment_navigation", _TREE.replace("{live}", "true") + """
    SELECT conv_id AS thread_id, turn AS id, CASE WHEN parent IS NOT NULL THEN '0' END AS root_id, CASE WHEN turn % 2 = 1 AND turn + 1 < size THEN (turn + 1)::VARCHAR END AS next_sibling_id, NULL::VARCHAR AS next_root_id FROM t JOIN s USING (conv_id)""")
def _(spark, d):
    items = _items(spark, d)
    return threads.comment_navigation(threads.build_comment_forest(items, items.where("id = 0"))).select("thread_id", "id", *[F.col(c).cast("string").alias(c) for c in ("root_id", "next_sibling_id", "next_root_id")])


@plan("c4_render_threads", """
    WITH RECURSIVE s AS (SELECT conv_id, count(*) AS size FROM conversations GROUP BY 1),
    t AS (SELECT conv_id, turn, 0 AS depth, '' AS path FROM conversations WHERE turn = 0
          UNION ALL SELECT c.conv_id, c.turn, depth + 1, path || (2 - c.turn % 2) FROM conversations c JOIN t ON c.conv_id = t.conv_id AND (c.turn = 2 * t.turn + 1 OR c.turn = 2 * t.turn + 2))
    SELECT conv_id AS thread_id, string_agg('c_' || turn || '" style="margin-left:' || least(depth, 5) * 10, ',' ORDER BY path) AS comments, 0 AS unclosed,
           count(*) FILTER (depth > 1) AS to_root, count(*) FILTER (turn % 2 = 1 AND turn + 1 < size) AS to_next
    FROM t JOIN s USING (conv_id) GROUP BY 1""")
def _(spark, d):
    items = _items(spark, d).withColumn("text", F.lit("<p>x</p>"))
    out = threads.render_threads(threads.comment_navigation(threads.build_comment_forest(items, items.where("id = 0"))))
    n = lambda x: F.regexp_count("html", F.lit(x))
    shown = F.regexp_extract_all("html", F.lit('id="(c_[0-9]+" style="margin-left:[0-9]+)px'), F.lit(1))
    return out.select("thread_id", F.array_join(shown, ",").alias("comments"), (n("<div") - n("</div>")).alias("unclosed"), n(">root</a>").cast("long").alias("to_root"), n(">next</a>").cast("long").alias("to_next"))


@plan("c5_top_roots_with_replies", """
    WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE turn % 2 = 0)
    SELECT c.conv_id AS thread_id, c.turn AS pos FROM conversations c JOIN r ON c.conv_id = r.conv_id AND r.turn = c.turn - c.turn % 2 WHERE k <= 2""")
def _(spark, d):
    c = table(spark, d, "conversations")
    root = (F.col("turn") - F.col("turn") % 2).cast("string")
    rows = c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), F.when(F.col("turn") % 2 == 0, root).otherwise(F.concat(root, F.lit(".1"))).alias("id"), F.when(F.col("turn") % 2 == 1, root).alias("parent_id"))
    return threads.top_roots_with_replies(rows, 2).select("thread_id", "pos")


@plan("c6_stitch_forum_threads", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS spine FROM conversations WHERE turn < 3")
def _(spark, d):
    out = forum.stitch_forum_threads(forum_pages(spark, d), forum_posts(spark, d), max_pages=2, max_posts=3)
    return out.select("conv_id", (F.col("page") * 2 - 2 + F.col("pos")).cast("long").alias("turn"), "spine")


@plan("c7_rewrite_quote_links", "SELECT conv_id, turn, CASE WHEN turn > 0 THEN '#p_post-' || (turn - 1) ELSE '#post-999' END AS href FROM conversations")
def _(spark, d):
    posts = forum_posts(spark, d).withColumn("spine", F.col("page") * 2 - 2 + F.col("pos"))
    target = F.when(F.col("spine") > 0, F.concat(F.lit("#post-"), (F.col("spine") - 1).cast("string"))).otherwise("#post-999")
    quoted = posts.withColumn("html", F.concat(F.lit('<a class="bbCodeBlock-sourceJump" rel="nofollow" href="/goto'), target, F.lit('">said</a>'), "html"))
    found = F.regexp_extract("html", r'<a[^>]*href="[^"#]*(#[^"]*)"', 1)
    return forum.rewrite_quote_links(quoted).select("conv_id", F.col("spine").cast("long").alias("turn"), found.alias("href"))


@plan("c8_merge_linked_articles", "SELECT page_id AS story_id, CASE WHEN page_id % 2 = 0 THEN 'linked_article.xhtml' ELSE 'article.xhtml' END AS filename FROM pages")
def _(spark, d):
    p = table(spark, d, "pages")
    stories = p.select(F.col("page_id").alias("story_id"), F.lit("t").alias("title"), F.concat(F.lit("http://www.ex.com/"), F.col("page_id").cast("string"), F.lit("?x")).alias("url"), F.lit("self").alias("text"))
    books = p.where("page_id % 2 = 0").select(F.col("page_id").alias("book_id"), F.concat(F.lit("https://ex.com/"), F.col("page_id").cast("string"), F.lit("/")).alias("source_url"))
    chapters = books.select("book_id", F.lit(0).alias("chapter_idx"), F.lit("article.xhtml").alias("filename"), F.lit("x").alias("content_html"))
    return threads.merge_linked_articles(stories, books, chapters).select("story_id", "filename")


@plan("c8_linked_comments", """
    SELECT page_id AS story_id, CASE WHEN page_id % 2 = 0 THEN 'linked_article.xhtml' ELSE 'article.xhtml' END AS filename,
           concat_ws(',', CASE WHEN page_id % 4 = 0 THEN 'linked_comments.xhtml' END, CASE WHEN page_id % 3 = 0 THEN 'story_comments.xhtml' END) AS children,
           CASE WHEN page_id % 3 = 0 THEN '<p>0</p><p>1</p>' END AS comments
    FROM pages""")
def _(spark, d):
    p = table(spark, d, "pages")
    stories = p.select(F.col("page_id").alias("story_id"), F.lit("t").alias("title"), F.concat(F.lit("http://www.ex.com/"), F.col("page_id").cast("string"), F.lit("?x")).alias("url"), F.lit("self").alias("text"))
    books = p.where("page_id % 2 = 0").select(F.col("page_id").alias("book_id"), F.concat(F.lit("https://ex.com/"), F.col("page_id").cast("string"), F.lit("/")).alias("source_url"))
    chapter = lambda k, name: books.select("book_id", F.lit(k).alias("chapter_idx"), F.lit(name).alias("filename"), F.lit("x").alias("content_html"), F.lit(k > 0).alias("is_comments"))
    chapters = chapter(0, "article.xhtml").unionByName(chapter(1, "comments.xhtml").where("book_id % 4 = 0"))
    comments = p.where("page_id % 3 = 0").select(F.col("page_id").alias("story_id"), F.explode(F.array(F.lit(1), F.lit(0))).alias("root_pos")).withColumn("html", F.concat(F.lit("<p>"), F.col("root_pos").cast("string"), F.lit("</p>")))
    merged = threads.merge_linked_articles(stories, books, chapters, comments)
    said = merged.where("part = 'story_comments'").select("story_id", F.col("content_html").alias("comments"))
    return threads.linked_toc(merged).join(said, "story_id", "left").select("story_id", "filename", F.array_join("children.filename", ",").alias("children"), "comments")


# Assets: documents as contents; ten of them make a book, all books one bundle


def _assets(spark, d):
    doc = table(spark, d, "documents")
    return doc.select(
        F.lit("all").alias("bundle_id"), F.floor(F.col("doc_id") / 10).cast("int").alias("book_idx"), F.col("doc_id").cast("int").alias("asset_idx"), F.concat(F.lit("images/"), (F.col("doc_id") % 7).cast("string"), F.lit(".png")).alias("filename"),
        F.encode("text", "utf-8").alias("content"), F.concat(F.lit("https://i.ex.com/"), F.col("doc_id").cast("string")).alias("original_url"), F.array().cast("array<string>").alias("alt_urls"),
    )


@plan("a1_dedupe_assets", "SELECT doc_id::INTEGER AS asset_idx, doc_id = min(doc_id) OVER (PARTITION BY text) AS kept, 'images/' || (min(doc_id) OVER (PARTITION BY text) % 7) || '.png' AS kept_filename FROM documents")
def _(spark, d):
    return A.asset_duplicates(_assets(spark, d)).select("asset_idx", "kept", "kept_filename")


@plan("a2_dedupe_thread_assets", "SELECT doc_id::INTEGER AS asset_idx, doc_id = min(doc_id) OVER (PARTITION BY lang, text) AS kept FROM documents")
def _(spark, d):
    rows = _assets(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("asset_idx"), F.col("lang").alias("thread_url")), "asset_idx")
    return A.thread_duplicates(rows).select("asset_idx", "kept")


@plan("a3_assign_filenames", """
    WITH d AS (SELECT doc_id, doc_id % 7 AS r, doc_id // 10 AS book, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS k, row_number() OVER (PARTITION BY doc_id % 7, doc_id // 10 ORDER BY doc_id) AS j, min(doc_id // 10) OVER (PARTITION BY doc_id % 7) AS first FROM documents WHERE doc_id % 10 > 3),
    n AS (SELECT *, CASE WHEN book = first THEN j - 1 ELSE j END AS i FROM d),
    p AS (SELECT doc_id, doc_id // 10 AS book, doc_id % 10 AS i FROM documents WHERE doc_id % 10 <= 3)
    SELECT doc_id::INTEGER AS asset_idx, CASE WHEN k = 1 THEN 'images/' || r || '.png' ELSE 'images/src' || book || '_' || r || CASE WHEN i = 1 THEN '' ELSE '_' || i END || '.png' END AS new_filename FROM n
    UNION ALL SELECT doc_id, 'images/' || CASE WHEN book = 0 THEN ['p', 'src0_p', 'src0_p_2', 'p_2'][i + 1] ELSE 'src' || book || ['_p', '_p_2', '_p_3', '_p_2_2'][i + 1] END || '.png' FROM p""")
def _(spark, d):
    """Of ten in a book, three are named p and one p_2, which finds its numbered name taken."""
    name = F.when(F.col("asset_idx") % 10 < 3, F.lit("images/p.png")).when(F.col("asset_idx") % 10 == 3, F.lit("images/p_2.png")).otherwise(F.col("filename"))
    return A.new_filenames(_assets(spark, d).withColumn("filename", name)).select("asset_idx", "new_filename")


@plan("a4_remap_image_refs", "SELECT page_id AS book_id, CASE WHEN page_id % 2 = 0 THEN 'images/new.png' ELSE 'images/old.png' END AS src FROM pages")
def _(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("book_id"), F.concat(F.lit('<img src="images/old.png">'), "html").alias("content_html"))
    names = p.where("book_id % 2 = 0").select("book_id", F.lit("images/old.png").alias("old"), F.lit("images/new.png").alias("new"))
    return A.remap_image_refs(p, names).select("book_id", F.regexp_extract("content_html", '<img src="([^"]*)"', 1).alias("src"))


@plan("a5_check_image_budget", """
    SELECT source AS bundle_id, count(*) AS images, sum(strlen(text))::BIGINT AS bytes, count(*) > 20 AS over_images, max(strlen(text))::BIGINT AS top FROM documents GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("bundle_id"), F.col("doc_id").cast("string").alias("filename"), F.encode("text", "utf-8").alias("content"))
    return A.check_image_budget(rows, "compact", max_images=20).select("bundle_id", "images", "bytes", "over_images", F.col("largest")[0]["size"].alias("top"))


@plan("a6_match_assets", "SELECT l_orderkey AS book_id, l_linenumber AS image_idx, CASE WHEN l_linenumber % 3 < 2 THEN l_linenumber::VARCHAR END AS asset_idx FROM lineitem")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("n"))
    key = F.concat(F.lit("picture-"), F.col("n").cast("string"), F.lit(".jpg"))
    own = rows.select("book_id", F.col("n").alias("asset_idx"), F.concat(F.lit("f"), F.col("n").cast("string")).alias("filename"), F.concat(F.lit("https://www.ex.com/a/"), key).alias("original_url"), F.array().cast("array<string>").alias("alt_urls"))
    url = F.when(F.col("n") % 3 == 0, F.concat(F.lit("http://ex.com/a/"), key, F.lit("?w=1"))).when(F.col("n") % 3 == 1, F.concat(F.lit("https://other.org/b/"), key)).otherwise("https://other.org/none")
    return A.match_assets(rows.select("book_id", F.col("n").alias("image_idx"), url.alias("url")), own).select("book_id", "image_idx", F.col("asset_idx").cast("string").alias("asset_idx"))


def _shown(spark, d):
    """Books of line items; chapters show the items with an odd number, except of books
    whose key is a multiple of 4."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("n"))
    own = rows.select("book_id", F.col("n").alias("asset_idx"), F.concat(F.lit("images/"), F.col("n").cast("string"), F.lit(".svg")).alias("filename"), F.lit("image/svg+xml").alias("media_type"), F.concat(F.lit("https://ex.com/map-"), F.col("n").cast("string")).alias("original_url"), F.array().cast("array<string>").alias("alt_urls"))
    shows = F.when((F.col("book_id") % 4 != 0) & (F.col("n") % 2 == 1), F.concat(F.lit('<p>The map shows</p><img alt="a" src="images/'), F.col("n").cast("string"), F.lit('.svg">'))).otherwise("<p>x</p>")
    return rows.select("book_id", F.col("n").alias("chapter_idx"), shows.alias("content_html")), own


_SHOWN = """WITH l AS (SELECT DISTINCT l_orderkey AS b, l_linenumber AS n FROM lineitem), u AS (SELECT DISTINCT b FROM l WHERE b % 4 <> 0 AND n % 2 = 1)"""


@plan("a7_retain_referenced_assets", _SHOWN + " SELECT b AS book_id, n AS asset_idx FROM l JOIN (SELECT l_orderkey, l_linenumber FROM lineitem) r ON r.l_orderkey = b AND r.l_linenumber = n WHERE (n % 2 = 1 AND b IN (SELECT b FROM u)) OR b NOT IN (SELECT b FROM u)")
def _(spark, d):
    return A.retain_referenced_assets(*_shown(spark, d)).select("book_id", "asset_idx")


@plan("a8_context_map_assets", _SHOWN + " SELECT b AS book_id, n AS asset_idx FROM l JOIN (SELECT l_orderkey, l_linenumber FROM lineitem) r ON r.l_orderkey = b AND r.l_linenumber = n WHERE b IN (SELECT b FROM u) AND n % 2 = 0")
def _(spark, d):
    return A.context_map_assets(*_shown(spark, d)).select("book_id", "asset_idx")


def _books(spark, d):
    """Orders as books, customers as bundles, line items as chapters (number 1 the article)."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("bundle_id"), F.col("o_orderkey").alias("book_idx"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("https://www.site"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".com/")).alias("url"), F.when(F.col("o_orderkey") % 2 == 0, F.to_date("o_orderdate")).alias("published_date"), F.lit("2024-01-01").alias("saved_at"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_idx"), n.alias("chapter_idx"))
    ch = lines.join(o.select("bundle_id", "book_idx"), "book_idx").select("bundle_id", "book_idx", "chapter_idx", F.lit("c").alias("title"), F.concat(F.col("chapter_idx").cast("string"), F.lit(".xhtml")).alias("filename"), (F.col("chapter_idx") == 0).alias("is_article"), (F.col("chapter_idx") > 0).alias("is_comments"), F.lit(None).cast("string").alias("saved_at"))
    return o, ch


@plan("a9_build_bundle", """
    SELECT o_custkey AS bundle_id, o_orderkey AS book_idx, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' - ' ELSE '' END || o_orderpriority AS label, 'b' || o_orderkey || '_0.xhtml' AS filename, (n - 1)::INTEGER AS children
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(spark, d):
    _, toc = bundle.build_bundle(*_books(spark, d))
    return toc.select("bundle_id", "book_idx", "label", "filename", F.size("children").alias("children"))


@plan("a10_bundle_titles", """
    SELECT o_custkey AS bundle_id, CASE WHEN count(DISTINCT o_orderkey % 3) = 1 THEN 'site' || any_value(o_orderkey % 3) || '.com' ELSE 'Anthology' END || '_from_2024' AS title FROM orders GROUP BY 1""")
def _(spark, d):
    return bundle.bundle_titles(_books(spark, d)[0], start="2024")


@plan("a11_toc_entries", """
    SELECT o_custkey AS bundle_id, l_orderkey AS book, l_linenumber AS n, 'c' || CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1 THEN '' ELSE '-' || (row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) END AS anchor
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("bundle_id"))
    spine = F.row_number().over(Window.partitionBy("bundle_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    ch = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("spine", spine)
    rows = stored(ch.select("bundle_id", "spine", "l_orderkey", "l_linenumber", F.lit("c").alias("uid"), F.lit("").alias("filename"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("toc_title"), F.lit("t").alias("bundle_title"), F.lit(None).cast("array<struct<page:int,id:string>>").alias("page_labels")))
    return bundle.toc_entries(rows.drop("l_orderkey", "l_linenumber")).join(rows.select("bundle_id", "spine", "l_orderkey", "l_linenumber"), ["bundle_id", "spine"]).select("bundle_id", F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("n"), "anchor")


@plan("a12_apply_saved_at", """
    WITH c AS (SELECT l_orderkey AS book, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    m AS (SELECT *, book % 3 <> 0 AND idx % 2 = 1 AS article, CASE WHEN (book + idx) % 4 = 1 THEN 'own ' || idx WHEN (book + idx) % 4 = 2 THEN '' END AS saved FROM c),
    t AS (SELECT book, min(idx) AS takes FROM (SELECT *, bool_or(article) OVER (PARTITION BY book) AS has_article FROM m) WHERE coalesce(saved, '') = '' AND (article OR NOT has_article) GROUP BY 1)
    SELECT m.book AS book_idx, idx::INTEGER AS chapter_idx, coalesce(CASE WHEN idx = takes AND m.book % 7 <> 0 THEN 'book ' || m.book ELSE saved END, 'none') AS saved_at FROM m LEFT JOIN t USING (book)""")
def _(spark, d):
    """Books with and without articles and a time of their own; chapters with and without one."""
    books, ch = _books(spark, d)
    n, idx = F.col("book_idx"), F.col("chapter_idx")
    books = books.withColumn("saved_at", F.when(n % 7 != 0, F.concat(F.lit("book "), n.cast("string"))))
    own = F.when((n + idx) % 4 == 1, F.concat(F.lit("own "), idx.cast("string"))).when((n + idx) % 4 == 2, "")
    out = bundle.apply_saved_at(books, ch.withColumns({"is_article": (n % 3 != 0) & (idx % 2 == 1), "saved_at": own}))
    return out.select("book_idx", "chapter_idx", F.coalesce("saved_at", F.lit("none")).alias("saved_at"))


@plan("s5_write_bundle", """
    SELECT o_custkey AS bundle_id, count(*) AS chapters, count(DISTINCT l_orderkey) AS books, count(DISTINCT 'images/' || (l_orderkey % 5) || '.png') AS assets, min(l_orderkey % 5) AS low
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _(spark, d):
    """Every bundle is written, then counted from what was written."""
    chapters, toc = bundle.build_bundle(*_books(spark, d))
    path, n = _shared(spark), F.col("book_idx") % 5
    own = chapters.select("bundle_id", F.concat(F.lit("images/"), n.cast("string"), F.lit(".png")).alias("filename"), F.col("spine").alias("asset_no"), n.alias("n"))
    sinks.write_bundle(chapters, own, toc, path, parts=spark.sparkContext.defaultParallelism)
    read = lambda name, *counts: spark.read.parquet(f"{path}/{name}").groupBy("bundle_id").agg(*counts)
    one = F.count(F.lit(1))
    return read("chapters", one.alias("chapters")).join(read("toc", one.alias("books")), "bundle_id").join(read("assets", one.alias("assets"), F.min("n").alias("low")), "bundle_id")


# Translation: documents as units, those with an even id already translated


def _units(spark, d):
    return table(spark, d, "documents").select(F.col("lang").alias("book_id"), F.lit(0).alias("chapter_idx"), F.col("doc_id").cast("int").alias("unit_idx"), "text")


def _memory(spark, d):
    keyed = _units(spark, d).where("unit_idx % 2 = 0")
    key = translate.translation_key(F.lit("llm"), F.lit("auto:m"), F.lit("en"), F.lit("de"), F.col("text"))
    return keyed.groupBy(key.alias("cache_key")).agg(F.concat(F.lit("T "), F.min("unit_idx").cast("string")).alias("translated_text"), F.lit(1).alias("created_at"))


_COMPACT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@plan("l1_extract_translation_units", """
    WITH w AS (SELECT conv_id, turn, role || ' says ' || trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS words FROM conversations WHERE turn % 3 = 0)
    SELECT conv_id AS book_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS unit_idx, trim(words) AS text FROM w""")
def _(spark, d):
    """Of three turns one is text, one is code and one is a block of metadata."""
    words = F.concat("role", F.lit(" says\n "), F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")))
    kind = (F.col("turn") % 3).cast("int")
    around = lambda *x: F.get(F.array(*map(F.lit, x)), kind)
    line = F.concat(around("<p>", "<pre><p>", "<div class='post-meta'><p>"), words, around("</p><p>12</p>", "</p></pre>", "</p></div>"))
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), "turn", line.alias("line"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "")
    ch = said.groupBy("book_id").agg(html.alias("content_html")).withColumns({"chapter_idx": F.lit(0), "is_article": F.lit(True), "is_comments": F.lit(False)})
    return translate.extract_translation_units(ch).select("book_id", "unit_idx", "text")


@plan("l2_translation_key", rf"SELECT doc_id, sha256('llm' || chr(10) || 'auto:m' || chr(10) || 'auto' || chr(10) || 'de' || chr(10) || {_COMPACT}) AS cache_key FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", translate.translation_key(F.lit("llm"), F.lit("auto:m"), F.lit(""), F.lit("de"), F.col("text")).alias("cache_key"))


@plan("l3_plan_translation", rf"SELECT sha256({_COMPACT}) AS h, min_by(doc_id, (lang, doc_id))::INTEGER AS first_unit, NOT bool_or(doc_id % 2 = 0) AS missing FROM documents WHERE {_COMPACT} <> '' GROUP BY 1")
def _(spark, d):
    out = translate.plan_translation(_units(spark, d), _memory(spark, d), "llm", "auto:m", "en", "de")
    return out.select(F.sha2("text", 256).alias("h"), F.col("first_seen.unit_idx").alias("first_unit"), "missing")


@plan("l4_upsert_memory", """
    SELECT k AS cache_key, coalesce(max(CASE WHEN doc_id % 3 = 0 THEN doc_id END), max(doc_id))::BIGINT AS created_at FROM (SELECT doc_id, doc_id % 50 AS k FROM documents) GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("cache_key"), F.col("doc_id").alias("created_at"), F.lit("t").alias("translated_text"))
    return translate.upsert_memory(rows.where("created_at % 3 != 0"), rows.where("created_at % 3 = 0")).select("cache_key", "created_at")


@plan("l4_memory_store", """
    SELECT k AS cache_key, coalesce(max(CASE WHEN doc_id % 3 = 0 AND k % 5 = 0 THEN doc_id END), max(CASE WHEN doc_id % 3 <> 0 THEN doc_id END))::BIGINT AS created_at FROM (SELECT doc_id, (doc_id % 500)::VARCHAR AS key, doc_id % 500 AS k FROM documents) GROUP BY 1
    HAVING created_at IS NOT NULL""")
def _(spark, d):
    """A store of buckets, and an upsert that touches some of them."""
    rows = table(spark, d, "documents").select((F.col("doc_id") % 500).alias("cache_key"), F.col("doc_id").alias("created_at"), F.lit("t").alias("translated_text"))
    old, new = rows.where("created_at % 3 != 0"), rows.where("created_at % 3 = 0 AND cache_key % 5 = 0")
    path = _shared(spark)
    translate.write_memory(translate.upsert_memory(old.limit(0), old), path)
    translate.upsert_memory_store(spark, path, new)
    return translate.read_memory(spark, path).select("cache_key", "created_at")


@plan("l5_batch_texts", """
    WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, text, length(text) AS size FROM documents WHERE text IS NOT NULL),
    w AS (SELECT i, text, 0::BIGINT AS batch, 1 AS n, size FROM d WHERE i = 1
          UNION ALL SELECT d.i, d.text, w.batch + closes::BIGINT, CASE WHEN closes THEN 1 ELSE w.n + 1 END, CASE WHEN closes THEN d.size ELSE w.size + d.size END
          FROM w JOIN (SELECT * FROM d) d ON d.i = w.i + 1, LATERAL (SELECT w.n >= 20 OR w.size + d.size > 9000 AS closes))
    SELECT 0::BIGINT AS bucket, batch, sha256(text) AS h FROM w""")
def _(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("text", F.struct(F.lit("b").alias("book_id"), F.lit(0).alias("chapter_idx"), F.col("doc_id").cast("int").alias("unit_idx")).alias("first_seen"))
    return translate.batch_texts(rows).select("bucket", "batch", F.sha2("text", 256).alias("h"))


@plan("l6_protect_terms", "SELECT doc_id, replace(text, ' the ', ' THE ') AS text FROM documents")
def _(spark, d):
    terms = translate.parse_glossary('{" the ": "x"}') and [(" the ", " THE ")]
    return table(spark, d, "documents").select("doc_id", translate.restore_terms(translate.protect_terms(F.col("text"), terms), terms).alias("text"))


@plan("l7_translate_missing", "SELECT 'id ' || doc_id AS text, 'ID ' || doc_id AS translated_text FROM documents")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("id "), F.col("doc_id").cast("string")).alias("text"), F.struct(F.lit("b").alias("book_id"), F.lit(0).alias("chapter_idx"), F.col("doc_id").cast("int").alias("unit_idx")).alias("first_seen"))
    return translate.translate_missing(translate.batch_texts(rows, buckets=4), lambda texts: [t.upper() for t in texts])


@plan("l8_apply_translations", "SELECT page_id AS book_id, 'ZEILE ' || page_id AS said FROM pages")
def _(spark, d):
    ch = table(spark, d, "pages").select(F.col("page_id").alias("book_id"), F.lit(0).alias("chapter_idx"), F.lit("t").alias("title"), F.concat(F.lit("<p>Line "), F.col("page_id").cast("string"), F.lit("</p>")).alias("content_html"), F.lit(True).alias("is_article"), F.lit(False).alias("is_comments"))
    units = translate.extract_translation_units(ch)
    said = units.select("text", F.replace(F.upper("text"), F.lit("LINE"), F.lit("ZEILE")).alias("translated_text")).distinct()
    return translate.apply_translations(ch, units, said).select("book_id", F.regexp_extract("content_html", 'class="translation">([^<]*)<', 1).alias("said"))


# Transcripts: conversations, a turn every ten seconds


def _segments(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), (F.col("turn") * 10.0).alias("start"), F.lit(9.5).cast("double").alias("duration"), F.concat(F.lit("word "), F.col("turn").cast("string")).alias("text"))


@plan("v1_select_track", "SELECT conv_id AS video_id, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END::BIGINT AS track_idx FROM conversations GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "conversations")
    tracks = c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("track_idx"), F.when(F.col("turn") == 1, "en-GB").otherwise("fr").alias("language_code"), (F.col("turn") == 2).alias("is_generated"))
    return transcripts.select_track(tracks, ["en", "de"]).select("video_id", "track_idx")


def _spoken(spark, d):
    """Twenty long videos whose segments are the lines of conversations: pauses by length,
    some lines notes, some cut by speaker changes."""
    line, size = F.col("line"), F.length("line")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    start = F.floor(F.col("conv_id") / 20) * 1000 + F.col("turn") * 100 + F.col("k") * 2
    text = F.when(size % 13 == 0, F.concat(F.lit("["), line, F.lit("]"))).when(size % 7 == 0, F.replace(line, F.lit(", "), F.lit(" >> "))).otherwise(line)
    return rows.select((F.col("conv_id") % 20).alias("video_id"), start.cast("double").alias("start"), (F.lit(2.0) - (size % 8) * F.lit(0.2)).alias("duration"), text.alias("text"))


@plan("v2_transcript_paragraphs", r"""
    WITH RECURSIVE c AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM conversations),
    s AS (SELECT conv_id % 20 AS v, ((conv_id // 20) * 1000 + turn * 100 + k * 2)::DOUBLE AS start, 2.0::DOUBLE - (length(line) % 8)::DOUBLE * 0.2::DOUBLE AS duration,
          trim(CASE WHEN length(line) % 13 = 0 THEN '[' || line || ']' WHEN length(line) % 7 = 0 THEN replace(line, ', ', ' >> ') ELSE line END) AS line FROM c),
    g AS (SELECT *, start - lag(start + duration) OVER (PARTITION BY v ORDER BY start, duration, line) AS gap, row_number() OVER (PARTITION BY v ORDER BY start, duration, line) AS n,
          string_split(line, '>>') AS turns, contains(line, '>>') AND NOT starts_with(line, '>>') AS cut FROM s WHERE line <> ''),
    p AS (SELECT v, n, 0 AS t, line AS text, gap IS NULL OR gap > 1.5 OR contains(line, '>>') OR (starts_with(line, '[') AND ends_with(line, ']')) AS begins, CASE WHEN gap > 0.5 THEN 500 ELSE 1000 END AS most, length(line) + 1 AS adds FROM g WHERE NOT cut
          UNION ALL SELECT v, n, t, CASE WHEN t = 0 THEN trim(turns[1]) ELSE '>> ' || trim(turns[t + 1]) END, t < 2 OR turns[t] <> turns[-1], 1000000, 0 FROM (SELECT *, unnest(range(len(turns))) AS t FROM g WHERE cut)),
    o AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY n, t) AS i FROM p),
    w AS (SELECT v, i, text, adds AS size, 0 AS par FROM o WHERE i = 1
          UNION ALL SELECT o.v, o.i, o.text, CASE WHEN o.begins OR w.size > o.most THEN 0 ELSE w.size END + o.adds, w.par + CASE WHEN o.begins OR w.size > o.most THEN 1 ELSE 0 END FROM w JOIN o ON o.v = w.v AND o.i = w.i + 1),
    j AS (SELECT v, par, trim(regexp_replace(string_agg(text, ' ' ORDER BY i), '\s+', ' ', 'g')) AS text FROM w GROUP BY 1, 2)
    SELECT v AS video_id, par::INTEGER AS par_idx, CASE WHEN regexp_matches(text, '^\p{Ll}') THEN upper(text[1]) || text[2:] ELSE text END AS text FROM j""")
def _(spark, d):
    return transcripts.transcript_paragraphs(_spoken(spark, d))


@plan("v3_thumbnail_slots", """
    WITH t AS (SELECT conv_id, max(turn) * 10.0 + 9.5 AS total FROM conversations GROUP BY 1 HAVING max(turn) * 10.0 + 9.5 > 60)
    SELECT conv_id AS video_id, r AS ratio, min(turn * 10.0)::DOUBLE AS start FROM conversations JOIN t USING (conv_id), (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS r) WHERE turn * 10.0 / total >= r GROUP BY 1, 2""")
def _(spark, d):
    return transcripts.thumbnail_slots(_segments(spark, d)).select("video_id", F.col("ratio").cast("double").alias("ratio"), "start")


# Jobs: events, a user's being one job's


def _timings(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.round(F.col("value") * 100).cast("long").alias("duration_ms"), (F.col("event_type") != "error").alias("success"), F.lit(None).cast("string").alias("error_type"), F.col("ts").alias("event_ts"))


@plan("j1_job_summary", """
    SELECT user_id AS job_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS failed, sum(round(value * 100)::BIGINT)::BIGINT AS duration_ms, max(round(value * 100)::BIGINT) AS slowest_ms, min(CASE WHEN event_type = 'error' THEN event_id END) AS first_failed FROM events GROUP BY 1""")
def _(spark, d):
    out = jobs.job_summary(_timings(spark, d))
    return out.select("job_id", "total", "processed", "failed", "duration_ms", F.col("slowest")[0]["duration_ms"].alias("slowest_ms"), F.substring(F.get("failed_sources", 0)["url"], 2, 20).cast("long").alias("first_failed"))


def _stage_events(spark, d):
    """Three stages of each user's job: a view starts one, a click or a purchase ends one."""
    kind = F.when(F.col("event_type") == "view", "stage_start").when(F.col("event_type").isin("click", "purchase"), "stage_done").when(F.col("event_type") == "signup", "job_start")
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_ts"), kind.alias("event"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("stage"))


_STAGES = """
    WITH e AS (SELECT user_id, event_id, ts, 's' || event_id % 3 AS stage, CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 2 ELSE 1 END AS kind FROM events WHERE event_type <> 'error'),
    m AS (SELECT *, max(CASE WHEN kind > 0 THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM e),
    n AS (SELECT *, lead(kind) OVER w AS after, lead(ts) OVER w AS next, lag(kind) OVER w AS before FROM m WHERE kind < 2 WINDOW w AS (PARTITION BY user_id, stage ORDER BY ts, event_id)),
    r AS (SELECT user_id AS job_id, stage, CASE WHEN kind = 1 THEN 'unstarted' WHEN after = 1 THEN 'closed' WHEN after = 0 THEN 'restarted' ELSE 'open' END AS state,
          CASE WHEN kind = 0 THEN ts ELSE mark END AS started_at, CASE WHEN kind = 1 THEN ts WHEN after = 1 THEN next END AS ended_at FROM n WHERE kind = 0 OR before IS NULL OR before = 1)"""


@plan("j1_stage_durations", _STAGES + """
    SELECT job_id, stage, state, coalesce(epoch_us(started_at), -1)::BIGINT AS started_us, coalesce(floor((epoch_us(ended_at) - epoch_us(started_at)) / 1000), -1)::BIGINT AS duration_ms FROM r""")
def _(spark, d):
    out = jobs.stage_durations(_stage_events(spark, d))
    return out.select("job_id", "stage", "state", F.coalesce(F.unix_micros("started_at"), F.lit(-1)).alias("started_us"), F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"))


@plan("j1_stream_stages", _STAGES + """
    SELECT job_id::VARCHAR AS job_id, stage, state, coalesce(epoch_us(started_at), -1)::BIGINT AS started_us, coalesce(floor((epoch_us(ended_at) - epoch_us(started_at)) / 1000), -1)::BIGINT AS duration_ms FROM r WHERE state IN ('closed', 'restarted')""")
def _(spark, d):
    """The same as a stream; what is open when it stops has not been told."""
    raw = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    kind = F.when(F.col("event_type") == "view", "stage_start").when(F.col("event_type").isin("click", "purchase"), "stage_done").when(F.col("event_type") == "signup", "job_start")
    feed = raw.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_ts"), kind.alias("event"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("stage"))
    out = _run(streams.stream_stage_durations(feed, longest="60 days"), _shared(spark))
    return out.select("job_id", "stage", "state", F.coalesce(F.unix_micros("started_at"), F.lit(-1)).alias("started_us"), F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"))


@plan("j2_retry_as_generic", "SELECT page_id, page_id % 4 = 1 AS retried FROM pages WHERE page_id % 2 = 0 OR page_id % 4 = 1")
def _(spark, d):
    p = table(spark, d, "pages").withColumn("is_forum", F.col("page_id") % 4 == 1)
    books = p.where("page_id % 2 = 0").select("page_id", "url", F.lit("t").alias("title"), "html")
    return jobs.retry_as_generic(p, books).select("page_id", "retried")


@plan("j3_expire_jobs", "SELECT event_id FROM events WHERE event_type <> 'error' OR epoch(ts) > epoch(TIMESTAMP '2024-01-15 00:00:00') - 7200")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"), F.col("ts").cast("string").alias("updated_at"))
    return jobs.expire_jobs(rows, now=1705276800.0).select("event_id")


def _run(stream, path: str):
    """A finite stream to its end, as files in the shared folder."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _event_stream(spark, d):
    raw = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@plan("j4_stream_queue", "SELECT DISTINCT 'https://ex.com/' || user_id AS url FROM events")
def _(spark, d):
    feed = _event_stream(spark, d).select(F.concat(F.lit(" https://ex.com/"), F.col("user_id").cast("string")).alias("url"), F.col("ts").alias("saved_at"))
    return _run(streams.stream_queue(feed, "40 days"), _shared(spark)).select("url")


@plan("j5_stream_job_timings", """
    SELECT user_id AS job_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def _(spark, d):
    feed = _event_stream(spark, d).select(F.col("user_id").alias("job_id"), F.round(F.col("value") * 100).cast("long").alias("duration_ms"), (F.col("event_type") != "error").alias("success"), F.col("ts").alias("event_ts"))
    out = _run(streams.stream_job_timings(feed), _shared(spark))
    return out.select("job_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "total", "failed")
