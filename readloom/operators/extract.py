"""Page extraction as DataFrame jobs: one parse of each page in each job, no shuffle
except where rows are ranked."""

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions import classify, dates, text, urls
from readloom.functions.helpers import long_rows, per_row

from . import pagefacts

_S, _B, _I = T.StringType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


AUTHOR_TAGS = T.ArrayType(_struct(rank=_I, href=_S, text=_S))
READ = _struct(success=_B, title=_S, author_said=_S, author_tags=AUTHOR_TAGS, sitename=_S, html=_S, text=_S, error=_S, is_paywall=_B, content_usable=_B, date_texts=T.ArrayType(_S))
ARTICLE = ["success", "title", "author", "sitename", "html", "text", "error", "is_paywall", "content_usable"]
JUMP = T.ArrayType(_struct(tag=_S, rel=_S, classes=T.ArrayType(_S), href=_S, target=_S, text=_S, tight=_S))
NEAR = T.ArrayType(_struct(kind=_S, text=_S))
LINK = T.ArrayType(_struct(url=_S, title=_S, near=NEAR))
IMAGE = T.ArrayType(_struct(url=_S, alt=_S, viewer_url=_S, caption=_S, container=_I, srcset=_S, filename_hint=_S))
POST = T.ArrayType(_struct(id=_S, anchor_id=_S, numeric_id=_S, author=_S, html=_S, text=_S, time=_S))
COMMENT = T.ArrayType(_struct(id=_S, parent_id=_S, pos=_I, author=_S, text=_S, ts=_S))


def _date_texts(html: str | None) -> list[str]:
    return pagefacts.date_texts(pagefacts.parse(html))


def _author_facts(html: str | None) -> dict:
    return pagefacts.author_facts(pagefacts.parse(html))


def extract_articles(pages: DataFrame, profile_col: str | None = None) -> DataFrame:
    """pages (url, html) with success, title, author, sitename, html, text, error,
    is_paywall, content_usable and date. profile_col: a struct with content_selector and
    remove_selectors. A null or unreadable page has success = false and an error."""
    profile = [F.col(f"{profile_col}.content_selector"), F.col(f"{profile_col}.remove_selectors")] if profile_col else [F.lit(None).cast("string"), F.lit(None).cast("array<string>")]
    made = long_rows(pages).withColumn("article", per_row(pagefacts.article, READ, F.col("html"), F.col("url"), *profile))
    own = [c for c in pages.columns if c not in [*ARTICLE, "date"]]
    author = author_of(F.col("article.author_said"), F.col("article.author_tags"))
    date = F.coalesce(dates.date_from_url(F.col("url")), first_date(F.col("article.date_texts")))
    return made.select(*own, *[author.alias(c) if c == "author" else F.col(f"article.{c}").alias("article_html" if c == "html" else c) for c in ARTICLE], date.alias("date"))


#: The rank of the selector whose links count only if they lead to an author's page.
LINKED_RANK = 1


def author_of(said, tags):
    """The meta tags' author unless it is vague and elements name others: the names that the
    first selector with any gives, each once."""
    real = F.filter(tags, lambda t: (t["rank"] != LINKED_RANK) | t["href"].contains("/our-authors/") | t["href"].contains("/author/"))
    named = F.filter(F.transform(real, lambda t: F.struct(t["rank"].alias("rank"), text.clean_author(t["text"]).alias("name"))), lambda t: t["name"].isNotNull())
    best = F.array_min(F.transform(named, lambda t: t["rank"]))
    names = F.transform(F.filter(named, lambda t: t["rank"] == best), lambda t: t["name"])
    low = F.transform(names, F.lower)
    seen = F.nullif(F.array_join(F.filter(names, lambda n, i: F.array_position(low, F.lower(n)) == i + 1), " & "), F.lit(""))
    return F.when(text.is_low_quality_author(said), F.coalesce(seen, said)).otherwise(said)


def extract_author(pages: DataFrame) -> DataFrame:
    """pages with author, null where nothing names one."""
    facts = per_row(_author_facts, _struct(author_said=_S, author_tags=AUTHOR_TAGS), F.col("html"))
    return long_rows(pages).withColumn("facts", facts).withColumn("author", author_of(F.col("facts.author_said"), F.col("facts.author_tags"))).drop("facts")


def first_date(candidates, default_year=None):
    """The first candidate text that parses."""
    parsed = F.transform(candidates, lambda x: dates.parse_date_text(x, default_year))
    return F.get(F.filter(parsed, lambda d: d.isNotNull()), 0)


def with_published_date(pages: DataFrame, name: str = "published_date") -> DataFrame:
    """pages with the date in the url, else the first of the page's date texts that parses."""
    texts = per_row(_date_texts, T.ArrayType(_S), F.col("html"))
    return long_rows(pages).withColumn("date_texts", texts).withColumn(name, F.coalesce(dates.date_from_url(F.col("url")), first_date(F.col("date_texts")))).drop("date_texts")


def extract_published_date(pages: DataFrame) -> DataFrame:
    return with_published_date(pages)


def extract_post_links(pages: DataFrame, default_year: int | None = None) -> DataFrame:
    """(page_id, page_url, link_idx, url, title, published_date): article links of each page,
    the first of each canonical url. A date comes from the url, else from near the link; a
    bare day counts in an archive page's month."""
    raw = long_rows(pages).select("page_id", F.col("url").alias("page_url"), F.posexplode(per_row(pagefacts.links, LINK, F.col("html"), F.col("url"))).alias("link_idx", "link"))
    named = raw.withColumn("url", urls.canonical_url(F.col("link.url"))).where(urls.is_article_url(F.col("url"), F.col("page_url")))
    one = named.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("link_idx"))).where("k = 1")
    dated = one.withColumn("context", urls.archive_context(F.col("page_url")))
    year = F.coalesce(F.lit(default_year).cast("int"), F.col("context.year"))
    day = lambda t: dates.made_date(year, F.col("context.month"), F.regexp_extract(t, r"(?i)\b(\d{1,2})(?:st|nd|rd|th)?\b", 1))
    tried = F.transform("link.near", lambda n: F.when(n["kind"] == "day", day(n["text"])).otherwise(dates.parse_date_text(n["text"], year)))
    near = F.get(F.filter(tried, lambda d: d.isNotNull()), 0)
    return dated.select("page_id", "page_url", "link_idx", "url", F.col("link.title").alias("title"), F.coalesce(dates.date_from_url(F.col("url")), near).alias("published_date"))


def _feed_items(xml: str | None, feed_url: str | None) -> list[dict]:
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(xml or "")
    except (ET.ParseError, ValueError):
        return []
    name = lambda e: e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""
    out = []
    for item in root.iter():
        if name(item) in ("item", "entry"):
            said = lambda *names: next((c.text.strip() for c in item if name(c) in names and c.text), None)  # noqa: E731, B023
            link = said("link") or next((c.get("href") for c in item if name(c) == "link" and c.get("href")), None)
            if link and (whole := pagefacts.joined(feed_url, link)):
                out.append({"link": whole, "title": said("title"), "date": said("pubdate", "published", "updated", "date")})
    return out


def extract_feed_posts(feeds: DataFrame) -> DataFrame:
    """(feed_url, item_idx, url, title, published_date) of RSS items and Atom entries, the
    first of each url; a feed that is no XML gives no rows."""
    items = per_row(_feed_items, T.ArrayType(_struct(link=_S, title=_S, date=_S)), F.col("xml"), F.col("feed_url"))
    raw = long_rows(feeds).select("feed_url", F.posexplode(items).alias("item_idx", "item")).withColumn("url", urls.canonical_url(F.col("item.link")))
    ok = raw.where(urls.is_article_url(F.col("url"), F.col("feed_url")))
    one = ok.withColumn("k", F.row_number().over(Window.partitionBy("feed_url", "url").orderBy("item_idx"))).where("k = 1")
    return one.select("feed_url", "item_idx", "url", F.col("item.title").alias("title"), F.coalesce(dates.date_from_url(F.col("url")), dates.parse_date_text(F.col("item.date"))).alias("published_date"))


# Texts of links to a listing's next page; classes of a forum's; the last page
# of a thread that is followed.
NEXT_TEXTS = ["next", "next page", "older", "older posts", "more"]
FORUM_NEXT_TEXTS = ["next", "next >", "next>"]
FORUM_NEXT_CLASSES = ["pageNav-jump--next", "pageNavSimple-el--next"]
LAST_FORUM_PAGE = 500


def extract_next_page(pages: DataFrame, forum: bool = False) -> DataFrame:
    """pages with next_url: of a listing in canonical form, of a forum as it is. The first
    `next` link tag, else the first link that says so; in a forum a jump link comes before
    links by text or by the next number, and beyond page 500 there is none."""
    jumps, low = F.col("jumps"), lambda j, part="text": F.lower(j[part])
    rel = lambda j: F.split(F.trim(j["rel"]), r"\s+")
    first = lambda test: F.get(F.filter(jumps, test), 0)
    linked = first(lambda j: (j["tag"] == "link") & F.array_contains(rel(j), "next") & (j["href"] != ""))
    if forum:
        number = F.regexp_extract("url", r"(?i)page[-=/_]0*(\d+)", 1)
        current = F.when(F.length(number) > 9, LAST_FORUM_PAGE + 1).otherwise(F.coalesce(number.try_cast("int"), F.lit(1)))
        jump = first(lambda j: (j["tag"] == "a") & (j["href"] != "") & (F.arrays_overlap(j["classes"], F.array(*map(F.lit, FORUM_NEXT_CLASSES))) | (j["rel"] == "next")))
        by_text = first(lambda j: (j["tag"] == "a") & (j["href"] != "") & (low(j, "tight").isin(FORUM_NEXT_TEXTS) | (j["tight"] == (current + 1).cast("string"))))
        target = F.when(current <= LAST_FORUM_PAGE, F.coalesce(linked, jump, by_text)["target"])
    else:
        target = urls.canonical_url(F.coalesce(linked, first(lambda j: (j["tag"] == "a") & (low(j).isin(NEXT_TEXTS) | low(j, "rel").contains("next"))))["target"])
    return long_rows(pages).withColumn("jumps", per_row(pagefacts.jumps, JUMP, F.col("html"), F.col("url"))).withColumn("next_url", target).drop("jumps")


def extract_images(pages: DataFrame) -> DataFrame:
    """One row per image worth keeping: page_id, image_idx, url, alt, viewer_url, caption,
    container, srcset, filename_hint."""
    return long_rows(pages).select("page_id", F.posexplode(per_row(pagefacts.images, IMAGE, F.col("html"), F.col("url"))).alias("image_idx", "image")).select("page_id", "image_idx", "image.*")


def extract_captions(pages: DataFrame) -> DataFrame:
    return extract_images(pages).where("caption IS NOT NULL").select("page_id", "image_idx", "url", "caption")


def extract_metadata_images(pages: DataFrame, most: int = 3) -> DataFrame:
    """The first images that a page's metadata name, junk left out; `most` is the feature."""
    found = per_row(pagefacts.metadata_images, T.ArrayType(_S), F.col("html"), F.col("url"))
    good = F.slice(F.filter(found, lambda u: ~classify.is_junk_image(u)), 1, most)
    return long_rows(pages).select("page_id", F.posexplode(good).alias("image_idx", "url"))


def rank_image_candidates(images: DataFrame, most: int = 2, lede_col: str | None = None) -> DataFrame:
    """images (url, srcset) with candidates: the lede, what a proxy hides, wide sources, the
    url, the url without query, narrower sources; junk and blurred ones out, each once."""
    sources = text.srcset_candidates(F.col("srcset"))
    wide, narrow = (F.transform(F.filter(sources, t), lambda s: s["url"]) for t in (lambda s: s["width"] >= 600, lambda s: s["width"] < 600))
    lede = F.array(F.col(lede_col)) if lede_col else F.array().cast("array<string>")
    every = F.concat(lede, wide, F.array(urls.image_origin_url(F.col("url")), F.col("url"), F.regexp_replace("url", r"(?s)\?.*$", "")), narrow)
    good = F.filter(every, lambda u: ~classify.is_junk_image(u) & ~classify.is_blur_placeholder(u))
    return images.withColumn("candidates", F.slice(F.array_distinct(good), 1, most))


def collapse_image_sequences(images: DataFrame, least: int = 4) -> DataFrame:
    """Of a container with four or more frames that carry a year, only the active one stays
    (a column `active`, if there is one), else the latest year's."""
    year = F.regexp_extract("url", r"(?:^|[^0-9])((?:19|20)\d{2})(?:[^0-9]|$)", 1).try_cast("int")
    active = F.coalesce(F.col("active"), F.lit(False)) if "active" in images.columns else F.lit(False)
    box = Window.partitionBy("page_id", "container")
    frame = images.withColumn("frame_year", year).withColumn("frames", F.count("frame_year").over(box))
    best = F.row_number().over(Window.partitionBy("page_id", "container", F.col("frame_year").isNull()).orderBy(active.desc(), F.desc("frame_year"), "image_idx"))
    kept = frame.withColumn("best", best).where((F.col("container").isNull()) | (F.col("frames") < least) | F.col("frame_year").isNull() | (F.col("best") == 1))
    return kept.drop("frame_year", "frames", "best")


def extract_forum_posts(pages: DataFrame) -> DataFrame:
    """forum pages (thread_url, page, url, html) to one row per post, in order by pos."""
    keep = [c for c in pages.columns if c not in ("html", "url")]
    posts = per_row(pagefacts.forum_posts, POST, F.col("html"), F.col("url"))
    return long_rows(pages).select(*keep, F.posexplode(posts).alias("pos", "post")).select(*keep, "pos", "post.*")


def extract_blog_comments(pages: DataFrame) -> DataFrame:
    """Flat comments of blog pages: thread_id is the page's url."""
    found = per_row(pagefacts.blog_comments, COMMENT, F.col("html"), F.col("url"))
    return long_rows(pages).select(F.col("url").alias("thread_id"), F.explode(found).alias("c")).select("thread_id", "c.*")


def extract_newsletter_ids(pages: DataFrame) -> DataFrame:
    """pages with post_id, publication_id and subdomain of a newsletter page: from the data
    it preloads, else from its meta tags, else (the subdomain) from its og:url."""
    raw = F.regexp_extract("html", r'window\._preloads\s*=\s*JSON\.parse\("((?:[^"\\]|\\.)*)"\)', 1)
    data = F.replace(F.replace(raw, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    tag = lambda k: F.nullif(F.regexp_extract("html", rf'<meta[^>]*(?:name|property)="{k}"[^>]*content="([^"]*)"', 1), F.lit(""))
    site = F.regexp_extract(tag("og:url"), r"^https?://([^./]+)\.", 1)
    return pages.withColumns({
        "post_id": F.coalesce(F.get_json_object(data, "$.post.id"), tag("substack:post_id")), "publication_id": F.coalesce(F.get_json_object(data, "$.pub.id"), tag("substack:publication_id")),
        "subdomain": F.coalesce(F.get_json_object(data, "$.pub.subdomain"), F.nullif(site, F.lit(""))),
    })


def detect_paywall(pages: DataFrame) -> DataFrame:
    """Pages behind a paywall, and whether their text is long enough to use. Only pages that
    have the name of a mark, or one that may hide behind a character reference, are parsed."""
    names = [re.sub(r"^[.#]|^.*=\"|\"\]$", "", s) for s in pagefacts.PAYWALLS]
    return extract_articles(pages.where(F.col("html").rlike("|".join(["&#", *names])))).where("is_paywall").select("page_id", "url", "content_usable")


# Words of links that lead to tables.
TABLE_HINTS = ["table", "results", "rankings", "standings", "data", "statistics", "scores", "list"]
TABLE = T.ArrayType(_struct(heading=_S, rows=T.ArrayType(T.ArrayType(_S))))


def _tables(html: str | None) -> list[dict]:
    """Tables with two or more rows that say something, with the nearest heading before."""
    out, heading = [], None
    for n in pagefacts.parse(html).elements():
        if n.tag in ("h1", "h2", "h3", "h4", "caption"):
            words = pagefacts.compact(n.text())
            heading = words if len(words) <= 120 else heading
        if n.tag == "table":
            rows = [[pagefacts.compact(c.text()) for c in r.find_all("td", "th")] for r in n.find_all("tr")]
            rows = [r for r in rows if sum(bool(c) for c in r) >= 2]
            if len(rows) >= 2:
                out.append({"heading": heading, "rows": rows})
    return out


def extract_tables(pages: DataFrame, per_page: int = 20, most: int = 12) -> DataFrame:
    """(page_id, table_idx, heading, rows): the first tables of each page, each once by its
    first 500 characters; the limits are the feature's."""
    raw = long_rows(pages).select("page_id", F.posexplode(F.slice(per_row(_tables, TABLE, F.col("html")), 1, per_page)).alias("table_idx", "t"))
    key = F.substring(F.to_json("t.rows"), 1, 500)
    one = raw.withColumn("k", F.row_number().over(Window.partitionBy("page_id", key).orderBy("table_idx"))).where("k = 1")
    return one.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("table_idx"))).where(F.col("k") <= most).select("page_id", "table_idx", "t.heading", "t.rows")


def linked_tables(pages: DataFrame, per_page: int = 2) -> DataFrame:
    """Tables of same-site pages that a page without tables links to with a hint word."""
    own = extract_tables(pages)
    bare = pages.join(own.select("page_id").distinct(), "page_id", "left_anti")
    raw = long_rows(bare).select("page_id", F.col("url").alias("page_url"), F.posexplode(per_row(pagefacts.links, LINK, F.col("html"), F.col("url"))).alias("i", "link"))
    hint = F.lower(F.concat_ws(" ", "link.title", "link.url")).rlike("|".join(TABLE_HINTS))
    near = raw.where(hint & urls.is_internal_url(F.col("link.url"), F.col("page_url"))).withColumn("key", urls.url_match_key(F.col("link.url"))).groupBy("page_id", "key").agg(F.min("i").alias("i"))
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("i"))).where(F.col("k") <= per_page)
    there = own.join(pages.select("page_id", urls.url_match_key(F.col("url")).alias("key")), "page_id").withColumnRenamed("page_id", "table_page_id")
    return near.join(there, "key").select("page_id", "table_page_id", "table_idx", "heading", "rows")


def summary_input(chapters: DataFrame, most: int = 25_000) -> DataFrame:
    """(book_id, summary_text): the chapters' text (book_id, chapter_idx, text), cut at `most`
    characters. Null texts are no chapters; a book without any has an empty summary.

    Where each chapter begins is a running length over ids and lengths alone; only chapters
    that begin by the cut are fetched (one right at it leaves its line's end), and no more of
    a text than the cut, so a group holds about `most` characters whatever the size of its
    book."""
    own = chapters.select("book_id", "chapter_idx", "text", F.xxhash64("text").alias("mark"))
    sizes = own.where("text IS NOT NULL").groupBy("book_id", "chapter_idx", "mark").agg((F.count(F.lit(1)) * (F.max(F.length("text")) + 1)).alias("size"))
    before = Window.partitionBy("book_id").orderBy("chapter_idx", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("begins", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("begins") <= most)
    kept = placed.select(F.col("book_id").alias("of_book"), F.col("chapter_idx").alias("of_chapter"), F.col("mark").alias("of_mark"), "begins")
    same = own["book_id"].eqNullSafe(kept["of_book"]) & own["chapter_idx"].eqNullSafe(kept["of_chapter"]) & (own["mark"] == kept["of_mark"])
    cut = own.where("text IS NOT NULL").join(kept, same).select("book_id", "begins", F.substring("text", F.lit(1), (F.lit(most) - F.col("begins")).cast("int")).alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begins", "text"))), lambda c: c["text"]), "\n")
    said = cut.groupBy("book_id").agg(F.substring(body, 1, most).alias("summary_text"))
    empty = chapters.groupBy("book_id").agg(F.count("text").alias("n")).where("n = 0").select("book_id", F.lit("").alias("summary_text"))
    return said.union(empty)


def forum_summary_input(posts: DataFrame, first: int = 5) -> DataFrame:
    """(thread_url, summary_text): a thread's first posts, `Post by {author}: {text}`."""
    ranked = posts.withColumn("k", F.row_number().over(Window.partitionBy("thread_url").orderBy("page", "pos"))).where(F.col("k") <= first)
    line = F.concat(F.lit("Post by "), F.col("author"), F.lit(": "), F.col("text"))
    return ranked.groupBy("thread_url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda p: p["line"]), "\n\n").alias("summary_text"))
