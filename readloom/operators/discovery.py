"""Discovery: listing pages to a dated list of posts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import dates, urls
from readloom.functions.tables import stored

from . import extract


#: Pages that are asked for by their ids, which reach the scan; more are joined.
FETCH = 1000


def _fetched(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pages that wanted (page_id) names. As they are few and parsing them is slow, they
    are dealt to as many tasks as a shuffle has."""
    ids = [r[0] for r in wanted.limit(FETCH + 1).collect()]
    if len(ids) > FETCH:
        return pages.join(wanted, "page_id", "left_semi")
    tasks = min(len(ids), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pages.where(F.col("page_id").isin(ids)).repartition(max(1, tasks), "page_id")


def follow_listing_pages(seeds: DataFrame, pages: DataFrame, max_pages: int = 20) -> DataFrame:
    """(seed_idx, page_idx, url, page_id): each seed (seed_idx, url) and the pages after it,
    over pages (page_id, url, next_url; or html in place of next_url). It stops at a page
    seen before, a missing one, or max_pages. What a seed has visited travels with it.

    The urls of all pages are keyed once; each step joins the few pages that seeds stand on
    to these keys, and only those pages are fetched by id and parsed for the next url: at
    most one for each seed and step."""
    parsed = "next_url" in pages.columns
    own = F.struct("page_id", "next_url") if parsed else F.struct("page_id")
    known = stored(pages.withColumn("url", urls.canonical_url(F.col("url"))).groupBy("url").agg(F.min_by(own, "page_id").alias("p")).select("url", "p.*"))
    front = seeds.select("seed_idx", urls.canonical_url(F.col("url")).alias("url"), F.array().cast("array<string>").alias("visited"))
    out = None
    for step in range(max(1, max_pages)):
        here = front.where(~F.array_contains("visited", F.col("url"))).join(known, "url")
        if parsed or step + 1 == max(1, max_pages):  # after the last step no page is asked for
            here = stored(here if parsed else here.withColumn("next_url", F.lit(None).cast("string")))
        else:
            here = stored(here)
            ids = stored(here.select("page_id").distinct())
            after = extract.extract_next_page(_fetched(pages, ids).select("page_id", "url", "html")).select("page_id", "next_url")
            here = stored(here.join(after, "page_id", "left"))
        if here.isEmpty():
            break
        rows = here.select("seed_idx", F.lit(step).alias("page_idx"), "url", "page_id")
        out = rows if out is None else out.union(rows)
        front = here.where("next_url IS NOT NULL").select("seed_idx", F.col("next_url").alias("url"), F.concat("visited", F.array("url")).alias("visited"))
    return out if out is not None else seeds.select("seed_idx", F.lit(0).alias("page_idx"), "url", F.lit(None).cast("long").alias("page_id")).limit(0)


def hydrate_dates(posts: DataFrame, pages: DataFrame, mode: str = "metadata") -> DataFrame:
    """posts with missing dates filled from the post's own stored page: `shallow` leaves
    them, `metadata`, `auto` and `full` take the page's published date (auto and full then
    the article's, which is the same rule here)."""
    if mode == "shallow":
        return posts
    if mode not in ("metadata", "auto", "full"):
        raise ValueError(f"unknown mode {mode!r}")
    undated = posts.where("published_date IS NULL").select(F.col("url").alias("key")).distinct()
    # only pages of undated posts are fetched and parsed
    keys = pages.select("page_id", urls.canonical_url(F.col("url")).alias("key")).join(undated, "key", "left_semi")
    wanted = stored(keys.select("page_id").distinct())
    own = extract.with_published_date(_fetched(pages, wanted).withColumn("key", urls.canonical_url(F.col("url"))), "page_date").groupBy("key").agg(F.min_by("page_date", "page_id").alias("page_date"))
    return posts.join(own, posts["url"] == own["key"], "left").withColumn("published_date", F.coalesce("published_date", "page_date")).drop("key", "page_date")


def feed_fallback(seeds: DataFrame, found: DataFrame, feeds: DataFrame) -> DataFrame:
    """Posts of feeds (feed_url, xml) for seeds without any in found (seed_idx): of the root's
    four feeds, then of the path's, the first that has posts."""
    bare = seeds.join(found.select("seed_idx").distinct(), "seed_idx", "left_anti")
    root = F.concat(urls.part(F.col("url"), "scheme"), F.lit("://"), urls.part(F.col("url"), "netloc"), F.lit("/"))
    folder = F.concat(F.regexp_replace(F.regexp_replace("url", r"(?s)[?#].*$", ""), "/+$", ""), F.lit("/"))
    names = ["feed", "rss", "atom.xml", "index.xml"]
    places = F.array(*[F.concat(root, F.lit(n)) for n in names], *[F.concat(folder, F.lit(n)) for n in names])
    tried = bare.select("seed_idx", F.posexplode(F.array_distinct(places)).alias("rank", "feed_url"))
    posts = extract.extract_feed_posts(feeds)
    hits = tried.join(posts, "feed_url")
    first = hits.groupBy("seed_idx").agg(F.min("rank").alias("rank"))
    return hits.join(first, ["seed_idx", "rank"]).select("seed_idx", F.col("item_idx").alias("link_idx"), "url", "title", "published_date")


def discover_posts(
    seeds: DataFrame, pages: DataFrame, feeds: DataFrame | None = None, start: str | None = None, end: str | None = None, include_undated: bool = False, descending: bool = False,
    max_pages: int = 20, max_posts: int = 200, mode: str = "metadata", default_year: int | None = None,
) -> DataFrame:
    """(rank, url, title, published_date): candidates in order of seed, page and link (the
    seed itself first if it is an article), the first of each url over all seeds, at most
    max_posts; dates filled; inside the range; by date, undated last, ties in order of
    discovery. No post at all is an error, when the result is built."""
    dates.in_date_range(F.lit(None), start, end)
    listing = follow_listing_pages(seeds, pages.select("page_id", "url", "html"), max_pages)
    links = extract.extract_post_links(_fetched(pages, stored(listing.select("page_id").distinct())), default_year)
    from_pages = listing.select("seed_idx", "page_idx", "page_id").join(links, "page_id").select("seed_idx", "page_idx", "link_idx", "url", "title", "published_date")
    own = seeds.withColumn("c", urls.canonical_url(F.col("url"))).where(urls.is_article_url(F.col("c"), F.col("url")))
    found = own.select("seed_idx", F.lit(-1).alias("page_idx"), F.lit(0).alias("link_idx"), F.col("c").alias("url"), F.lit(None).cast("string").alias("title"), dates.date_from_url(F.col("c")).alias("published_date")).unionByName(from_pages)
    if feeds is not None:
        found = stored(found)
        more = feed_fallback(seeds, found, feeds).withColumn("page_idx", F.lit(0)).select(*found.columns)
        found = found.unionByName(more)
    place = ["seed_idx", "page_idx", "link_idx"]
    one = found.withColumn("k", F.row_number().over(Window.partitionBy("url").orderBy(*place))).where("k = 1").drop("k")
    some = stored(one.orderBy(*place).limit(max_posts))
    if some.isEmpty():
        raise ValueError("no posts found")
    dated = hydrate_dates(some, pages, mode)
    kept = dated.where(dates.in_date_range(F.col("published_date"), start, end, include_undated))
    date = F.desc_nulls_last("published_date") if descending else F.asc_nulls_last("published_date")
    # at most max_posts rows
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(date, *place))).select("rank", "url", "title", "published_date")
