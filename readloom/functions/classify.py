"""Routing and image classes of urls and pages as Column expressions."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import urls
from .helpers import per_row
from .tables import stored

# Aliases of drivers in site profiles.
ALIASES = {"forum": "forum", "xenforo": "forum", "wordpress": "wordpress", "substack": "substack", "hn": "hn", "hackernews": "hn", "reddit": "reddit", "youtube": "youtube", "generic": "generic"}


def driver(url: Column, html: Column, is_forum: Column, alias: Column | None = None) -> Column:
    """The kind of page, first rule that applies: the profile's alias, the forum flag, the
    url, then marks in the html; else generic."""
    netloc, text = urls.part(url, "netloc"), F.coalesce(html, F.lit(""))
    by_alias = F.lit(None).cast("string")
    if alias is not None:
        by_alias = F.try_element_at(F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p]), F.lower(alias))
    rest = (
        F.when(F.coalesce(is_forum, F.lit(False)), "forum")
        .when(url.contains("news.ycombinator.com"), "hn")
        .when(netloc.contains("reddit.com") | netloc.endswith("redd.it"), "reddit")
        .when(url.contains("substack.com") | urls.part(url, "path").contains("/p/"), "substack")
        .when(url.contains("wordpress.com"), "wordpress")
        .when(urls.host(url).isin([*urls.VIDEO_HOSTS, urls.SHORT_VIDEO_HOST]), "youtube")
        .when(text.contains("substack:post_id"), "substack")
        .when(text.contains('data-template="thread_view"') | F.lower(text).contains("xenforo"), "forum")
        .when(text.contains('name="generator" content="WordPress"') | text.contains('class="comment-list"'), "wordpress")
        .otherwise("generic")
    )
    return F.coalesce(by_alias, rest)


def route_pages(pages: DataFrame, alias_col: str | None = None) -> DataFrame:
    """pages (url, html, is_forum) with a driver."""
    return pages.withColumn("driver", driver(F.col("url"), F.col("html"), F.col("is_forum"), F.col(alias_col) if alias_col else None))


#: Characters of the longest literal part that is looked up.
GRAM = 4


def required_part(pattern: str | None) -> str | None:
    """Characters, GRAM at most, that stand in a row in every match of a pattern; empty if
    the pattern asks for none, null if it is no pattern. Letters and digits are preferred,
    as points and slashes stand in every url."""
    try:
        tree = re._parser.parse(pattern)
    except (re.error, TypeError, OverflowError, RecursionError):
        return None
    runs, now = [], ""
    if not tree.state.flags & (re.IGNORECASE | re.LOCALE):
        for kind, what in [*tree, (None, None)]:
            # a plain group continues the run; what may be absent or differ ends it
            inner = what[3] if kind is re._constants.SUBPATTERN and not what[1] else [(kind, what)]
            for k, x in inner:
                if k is re._constants.LITERAL:
                    now += chr(x)
                elif k is not re._constants.AT:
                    runs, now = [*runs, now], ""
    grams = [r[i : i + GRAM] for r in runs for i in range(max(1, len(r) - GRAM + 1))]
    return max(grams, key=lambda g: (len(g), sum(c.isalnum() for c in g) - 2 * (g in ("http", "ttps"))), default="")


def _searched(pattern: str | None, url: str | None) -> bool:
    return url is not None and re.search(pattern, url) is not None


def profile_matches(pages: DataFrame, profiles: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, profile) of the pages that some profile's domain pattern is found in: the last
    loaded such profile, as a struct. Only keys and urls are read. Patterns that are no
    regular expressions are left out.

    Each pattern is looked up by a part that it requires: the pieces of a url of that size
    are joined to the parts by equality, and the pattern is tried on the urls that have its
    part. A pattern that requires none has the empty part, which every url has."""
    of = {c: F.col(c) for c in profiles.columns}
    parts = profiles.select(F.struct(*of.values()).alias("p"), F.explode("domains").alias("pattern")).withColumn("part", per_row(required_part, T.StringType(), F.col("pattern"))).where("part IS NOT NULL")
    parts = stored(parts)
    sizes = sorted(r[0] for r in parts.select(F.length("part")).distinct().collect())  # 0 to GRAM
    url = F.col("url")
    none = F.array().cast("array<string>")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(url) - n + 1), lambda i: F.substring(url, i, F.lit(n)))
    pieces = [none, *[F.when(F.length(url) >= n, cut(n)).otherwise(none) if n else F.array(F.lit("")) for n in sizes]]
    split = pages.where("url IS NOT NULL").select(key, "url", F.explode(F.array_distinct(F.concat(*pieces))).alias("part"))
    met = split.join(parts, "part").where(per_row(_searched, T.BooleanType(), F.col("pattern"), F.col("url")))
    return met.groupBy(key).agg(F.max_by("p", F.col("p.priority")).alias("profile"))


def match_site_profile(pages: DataFrame, profiles: DataFrame, key: str = "page_id") -> DataFrame:
    """pages with profile, as profile_matches finds it, else null. Spark broadcasts the
    matches if they are small; key and profile alone answer without moving a page."""
    found = stored(profile_matches(pages, profiles, key)).withColumnRenamed(key, "of_page")
    return pages.join(found, pages[key] == found["of_page"], "left").drop("of_page")


# Marks of pages that hold a challenge instead of content, in order.
CHALLENGES = [
    "geo.captcha-delivery.com", "datadome", "you have been blocked from the new york times", "to continue to the new york times, please confirm that you are human", "verification required",
    "slide right to secure your access", "please enable js and disable any ad blocker", "enable javascript and cookies to continue", "checking your browser before accessing",
]


def challenge(html: Column) -> Column:
    """The first of CHALLENGES in the html, else null."""
    low = F.lower(html)
    return F.coalesce(*[F.when(low.contains(x), F.lit(x)) for x in CHALLENGES])


# Parts of urls of junk images; of a forum's; of its furniture.
JUNK = ["spacer", "1x1", "transparent", "gray.gif", "pixel.gif", "placeholder", "loader", "blank.gif", "grey-placeholder", "gray-placeholder", "arc-authors", "author-bio", "avatar"]
FORUM_JUNK = ["spacer", "1x1", "transparent", "gray.gif", "pixel.gif", "placeholder", "loader", "blank.gif", "reaction_id=", "/react?", "reactions/emojione"]
FORUM_CHROME = ["images.platforum.cloud/logos/", "platforum.cloud/logos/", "privacyoptions", "/banners/", "_banner_", "/styles/", "/assets/", "/reactions/", "/smilies/", "/emoji/", "/avatars/", "/avatar"]
CHROME_NAMES = ["logo.svg", "logo.png", "favicon.ico"]
BLUR = ["data-blursrc", "blur=", "/blur/", "blurhash"]
LOW_VALUE = ["/avatar", "/reaction", "/smilies", "/emoji", "data:image/gif", "logo", "sprite"]


def _has(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | text.contains(x)
    return out


def is_junk_image(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return (u == "") | u.startswith("data:") | _has(F.lower(u), JUNK)


def is_blur_placeholder(url: Column) -> Column:
    return _has(F.lower(F.coalesce(url, F.lit(""))), BLUR)


def is_forum_junk_image(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return (u == "") | u.startswith("data:") | u.startswith("view-source:") | _has(F.lower(u), FORUM_JUNK)


def is_forum_chrome_image(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return (low == "") | _has(low, FORUM_CHROME) | F.regexp_extract(urls.part(low, "path"), "([^/]*)$", 1).isin(CHROME_NAMES)


def is_low_value_image(url: Column, alt: Column) -> Column:
    low, said = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(alt, F.lit("")))
    return (low == "") | low.startswith("data:") | _has(low, LOW_VALUE) | ((F.length(said) <= 24) & _has(said, ["logo", "avatar"]))


def classify_image_url(images: DataFrame, url_col: str = "src", alt_col: str = "alt") -> DataFrame:
    """images with five flags."""
    url, alt = F.col(url_col), F.col(alt_col)
    return images.withColumns(
        {"is_junk": is_junk_image(url), "is_blur": is_blur_placeholder(url), "is_forum_junk": is_forum_junk_image(url), "is_forum_chrome": is_forum_chrome_image(url), "is_low_value": is_low_value_image(url, alt)}
    )
