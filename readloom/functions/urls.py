"""URL functions as Column expressions. All are total: odd text gives null or empty parts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _text(url: Column) -> Column:
    return F.coalesce(url, F.lit(""))


def bound(value: Column, fn) -> Column:
    """fn of a value that is computed once, however often fn uses it: an optimizer that
    moves filters puts whole expressions in place of names, and nested use multiplies."""
    return F.get(F.transform(F.array(value), fn), 0)


def part(url: Column, which: str) -> Column:
    """scheme, netloc, path (without ;parameters), query or fragment; empty if absent."""
    at = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}[which]
    found = F.regexp_extract(_text(url), _SPLIT, at)
    return F.regexp_replace(found, r";[^/]*$", "") if which == "path" else found


def until_query(url: Column) -> Column:
    """A url before its first ? or #."""
    return F.substring_index(F.substring_index(url, "?", 1), "#", 1)


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    bare = F.regexp_replace(part(url, "netloc"), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":\d*$", ""))


def decoded(value: Column) -> Column:
    """A decoded query value; text with bad escapes is left as it is."""
    return F.coalesce(F.try_url_decode(value), value)


def query_value(url: Column, key: str) -> Column:
    """First non-blank value of a query key, decoded; null if there is none."""
    raw = F.regexp_extract(part(url, "query"), rf"(?:^|&){key}=([^&]+)", 1)
    return decoded(F.nullif(raw, F.lit("")))


# Query keys that may hold the real image url, in order.
EMBEDDED_KEYS = ["url", "src", "original", "image", "img"]


def url_match_key(url: Column) -> Column:
    """Comparison key of a url. An http(s) url in one of EMBEDDED_KEYS stands for the whole,
    at any depth. Every scheme and one leading www. go, so do query, fragment and final
    slashes; the rest is lower-cased. Null gives ''."""

    def inside(u: Column, _: Column) -> Column:
        again = [decoded(F.replace(query_value(u, k), F.lit("+"), F.lit("%2B"))) for k in EMBEDDED_KEYS]
        return F.coalesce(*[F.nullif(F.regexp_extract(v, "(?s)^https?://.*$", 0), F.lit("")) for v in again], u)

    # a loop inside one expression, only for urls with such a key; every level has its own
    # = sign, encoded as often as it lies deep (=, %3D, %253D ..), so there are no more turns
    text = _text(url)
    keyed = text.rlike(rf"[?&](?:{'|'.join(EMBEDDED_KEYS)})=")
    turns = F.when(keyed, F.sequence(F.lit(1), F.regexp_count(text, F.lit("=|3[dD]")))).otherwise(F.array().cast("array<int>"))
    inner = F.aggregate(turns, text, inside)
    bare = F.replace(F.replace(inner, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.lower(F.regexp_replace(until_query(F.regexp_replace(bare, r"^www\.", "")), "/+$", ""))


# Hosts whose /doc pages are told apart by query keys, and those keys.
KEYED_HOST, KEYED_PATH, KEYED = "crazyguyonabike.com", "/doc", ["doc_id", "v"]


def _is_keyed(url: Column) -> Column:
    return F.lower(part(url, "netloc")).endswith(KEYED_HOST)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, single slashes, no final slash, no parameters, query or
    fragment; only KEYED_HOST keeps its keys. Null stays null."""
    return bound(url, lambda u: bound(F.regexp_replace(part(u, "path"), "/+", "/"), lambda p: _canonical(u, p)))


def _canonical(url: Column, path: Column) -> Column:
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/$", ""))
    scheme, netloc = F.lower(part(url, "scheme")), F.lower(part(url, "netloc"))
    kept = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(query_value(url, k))) for k in KEYED])
    query = F.when(_is_keyed(url) & (path == KEYED_PATH) & (kept != ""), F.concat(F.lit("?"), kept)).otherwise("")
    rooted = F.when((netloc != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    made = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""), rooted, query)
    return F.when(url.isNotNull(), made)


def is_internal_url(url: Column, base: Column) -> Column:
    """The host is the base's host or lies below it."""
    h, b = host(url), host(base)
    return (h == b) | h.endswith(F.concat(F.lit("."), b))


# Path parts that no article has.
BLOCKED_PARTS = [
    "/about/", "/authors/", "/author/", "/tag/", "/category/", "/archive/", "/recommendations/", "/account/", "/subscribe/", "/privacy", "/terms", "/films/", "/books-in-progress/",
]


def is_article_url(url: Column, base: Column) -> Column:
    """Whether a url of the base's site looks like an article's."""
    return bound(url, lambda u: is_internal_url(u, base) & bound(F.regexp_replace(part(u, "path"), "^/+|/+$", ""), lambda p: _article_path(u, p)))


def _article_path(url: Column, path: Column) -> Column:
    low = F.concat(F.lit("/"), F.lower(path), F.lit("/"))
    blocked = F.lit(False)
    for x in BLOCKED_PARTS:
        blocked = blocked | low.contains(x)
    n_parts = F.size(F.split(path, "/"))
    issue = low.startswith("/issue/") & (n_parts >= 2)
    dated = low.rlike(r"/\d{4}/\d{1,2}/\d{1,2}/[^/]+") | low.contains("/p/")
    rest = F.when(issue, ~F.lower(path).rlike(r"^issue/\d+$")).otherwise((n_parts == 1) & path.contains("-"))
    keyed = _is_keyed(url) & (path == KEYED_PATH[1:]) & query_value(url, KEYED[0]).isNotNull()
    return keyed | ((path != "") & ~blocked & (dated | rest))


def archive_context(url: Column) -> Column:
    """(year, month) of a path with /yyyy/mm, else null."""
    found = r"/(\d{4})/(\d{1,2})(?:/|$)"
    path = part(url, "path")
    month = F.regexp_extract(path, found, 2).try_cast("int")
    return F.when(month.between(1, 12), F.struct(F.regexp_extract(path, found, 1).try_cast("int").alias("year"), month.alias("month")))


def thread_url(url: Column) -> Column:
    """A forum thread's url without its page."""
    bare = F.regexp_replace(url, "/+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"/page-\d+", ""), r"([?&])page=\d+", "$1")
    return F.regexp_replace(bare, "[?&]+$", "")


def thread_page_number(url: Column) -> Column:
    """The number after page- or page=, else null."""
    return F.regexp_extract(url, r"(?i)page[-=](\d+)", 1).try_cast("int")


def thread_page_url(url: Column, page: Column) -> Column:
    """The url of a thread's page; page 1 and below is the thread itself."""
    number = F.concat(F.lit("page-"), page.cast("string"))
    path, query = part(url, "path"), part(url, "query")
    new_query = F.when(query.rlike(r"page-\d+"), F.regexp_replace(query, F.lit(r"page-\d+"), number)).otherwise(F.concat(F.regexp_replace(query, "/+$", ""), F.lit("/"), number))
    slash = F.when(path.endswith("/"), F.lit("")).otherwise("/")
    new_path = F.when(path.rlike(r"page-\d+"), F.regexp_replace(path, F.lit(r"page-\d+"), number)).otherwise(F.concat(path, slash, number))
    in_query = query.startswith("threads/")
    q = F.when(in_query, new_query).otherwise(query)
    tail = F.concat(F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""), F.when(part(url, "fragment") != "", F.concat(F.lit("#"), part(url, "fragment"))).otherwise(""))
    lead = F.regexp_extract(_text(url), r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?", 0)
    return F.when(page <= 1, url).otherwise(F.concat(lead, F.when(in_query, path).otherwise(new_path), tail))


# Hosts of the video site.
VIDEO_HOSTS = ["www.youtube.com", "youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com"]
SHORT_VIDEO_HOST = "youtu.be"


def video_id(url: Column) -> Column:
    """The id in a video url, else null."""
    h, path = host(url), part(url, "path")
    short = F.nullif(F.regexp_replace(path, "^/+|/+$", ""), F.lit(""))
    after = lambda mark: F.regexp_extract(path, f"{mark}([^/]*)", 1)
    long = F.when(path.contains("/watch"), query_value(url, "v")).when(path.contains("/embed/"), after("/embed/")).when(path.contains("/v/"), after("/v/"))
    return F.when(h == SHORT_VIDEO_HOST, short).when(h.isin(VIDEO_HOSTS), long)


# Query keys that only set an image's size.
SIZE_KEYS = ["w", "q", "fit", "h", "fm"]


def image_origin_url(url: Column, proxy_pattern: Column | None = None) -> Column:
    """The image behind a proxy's url, or the url without a query that sets the size only;
    null if neither applies."""
    path, netloc = part(url, "path"), part(url, "netloc")
    where = F.when(path == "", netloc).otherwise(path)
    src_first = F.coalesce(*[query_value(url, k) for k in ("src", "url", "original")])
    url_first = F.coalesce(*[query_value(url, k) for k in ("url", "src", "original")])
    sized = F.lit(False)
    for k in SIZE_KEYS:
        sized = sized | query_value(url, k).isNotNull()
    picture = path.rlike(r"(?i)\.(jpe?g|png|webp|gif|svg)$")
    fragment = part(url, "fragment")
    bare = F.concat(F.regexp_replace(url, r"(?s)[?#].*$", ""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    out = F.when(path.startswith("/.netlify/images"), url_first).when(path.contains("imrs.php") | where.contains("resizer") | where.contains("proxy"), src_first).when((netloc != "") & sized & picture, bare)
    if proxy_pattern is None:
        return out
    named = F.coalesce((proxy_pattern != "") & path.contains(proxy_pattern), F.lit(False))
    return F.when(named, src_first).otherwise(out)
