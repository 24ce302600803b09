"""Text functions as Column expressions."""

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_text(text: Column) -> Column:
    """Blanks (Unicode) collapsed to one space, none at the ends; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def safe_filename(name: Column) -> Column:
    """Without control and path characters, blanks as _, at most 150 characters."""
    bare = F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]', "")
    under = F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "untitled").otherwise(F.substring(under, 1, 150))


# Base names that say nothing of an image.
GENERIC_BASENAMES = ["default", "image", "img", "thumbnail", "thumb", "media", "asset", "download", "untitled", "unnamed"]


def image_basename(url: Column) -> Column:
    """Base of an image's file name: of its path, without the extension; a generic or
    numeric one gets ten digits of the url's sha1."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = safe_filename(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    base = F.when(F.length(stem) < 3, "image").otherwise(stem)
    plain = F.regexp_replace(F.lower(base), "[^a-z0-9]+", "")
    generic = (F.length(plain) < 3) | plain.rlike("^[0-9]+$") | plain.isin(GENERIC_BASENAMES)
    return F.when(generic, F.concat(base, F.lit("_"), F.substring(F.sha1(F.coalesce(url, F.lit(""))), 1, 10))).otherwise(base)


def page_spec(spec: Column) -> Column:
    """`1,3-5` as sorted distinct positive numbers; bad parts are skipped; null if none."""

    def numbers(p: Column) -> Column:
        one, a, b = (F.regexp_extract(p, r, 1).try_cast("int") for r in (r"^\s*(\d+)\s*$", r"^\s*(\d+)\s*-", r"-\s*(\d+)\s*$"))
        whole = p.rlike(r"^\s*\d+\s*-\s*\d+\s*$") & a.isNotNull() & b.isNotNull()
        return F.when(one.isNotNull(), F.array(one)).when(whole, F.sequence(F.least(a, b), F.greatest(a, b))).otherwise(F.array().cast("array<int>"))

    found = F.flatten(F.transform(F.split(spec, ","), numbers))
    return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(F.filter(found, lambda x: x > 0))))


#: Quotation marks that titles are compared without.
QUOTES = "“”\"'‘’"


def normalized_title(text: Column, quotes: str = QUOTES) -> Column:
    """Lower case, without quotation marks, blanks collapsed."""
    return compact_text(F.translate(F.lower(compact_text(text)), quotes, ""))


# What may follow a title in a longer one.
TITLE_SEPARATORS = [" | ", " - ", " – ", " — ", ": "]


def titles_equivalent(a: Column, b: Column, quotes: str = QUOTES) -> Column:
    """Equal when normalised, or both of 20 or more characters and one begins with the
    other and a separator."""
    x, y = normalized_title(a, quotes), normalized_title(b, quotes)
    longer = F.lit(False)
    for s in TITLE_SEPARATORS:
        longer = longer | y.startswith(F.concat(x, F.lit(s))) | x.startswith(F.concat(y, F.lit(s)))
    return (x != "") & (y != "") & ((x == y) | ((F.length(x) >= 20) & (F.length(y) >= 20) & longer))


# Words that stand where an author should, and authors that name no one.
NOT_AUTHORS = ["authors", "author", "about", "archive", "subscribe"]
VAGUE_AUTHORS = ["admin", "administrator", "wordpress", "unknown", "staff", "editor"]


#: What is taken off a name, in order: blanks, bars and commas around it, a leading `by`,
#: blanks again.
NAME_TRIMS = [r"^[ \t\r\n|,]+|[ \t\r\n|,]+$", r"(?i)^(?:words\s+by|by|author)\s+", r"^ +| +$"]
LONGEST_NAME = 120


def clean_author(name: Column) -> Column:
    """The name without NAME_TRIMS, its blanks single; null for no name."""
    bare = functools.reduce(lambda x, trim: F.regexp_replace(x, trim, ""), NAME_TRIMS, F.regexp_replace(name, r"(?U)\s+", " "))
    return F.when((bare != "") & ~F.lower(bare).isin(NOT_AUTHORS) & (F.length(bare) <= LONGEST_NAME), bare)


def is_low_quality_author(name: Column) -> Column:
    low = F.lower(clean_author(name))
    return low.isNull() | low.isin(VAGUE_AUTHORS) | low.contains("admin")


#: A candidate with its width or density; it ends there, so commas in its url survive.
SRCSET_PART = r"(\S+)\s+(\d+)[wx](?=\s*,|\s*$)"


def srcset_urls(srcset: str | None) -> list[str]:
    """Urls of srcset_candidates for one value, inside a function of a whole page."""
    named = [(int(w), u.lstrip(",")) for u, w in re.findall(SRCSET_PART, (srcset or "").strip())]
    found = named or [(0, p.split()[0]) for p in (srcset or "").split(",") if p.strip()]
    return [u for _, u in sorted(found, key=lambda x: -x[0])]


def srcset_candidates(srcset: Column) -> Column:
    """Array of (width, url), widest first, ties in order. Parts end at a width or density,
    so that commas in urls survive; without any, at commas, with width 0."""
    text = F.regexp_replace(F.coalesce(srcset, F.lit("")), r"^\s+|\s+$", "")
    pattern = F.lit(SRCSET_PART)
    named = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda u, w: F.struct(F.coalesce(w.try_cast("int"), F.lit(0)).alias("width"), F.regexp_replace(u, "^,+", "").alias("url")))
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    plain = F.transform(parts, lambda p: F.struct(F.coalesce(F.regexp_extract(p, r"^\S+\s+(\d+)w(?:\s|$)", 1).try_cast("int"), F.lit(0)).alias("width"), F.regexp_extract(p, r"^\S+", 0).alias("url")))
    keyed = F.transform(F.when(F.size(named) > 0, named).otherwise(plain), lambda x, i: F.struct((-x["width"]).alias("away"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


# Language names and their codes.
LANGUAGES = {
    "afrikaans": "af", "arabic": "ar", "chinese": "zh", "chinese simplified": "zh-cn", "chinese traditional": "zh-tw", "dutch": "nl", "english": "en", "french": "fr", "german": "de", "greek": "el", "hebrew": "he", "hindi": "hi",
    "indonesian": "id", "italian": "it", "japanese": "ja", "korean": "ko", "polish": "pl", "portuguese": "pt", "russian": "ru", "spanish": "es", "swedish": "sv", "turkish": "tr", "ukrainian": "uk", "vietnamese": "vi",
}


def language_key(lang: Column) -> Column:
    """A language's code without region; `auto` and '' stay; null gives ''."""
    low = F.replace(F.lower(F.trim(F.coalesce(lang, F.lit("")))), F.lit("_"), F.lit("-"))
    codes = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.substring_index(F.coalesce(F.try_element_at(codes, low), low), "-", 1)


def languages_match(a: Column, b: Column) -> Column:
    x, y = language_key(a), language_key(b)
    return (x != "") & (y != "") & (x != "auto") & (x == y)


def format_saved_at(value: Column) -> Column:
    """An ISO time as `yyyy-MM-dd HH:mm UTC`; a time without zone is UTC; other text is
    returned trimmed. The session's time zone must be UTC."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    when = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), raw.try_cast("timestamp"))
    return F.when(raw == "", "").otherwise(F.coalesce(F.concat(F.date_format(when, "yyyy-MM-dd HH:mm"), F.lit(" UTC")), raw))


def escaped(text: Column, quotes: bool = True) -> Column:
    """Text for HTML."""
    out = text
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def meta_block(url: Column, author: Column, date: Column, site: Column, host: Column, archive_url: Column | None = None) -> Column:
    """The block above an article: its source, then author and date where known, then the
    archived copy."""
    known = lambda c: F.when(F.coalesce(c, F.lit("")).isin("", "Unknown"), None).otherwise(c)
    label = F.coalesce(known(site), known(host), F.lit("Source"))
    source = F.concat(F.lit('<p><strong>Source:</strong> <a href="'), escaped(url), F.lit('">'), escaped(label), F.lit("</a></p>"))
    detail = F.concat_ws(" | ", F.concat(F.lit("<strong>Author:</strong> "), escaped(known(author))), F.concat(F.lit("<strong>Date:</strong> "), escaped(known(date))))
    rows = [source, F.when(detail != "", F.concat(F.lit("<p>"), detail, F.lit("</p>"))).otherwise("")]
    if archive_url is not None:
        rows.append(F.coalesce(F.concat(F.lit('<p class="archive-notice">Archived: <a href="'), escaped(archive_url), F.lit('">Wayback snapshot</a></p>')), F.lit("")))
    return F.concat(F.lit('<div class="post-meta">'), *rows, F.lit("</div>"))


def article_wrapper(title: Column, body: Column, meta: Column, lang: Column) -> Column:
    """A whole XHTML page of a title, a meta block and a body."""
    t = escaped(F.when(F.coalesce(title, F.lit("")) == "", "Untitled").otherwise(title))
    code = escaped(F.when(F.coalesce(lang, F.lit("")) == "", "en").otherwise(lang))
    empty = F.lit("")
    return F.concat(
        F.lit('<!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml" lang="'), code, F.lit('"><head><title>'), t, F.lit('</title><link rel="stylesheet" href="style/default.css"/></head><body><h1>'), t, F.lit("</h1>"),
        F.coalesce(meta, empty), F.coalesce(body, empty), F.lit("</body></html>"),
    )


# Alt texts that say nothing; endings of image files.
GENERIC_ALTS = ["image", "photo", "picture", "pic", "screenshot", "screen shot", "graphic", "thumbnail", "logo", "avatar", "untitled", "img"]
IMAGE_ENDINGS = ["jpg", "jpeg", "png", "gif", "webp", "svg", "avif", "bmp", "tif", "tiff"]


def is_low_value_alt(alt: Column) -> Column:
    """Empty, generic, a url, a file's or camera's name, or a long hexadecimal number."""
    low = F.lower(compact_text(alt))
    name = F.regexp_extract(F.regexp_replace(low, r"[?#].*$", ""), r"([^/]*)$", 1)
    return (
        (low == "") | low.isin(GENERIC_ALTS) | low.rlike(r"^(www\.|//|[a-z][a-z0-9+.\-]*:)") | name.rlike(rf".\.({'|'.join(IMAGE_ENDINGS)})$")
        | low.rlike(r"^(img|image|photo|picture|screenshot|wp|dsc|dscn|pxl|imgp)[-_ ]?\d+.*$") | low.rlike("^[a-f0-9]{12,}$")
    )
