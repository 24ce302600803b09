"""Cleaning of chapters' html: one Python helper per job, rows stay where they are."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.dom import Node, parse
from readloom.functions.helpers import long_rows, per_row
from readloom.functions.outline import HEADINGS, Outline, drop_widgets
from readloom.functions.text import GENERIC_ALTS, IMAGE_ENDINGS, TITLE_SEPARATORS

from .pagefacts import compact

# Class and id parts of what is not the article, words of footers, what a
# cluster of links begins with or is named by.
NAVIGATION = ["nav", "menu", "breadcrumb", "pagination", "skip-link"]
SOCIAL = ["share", "social", "related", "recommended", "newsletter-signup", "promo", "sponsor"]
SUBSCRIBE = re.compile(r"\b(?:subscribe|sign up|newsletter)\b", re.I)
FOOTER_WORDS = re.compile(r"\b(?:more from|related|read more|topics?|tags?|filed under|popular|recommended)\b", re.I)
FOOTER_HEADINGS = ("explore more", "more on this", "more from", "related", "read more", "recommended", "topics", "tagged")
FOOTER_NAMES = ["related", "recommend", "topics", "tags", "more"]
# Texts that only offer to share, one or several in a row.
NETWORKS = ["facebook", "twitter", "x", "linkedin", "reddit", "pinterest", "tumblr", "mastodon"]
SHARE_FIRST = ["share(?: this:?)?", f"share on (?:{'|'.join(NETWORKS)})", "tweet", "like this:?", "reblog", "share via email", "pocket", "more", "loading(?:\\.\\.\\.)?", "print", "email"]
SHARE_NEXT = ["share", "tweet", "print", "email", "loading(?:\\.\\.\\.)?", "reblog", "pocket", "more", f"share on (?:{'|'.join(NETWORKS)})"]
SHARE = re.compile(f"(?:{'|'.join(SHARE_FIRST)})(?: (?:{'|'.join(SHARE_NEXT)}))*", re.I)
SHARE_TAGS, SHARE_CHARS = frozenset("p div span li a button".split()), 140
# Widgets and headings of publishers, and where pictures of authors stand.
PUBLISHER_WIDGETS = [("data-cy", "author-image"), ("class", "author-avatar"), ("data-cy", "player"), ("data-testid", "player"), ("data-testid", "video"), ("class", "video-player")]
PUBLISHER_HEADINGS = HEADINGS + "|most read|most popular|latest stories?|top stories?"
AUTHOR_BOXES = [("data-testid", "author"), ("data-testid", "byline"), ("data-qa", "author"), ("data-qa", "byline"), ("class", "byline")]
# Classes of headers, titles and lines about an article, beginnings of such
# lines, and their longest length.
HEADERS, TITLES = frozenset(["entry-header", "post-header"]), frozenset(["entry-title", "post-title"])
METAS = frozenset(["entry-meta", "post-meta", "posted-on", "byline", "post-date", "post-author"])
LINES = ("posted on ", "published on ", "posted by ", "publié ", "publie ", "publicado ", "veröffentlicht ")
LINE_TAGS, LINE_CHARS = frozenset("p div span".split()), 180
# Classes of captions, and attributes that captions lose.
CAPTIONS = frozenset(["caption", "wp-caption-text", "gallery-caption", "image-caption"])
CAPTION_LOSES = ["style", "align", "width", "height"]

PICTURES = frozenset(["img", "figure", "picture"])
SOLID = frozenset("table blockquote pre code".split())
BLOCKS = frozenset("div section ul ol aside p header footer".split())
INLINE = frozenset("b strong em i span".split())


def _plain_title(text: str | None) -> str:
    return compact(re.sub("[“”\"'‘’]", "", compact(text).casefold()))


def same_title(a: str | None, b: str | None) -> bool:
    a, b = _plain_title(a), _plain_title(b)
    return bool(a and b) and (a == b or (min(len(a), len(b)) >= 20 and any(b.startswith(a + s) or a.startswith(b + s) for s in TITLE_SEPARATORS)))


def _drop_side_blocks(table: Outline) -> None:
    """Navigation, social and subscription blocks that are short without their links, and
    clusters where links are most of the text."""
    for i, n in enumerate(table.nodes):
        if n.tag == "nav":
            table.drop(i)
    for i, n in enumerate(table.nodes):
        if n.tag not in BLOCKS or not table.here[i]:
            continue
        size, mark = table.left(i), f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()
        anchors = [j for j in range(i + 1, table.end[i]) if table.here[j] and table.nodes[j].tag == "a"]
        linked = sum(map(table.left, anchors))
        if size - linked <= 360:
            named = not set(NAVIGATION).isdisjoint(re.split(r"[\s_-]+", mark)) or any(x in mark for x in SOCIAL)
            asks = size <= 360 and ("subscribe" in mark or "newsletter" in mark or table.holds(i, ("form",))) and SUBSCRIBE.search(table.words(i))
            if named or asks:
                table.drop(i)
                continue
        if len(anchors) >= 3 and 0 < size <= 900 and linked / size >= 0.65 and not table.holds(i, SOLID):
            words = table.words(i)
            if "footer" in mark or n.tag == "footer" or FOOTER_WORDS.search(words) or words.casefold().startswith(FOOTER_HEADINGS) or any(x in mark for x in FOOTER_NAMES):
                table.drop(i)


def _drop_widgets(table: Outline) -> None:
    """Offers to share, publishers' widgets, and pictures of authors."""
    for i, n in enumerate(table.nodes):
        if n.tag in SHARE_TAGS and table.here[i] and 0 < table.left(i) <= SHARE_CHARS and not table.holds(i, PICTURES | SOLID) and SHARE.fullmatch(table.words(i)):
            table.drop(i)
        elif n.tag == "img" and any(part in table.nodes[j].attrs.get(name, "").lower() for j in table.over(i) for name, part in AUTHOR_BOXES):
            table.drop(i)
    drop_widgets(table, PUBLISHER_WIDGETS, PUBLISHER_HEADINGS, PICTURES | SOLID)


def _drop_titles(table: Outline, title: str | None) -> None:
    """What repeats a chapter's title below its first h1, and lines that tell author and day;
    a header with pictures loses its words alone. Without a title nothing goes."""
    plain = _plain_title(title)
    if not plain:
        return
    nodes = table.nodes
    body = next((i for i, n in enumerate(nodes) if n.tag == "body"), 0)
    below = range(body + 1, table.end[body])
    own = next((i for i in below if table.here[i] and nodes[i].tag == "h1"), 0)
    kinds = {i: set(nodes[i].classes()) for i in below}
    for i in below:
        if table.here[i] and (kinds[i] & HEADERS or (nodes[i].tag == "header" and any(nodes[j].tag == "article" for j in table.over(i)))):
            inside = [j for j in range(i + 1, table.end[i]) if table.here[j]]
            head = next((j for j in inside if nodes[j].tag in ("h1", "h2", "h3")), i)
            said = table.words(head)
            if same_title(said, title) or _plain_title(said).startswith(plain):
                for j in [head, *(j for j in inside if kinds[j] & METAS)] if table.holds(i, PICTURES) else [i]:
                    if j != i or not table.holds(i, PICTURES):
                        table.drop(j)
    for i in below:
        if not table.here[i]:
            continue
        tag, size = nodes[i].tag, table.left(i)
        repeats = i != own and (tag in ("h1", "h2", "h3") or kinds[i] & TITLES) and same_title(table.words(i), title)
        about = kinds[i] & METAS and not (table.up[i] == body and "post-meta" in kinds[i])  # but for a chapter's own
        line = tag in LINE_TAGS and 0 < size <= LINE_CHARS and not table.holds(i, PICTURES | SOLID) and table.words(i).casefold().startswith(LINES)
        if repeats or about or line:
            table.drop(i)


def _drop_twins(table: Outline) -> None:
    """Paragraphs beside a figure's caption that say the same."""
    for i, n in enumerate(table.nodes):
        if n.tag == "figcaption" and table.here[i] and (said := table.words(i)):
            over = table.up[i]
            for j in range(over + 1, table.end[over]):
                if table.nodes[j].tag in ("p", "span") and table.here[j] and not j <= i < table.end[j] and not i < j < table.end[i] and table.left(j) == len(said) and table.words(j) == said:
                    table.drop(j)


def _even_captions(root: Node) -> None:
    """Captions as paragraphs of class image-caption with their text alone; empty ones go,
    and captions above a picture are plain blocks."""
    for n in list(root.elements()):
        names = n.classes()
        if n.tag != "figcaption" and CAPTIONS.isdisjoint(names):
            continue
        others = [c for c in names if c not in CAPTIONS]
        said = compact(n.text())
        if any("upper-caption" in c for c in names):
            n.tag = "div" if n.tag == "figcaption" else n.tag
        elif not said:
            n.remove()
            continue
        else:
            n.tag = "p" if n.tag == "figcaption" else n.tag
            others.insert(0, "image-caption")
            n.children = []
            n.add(Node("#text", data=said))
        n.attrs = {k: v for k, v in n.attrs.items() if k != "class" and k not in CAPTION_LOSES} | ({"class": " ".join(others)} if others else {})


def cleaned(html: str | None, title: str | None) -> str | None:
    """html without navigation, social, related and subscription blocks, topic footers,
    clusters of links, publishers' widgets, repeated titles, lines about author and day, and
    empty inline tags; captions are made even. Blocks that hold the body (over 360 characters
    that are not links) are kept whatever their class says."""
    if html is None:
        return None
    root = parse(html)
    table = Outline(root)
    _drop_side_blocks(table)
    _drop_widgets(table)
    _drop_titles(table, title)
    _drop_twins(table)
    table.cut()
    _even_captions(root)
    rest = Outline(root)
    for i, n in enumerate(rest.nodes):
        if n.tag in INLINE and rest.left(i) == 0 and not rest.holds(i, SOLID | {"img"}):
            rest.drop(i)
    rest.cut()
    return root.html()


def clean_chapters(chapters: DataFrame) -> DataFrame:
    """chapters with content_html cleaned; a null stays null."""
    return long_rows(chapters).withColumn("content_html", per_row(cleaned, T.StringType(), F.col("content_html"), F.col("title")))


def _says_little(alt: str | None) -> bool:
    """functions.text.is_low_value_alt for one value, inside a function of a whole page."""
    low = compact(alt).lower()
    name = re.sub(r"[?#].*$", "", low).rsplit("/", 1)[-1]
    return (
        not low or low in GENERIC_ALTS or bool(re.match(r"(?:www\.|//|[a-z][a-z0-9+.\-]*:)", low)) or bool(re.search(rf".\.(?:{'|'.join(IMAGE_ENDINGS)})$", name))
        or bool(re.fullmatch(r"(?:img|image|photo|picture|screenshot|wp|dsc|dscn|pxl|imgp)[-_ ]?\d+.*", low)) or bool(re.fullmatch("[a-f0-9]{12,}", low))
    )


def without_images(html: str | None) -> str | None:
    """Figures and images replaced by their captions and `[Image: alt]` for alt texts that
    say something that the caption does not; wrappers left empty go."""
    if html is None:
        return None
    root = parse(html)

    def put(node: Node, texts: list[str]) -> None:
        where = node.parent.children
        at = where.index(node)
        new = []
        for t in texts:
            p = Node("p")
            p.add(Node("#text", data=t))
            p.parent = node.parent
            new.append(p)
        where[at : at + 1] = new
        node.parent = None

    def alts(images: list[Node], caption: str) -> list[str]:
        said = dict.fromkeys(compact(i.attrs.get("alt")) for i in images)
        return [f"[Image: {a}]" for a in said if not _says_little(a) and a.casefold() not in caption.casefold()]

    for n in root.find_all("figure", "picture", "img"):
        if not n.attached(root):
            continue
        note = n.first("figcaption, .image-caption") if n.tag == "figure" else None
        caption = compact(note.text()) if note is not None else ""
        put(n, ([caption] if caption else []) + alts([n] if n.tag == "img" else n.find_all("img"), caption))
    for n in reversed(root.find_all("div", "p", "a", "span", "section")):
        if n.attached(root) and not n.text("") and not n.find("table", "pre", "code", "hr"):
            n.remove()
    return root.html()


def text_only(chapters: DataFrame) -> DataFrame:
    return long_rows(chapters).withColumn("content_html", per_row(without_images, T.StringType(), F.col("content_html")))
