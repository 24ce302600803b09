"""Forum threads from stored pages."""

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions import text
from readloom.functions.dom import parse
from readloom.functions.helpers import long_rows, per_row


def stitch_forum_threads(pages: DataFrame, posts: DataFrame, page_spec: str | None = None, max_pages: int | None = None, max_posts: int | None = None) -> DataFrame:
    """posts (thread_url, page, pos, ...) of the pages that belong to each thread, in order
    of `spine`. pages: thread_url, page, seq, html, final_url; the first html of a page
    number counts, blank ones do not. With a page spec exactly those pages are taken; else
    1, 2, 3 ... up to a gap, max_pages, or a page whose final url came before. A thread
    without page 1 is none. At most max_posts posts stay across pages; limits are the
    feature."""
    filled = pages.where(F.trim(F.coalesce("html", F.lit(""))) != "").drop("html")
    first = F.row_number().over(Window.partitionBy("thread_url", "page").orderBy("seq"))
    one = filled.withColumn("k", first).where("k = 1").drop("k")
    if page_spec:
        wanted = F.lit(page_spec)
        kept = one.withColumn("turn", F.array_position(text.page_spec(wanted), F.col("page"))).where(F.coalesce(F.col("turn"), F.lit(0)) > 0)
    else:
        in_order = Window.partitionBy("thread_url").orderBy("page")
        numbered = one.where("page >= 1").withColumn("turn", F.row_number().over(in_order).cast("long"))
        repeat = F.row_number().over(Window.partitionBy("thread_url", "final_url").orderBy("page"))
        flagged = numbered.withColumn("again", (F.col("final_url").isNotNull() & (repeat > 1)).cast("int"))
        stop = F.max(F.greatest("again", (F.col("page") != F.col("turn")).cast("int"))).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
        kept = flagged.withColumn("stop", stop).where("stop = 0").drop("again", "stop")
        if max_pages is not None:
            kept = kept.where(F.col("turn") <= max_pages)
    out = posts.join(kept.select("thread_url", "page", "turn"), ["thread_url", "page"])
    out = out.withColumn("spine", F.row_number().over(Window.partitionBy("thread_url").orderBy("turn", "pos"))).drop("turn")
    return out if max_posts is None else out.where(F.col("spine") <= max_posts)


QUOTE = re.compile(r"sourceJump|AttributionLink", re.I)


def _targets(html: str | None) -> list[str]:
    """Keys that the quote links of a post point at."""
    out = []
    for a in parse(html).find_all("a"):
        if QUOTE.search(f"{a.attrs.get('class', '')} {a.attrs.get('data-xf-click', '')}"):
            out += _keys(a.attrs)
    return out


def _keys(attrs: dict) -> list[str]:
    target = attrs.get("href", "").rsplit("#", 1)[-1] if "#" in attrs.get("href", "") else attrs.get("data-content-selector", "").lstrip("#")
    number = re.search(r"\d+", target)
    return [k for k in (target, number[0] if number else "") if k]


def _rewritten(html: str | None, anchors: dict | None) -> str | None:
    if html is None:
        return None
    root, known = parse(html), dict(anchors or {})
    for a in root.find_all("a"):
        if QUOTE.search(f"{a.attrs.get('class', '')} {a.attrs.get('data-xf-click', '')}"):
            hit = next((known[k] for k in _keys(a.attrs) if k in known), None)
            if hit:
                a.attrs = {k: v for k, v in a.attrs.items() if k not in ("data-xf-click", "data-content-selector", "rel", "target")} | {"href": f"#p_{hit}"}
    return root.html()


def rewrite_quote_links(posts: DataFrame) -> DataFrame:
    """posts with links to quoted posts of the same thread turned to `#p_{anchor}`. A post
    is known by its id, its number and `post-` with its number; the first one wins. Other
    links stay."""
    names = F.array_distinct(F.filter(F.array("id", "numeric_id", F.concat(F.lit("post-"), "numeric_id")), lambda k: k.isNotNull()))
    known = posts.select("thread_url", "spine", "anchor_id", F.explode(names).alias("key")).groupBy("thread_url", "key").agg(F.min_by("anchor_id", "spine").alias("anchor"))
    wanted = long_rows(posts).select("thread_url", "spine", F.explode(F.array_distinct(per_row(_targets, T.ArrayType(T.StringType()), F.col("html")))).alias("key"))
    found = wanted.join(known, ["thread_url", "key"]).groupBy("thread_url", "spine").agg(F.map_from_entries(F.collect_list(F.struct("key", "anchor"))).alias("anchors"))
    joined = posts.join(found, ["thread_url", "spine"], "left")
    kind = T.StringType()
    pairs = F.map_entries("anchors")
    fn = lambda html, entries: _rewritten(html, {e["key"]: e["value"] for e in entries or []})
    return joined.withColumn("html", F.when(F.col("anchors").isNull(), F.col("html")).otherwise(per_row(fn, kind, F.col("html"), pairs))).drop("anchors")
