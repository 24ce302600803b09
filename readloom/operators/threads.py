"""Comment threads: flat tables in, navigable and rendered threads out."""

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions import text, urls
from readloom.functions.helpers import long_rows, per_row
from readloom.functions.tables import stored

COMMENT = T.ArrayType(T.StructType([T.StructField(k, T.IntegerType() if k == "pos" else T.StringType()) for k in ("id", "parent_id", "pos", "author", "text", "ts")]))


def _reddit(payload: str | None) -> list[dict]:
    """Nested listing of t1 things, walked without recursion."""
    import html

    try:
        top = json.loads(payload or "null")
    except ValueError:
        return []
    out, stack = [], []

    def push(listing, parent):
        if isinstance(listing, list):
            for x in reversed(listing):
                push(x, parent)
            return
        found = ((listing or {}).get("data") or {}).get("children") or [] if isinstance(listing, dict) else []
        kids = [c for c in found if isinstance(c, dict) and c.get("kind") == "t1"]
        stack.extend((pos, c.get("data") or {}, parent) for pos, c in reversed(list(enumerate(kids))))

    push(top, None)
    while stack:
        pos, c, parent = stack.pop()
        name, body = c.get("author"), c.get("body_html")
        out.append({"id": str(c.get("id")), "parent_id": parent, "pos": pos, "author": f"u/{name}" if name else "[deleted]", "text": html.unescape(body) if body else "<p>[deleted]</p>", "ts": str(c["created_utc"]) if c.get("created_utc") is not None else None})
        push(c.get("replies"), str(c.get("id")))
    return out


def _newsletter(payload: str | None) -> list[dict]:
    try:
        top = json.loads(payload or "null")
    except ValueError:
        return []
    roots = (top.get("comments") if isinstance(top, dict) else top) or []
    out, stack = [], [(p, c, None) for p, c in reversed(list(enumerate(roots)))]
    while stack:
        pos, c, parent = stack.pop()
        if not isinstance(c, dict):
            continue
        out.append({"id": str(c.get("id")), "parent_id": parent, "pos": pos, "author": c.get("name") or "Anonymous", "text": c.get("body") or "", "ts": c.get("date")})
        stack.extend((p, k, str(c.get("id"))) for p, k in reversed(list(enumerate(c.get("children") or []))))
    return out


def flatten_comments(payloads: DataFrame, site: str) -> DataFrame:
    """(thread_id, id, parent_id, pos, author, text, ts) of payloads (thread_id, payload):
    `reddit` and `substack` nest without bound and are walked in Python; `youtube` payloads
    are flat arrays whose reply ids are `root.reply`."""
    if site == "youtube":
        kind = "array<struct<cid:string,author:string,text:string,time:string>>"
        rows = payloads.select("thread_id", F.posexplode(F.from_json("payload", kind)).alias("pos", "c"))
        parent = F.when(F.col("c.cid").contains("."), F.substring_index("c.cid", ".", 1))
        return rows.select("thread_id", F.col("c.cid").alias("id"), parent.alias("parent_id"), "pos", F.coalesce("c.author", F.lit("Anonymous")).alias("author"), F.coalesce("c.text", F.lit("")).alias("text"), F.col("c.time").alias("ts"))
    walk = {"reddit": _reddit, "substack": _newsletter}[site]
    return long_rows(payloads).select("thread_id", F.explode(per_row(walk, COMMENT, F.col("payload"))).alias("c")).select("thread_id", "c.*")


_NODE = ["thread_id", "id"]
_FOREST = ["thread_id", "id", "parent_id", "pos", "depth", "path", "by", "text", "time"]


def _doubled_paths(tops: DataFrame, nodes: DataFrame, max_depth: int | None) -> DataFrame:
    """(thread_id, id, parent_id, path) of tops (path) and of the nodes (parent_id, pos) below
    them, each of which has one parent: every round doubles the length of the paths known, so
    a tree of depth d takes log2(d) rounds. Nodes of a loop never reach a top; when a round
    brings none there, only such are left."""
    reached = stored(tops.select(*_NODE, F.lit(None).cast(nodes.schema["parent_id"].dataType).alias("parent_id"), "path"))
    open_ = stored(nodes.select(*_NODE, "parent_id", F.col("parent_id").alias("up"), F.array("pos").alias("path")))
    size = 1
    while max_depth is None or size < max_depth:
        # what an open node stands on: a node that has reached a top, or another open one
        above = reached.select("thread_id", F.col("id").alias("up"), F.lit(None).cast(nodes.schema["parent_id"].dataType).alias("next"), F.col("path").alias("before"), F.lit(True).alias("done"))
        above = above.union(open_.select("thread_id", F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"), F.lit(False).alias("done")))
        step = stored(open_.join(above, ["thread_id", "up"]).select(*_NODE, "parent_id", F.col("next").alias("up"), F.concat("before", "path").alias("path"), "done"))
        new = step.where("done").select(*_NODE, "parent_id", "path")
        if new.isEmpty():
            break
        reached = reached.union(new)
        open_ = step.where(~F.col("done")).drop("done")
        size *= 2
    return reached


def _by_levels(live: DataFrame, tops: DataFrame, max_depth: int | None) -> DataFrame:
    """(thread_id, id, parent_id, path) by one equi-join a level, for threads in which an item
    hangs below several: each id once, at its first level, then its first parent in order."""
    level = tops.join(live.select(*_NODE, "kids"), _NODE).select(*_NODE, F.lit(None).cast("long").alias("parent_id"), "path", "kids")
    seen, depth = None, 0
    while max_depth is None or depth < max_depth:
        level = stored(level)
        if level.isEmpty():
            break
        seen = level if seen is None else seen.union(level)
        child = level.select("thread_id", F.col("id").alias("parent_id"), "path", F.posexplode("kids").alias("pos", "id"))
        once = F.row_number().over(Window.partitionBy(*_NODE).orderBy(F.concat("path", F.array("pos"))))
        new = child.withColumn("k", once).where("k = 1").join(seen.select(_NODE), _NODE, "left_anti")
        depth += 1
        level = new.join(live.select(*_NODE, "kids"), _NODE).select(*_NODE, "parent_id", F.concat("path", F.array("pos")).alias("path"), "kids")
    return (level.limit(0) if seen is None else seen).drop("kids")


def build_comment_forest(items: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(thread_id, id, parent_id, pos, depth, path, by, text, time): a walk over items
    (thread_id, id, by, text, time, kids, deleted, dead) from roots (thread_id, id). A
    deleted, dead or missing item drops what hangs below it. Each id comes once, at its
    first level (then its first parent in path order). depth counts from 0 and stays below
    max_depth. Roots are ordered by time (missing 0), then id; children as their parent
    lists them.

    Threads in which each item has one parent at most, as comments have, find their paths by
    pointer doubling; only those that share items or hang a root below another item are
    walked level by level. Texts join in once, at the end."""
    live = items.where(~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False))).select("thread_id", "id", "by", "text", "time", "kids")
    live = stored(live.withColumn("k", F.row_number().over(Window.partitionBy(*_NODE).orderBy("time"))).where("k = 1").drop("k"))
    order = Window.partitionBy("thread_id").orderBy(F.coalesce("time", F.lit(0)), "id")
    tops = live.select(*_NODE, "time").join(roots.select(_NODE).distinct(), _NODE).withColumn("pos", F.row_number().over(order) - 1)
    tops = stored(tops.select(*_NODE, F.array("pos").alias("path")))
    edges = live.select("thread_id", F.col("id").alias("parent_id"), F.posexplode("kids").alias("pos", "id"))
    parents = edges.groupBy(_NODE).agg(F.min(F.struct("parent_id", "pos")).alias("first"), F.max("parent_id").alias("last"))
    parents = stored(parents.join(live.select(_NODE), _NODE, "left_semi"))
    shared = parents.where(F.col("first.parent_id") != F.col("last")).select("thread_id").union(parents.join(tops, _NODE, "left_semi").select("thread_id"))
    shared = stored(shared.distinct())
    plain = lambda df: df.join(shared, "thread_id", "left_anti")
    some = None
    if max_depth is None or max_depth > 0:
        some = _doubled_paths(plain(tops), plain(parents).select(*_NODE, "first.*"), max_depth)
        if not shared.isEmpty():
            some = some.unionByName(_by_levels(live.join(shared, "thread_id", "left_semi"), tops.join(shared, "thread_id", "left_semi"), max_depth))
    else:
        some = _doubled_paths(tops.limit(0), parents.limit(0).select(*_NODE, "first.*"), 0)
    deep = some.withColumns({"pos": F.element_at("path", -1), "depth": F.size("path") - 1})
    if max_depth is not None:
        deep = deep.where(F.col("depth") < max_depth)
    return deep.join(live.drop("kids"), _NODE).select(_FOREST)


def comment_navigation(forest: DataFrame) -> DataFrame:
    """forest with root_id, next_sibling_id and next_root_id. Roots have only a
    next_root_id; their parent, root and sibling are null."""
    siblings = Window.partitionBy("thread_id", "parent_id").orderBy("pos")
    roots = forest.where("parent_id IS NULL").select("thread_id", F.get("path", 0).alias("root_pos"), F.col("id").alias("root"), F.lead("id").over(siblings).alias("next_root_id"))
    # a thread's roots and its replies meet on the root's place
    named = forest.withColumn("root_pos", F.get("path", 0)).withColumn("next", F.when(F.col("parent_id").isNotNull(), F.lead("id").over(Window.partitionBy("thread_id", "parent_id").orderBy("pos"))))
    child = F.col("parent_id").isNotNull()
    return named.join(roots, ["thread_id", "root_pos"], "left").withColumns({"root_id": F.when(child, F.col("root")), "next_sibling_id": F.col("next")}).drop("root_pos", "root", "next")


def render_threads(forest: DataFrame) -> DataFrame:
    """(thread_id, root_pos, html): depth-first html of each root, from comment_navigation.
    Comments are indented by 10 px a level, 50 at most, with 2 px of padding from level 6;
    the root's link shows below level 1."""
    link = lambda to, label: F.coalesce(F.concat(F.lit('<a href="#c_'), to.cast("string"), F.lit(f'">{label}</a>')), F.lit(""))
    indent = F.concat(F.lit("margin-left:"), (F.least("depth", F.lit(5)) * 10).cast("string"), F.lit("px"), F.when(F.col("depth") >= 6, ";padding-left:2px").otherwise(""))
    buttons = F.concat(link(F.col("parent_id"), "parent"), F.when(F.col("depth") > 1, link(F.col("root_id"), "root")).otherwise(""), link(F.col("next_sibling_id"), "next"), link(F.col("next_root_id"), "next thread"))
    opened = F.concat(F.lit('<div class="comment" id="c_'), F.col("id").cast("string"), F.lit('" style="'), indent, F.lit('"><p class="who">'), text.escaped(F.coalesce("by", F.lit("[deleted]"))), F.lit("</p>"), buttons, F.coalesce("text", F.lit("")))
    tree = Window.partitionBy("thread_id", F.get("path", 0)).orderBy("path")
    # what is open below the next comment's level closes here
    closes = F.col("depth") - F.coalesce(F.lead("depth").over(tree), F.lit(0)) + 1
    lines = forest.select("thread_id", F.get("path", 0).alias("root_pos"), "path", F.concat(opened, F.repeat(F.lit("</div>"), closes.cast("int"))).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "")
    return lines.groupBy("thread_id", "root_pos").agg(F.concat(F.lit('<div class="thread">'), body, F.lit("</div>")).alias("html"))


def top_roots_with_replies(comments: DataFrame, limit: int = 25) -> DataFrame:
    """The first `limit` roots among each video's first 20 * limit rows, and the replies
    there that come after their kept root. A reply's id holds a dot; a reply (parent_id
    set) without one is dropped. The limits are the feature."""
    scan = F.row_number().over(Window.partitionBy("thread_id").orderBy("pos"))
    rows = comments.withColumn("k", scan).where(F.col("k") <= 20 * limit).drop("k")
    root_no = F.row_number().over(Window.partitionBy("thread_id").orderBy("pos"))
    roots = rows.where("parent_id IS NULL").withColumn("k", root_no).where(F.col("k") <= limit).drop("k")
    held = roots.select("thread_id", F.col("id").alias("parent_id"), F.col("pos").alias("root_pos"))
    replies = rows.where("parent_id IS NOT NULL AND contains(id, '.')").join(held, ["thread_id", "parent_id"]).where("pos > root_pos").select(*comments.columns)
    return roots.select(*comments.columns).unionByName(replies)


def merge_linked_articles(stories: DataFrame, books: DataFrame, chapters: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Chapters of each story (story_id, title, url, text): those of the linked article, with
    `linked_` before their file names, else the story's own text; then one of the story's
    comments (story_id, root_pos, html, as from render_threads). Chapters with is_comments
    are the source's comments. (story_id, title, part, chapter_idx, filename, content_html),
    in order of chapter_idx; part: article, source_comments, story_comments."""
    keyed = books.select("book_id", urls.url_match_key(F.col("source_url")).alias("key"))
    one = keyed.where("key != ''").groupBy("key").agg(F.min("book_id").alias("book_id"))
    named = stories.withColumn("key", urls.url_match_key(F.col("url"))).join(one, "key", "left")
    part = F.when(F.col("is_comments"), "source_comments").otherwise("article") if "is_comments" in chapters.columns else F.lit("article")
    linked = named.where("book_id IS NOT NULL").join(chapters, "book_id").select("story_id", named["title"], part.alias("part"), "chapter_idx", F.concat(F.lit("linked_"), "filename").alias("filename"), "content_html")
    own = named.where("book_id IS NULL").select("story_id", "title", F.lit("article").alias("part"), F.lit(0).alias("chapter_idx"), F.lit("article.xhtml").alias("filename"), F.coalesce("text", F.lit("")).alias("content_html"))
    merged = linked.unionByName(own)
    if comments is None:
        return merged
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("root_pos", "html"))), lambda x: x["html"]), "")
    bodies = comments.groupBy("story_id").agg(body.alias("content_html"))
    last = merged.groupBy("story_id").agg(F.max("chapter_idx").alias("last"))
    after = stories.select("story_id", "title").join(bodies, "story_id").join(last, "story_id", "left")
    return merged.unionByName(after.select("story_id", "title", F.lit("story_comments").alias("part"), (F.coalesce("last", F.lit(-1)) + 1).alias("chapter_idx"), F.lit("story_comments.xhtml").alias("filename"), "content_html"))


def linked_toc(merged: DataFrame) -> DataFrame:
    """(story_id, place, label, filename, children) from merge_linked_articles: the article,
    with the source's and the story's comments below it; without an article they stand alone."""
    last = lambda part: F.max_by("filename", F.when(F.col("part") == part, F.col("chapter_idx")))
    heads = merged.groupBy("story_id").agg(last("article").alias("article"), last("source_comments").alias("source"), last("story_comments").alias("story"))
    entry = lambda label, name: F.struct(F.lit(label).alias("label"), F.col(name).alias("filename"))
    below = F.filter(F.array(entry("Source comments", "source"), entry("Story comments", "story")), lambda x: x["filename"].isNotNull())
    rows = heads.withColumn("below", below)
    top = rows.where("article IS NOT NULL").select("story_id", F.lit(0).alias("place"), F.lit("Article").alias("label"), F.col("article").alias("filename"), F.col("below").alias("children"))
    alone = rows.where("article IS NULL").select("story_id", F.posexplode("below").alias("place", "x"), F.slice("below", 1, 0).alias("children"))
    return top.unionByName(alone.select("story_id", "place", "x.label", "x.filename", "children"))
