"""Translation memory: units, keys, what is missing, batches, results."""

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions import ordered, text
from readloom.functions.dom import Node, parse
from readloom.functions.helpers import long_rows, per_row
from readloom.functions.tables import dropped, stored

from .pagefacts import compact

# Tags that hold units, classes of captions, classes that are never
# translated, and classes of comment bodies.
UNIT_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "li", "figcaption", "div"]
CAPTION_CLASSES = {"image-caption", "image-alt", "caption", "wp-caption-text"}
SKIP_CLASSES = {"post-meta", "comment-header", "forum-post-header", "nav-bar", "nav-btn", "page-label", "translation-skip", "translation", "translation-pair"}
COMMENT_CLASSES = {
    "bbwrapper", "bbcode-body", "comment-body", "comment-body-inner", "comment-content", "comment-copy", "comment-message", "comment-text", "comment__body", "forum-post", "forum-post-body", "message-body", "message-content", "messagecontent",
}
SKIP_ANCESTORS = {"pre", "code", "table"}
BLOCKS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "li", "div"]
HOLDERS = ["img", "picture", "figure", "table", "pre", "code"]
SCOPES = ("article", "article-captions", "all-readable")


def _is_caption(n: Node) -> bool:
    return n.tag == "figcaption" or bool(CAPTION_CLASSES & set(n.classes()))


def unit_nodes(root: Node, scope: str) -> list[Node]:
    """Elements whose text is translated, in document order."""
    out = []
    for n in root.find_all(*UNIT_TAGS):
        line = [n, *n.ancestors()]
        classes = [{c.lower() for c in x.classes()} for x in line]
        if n.tag == "div" and (not classes[0] & COMMENT_CLASSES or n.find(*BLOCKS)):
            continue
        if any(c & SKIP_CLASSES for c in classes) or (scope != "all-readable" and any(c & COMMENT_CLASSES for c in classes)):
            continue
        if scope == "article" and _is_caption(n) or any(x.tag in SKIP_ANCESTORS for x in line[1:]):
            continue
        if n.find(*HOLDERS) or n.tag == "li" and n.find("ul", "ol", "p"):
            continue
        words = compact(n.text())
        if len(words) >= 2 and not re.fullmatch(r"[\W\d_]+", words):
            out.append(n)
    return out


UNIT = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))


def extract_translation_units(chapters: DataFrame, scope: str = "article-captions") -> DataFrame:
    """(book_id, chapter_idx, unit_idx, kind, text) of chapters (content_html, is_article,
    is_comments); comments and chapters that are no articles only for all-readable."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    some = chapters if scope == "all-readable" else chapters.where("is_article AND NOT coalesce(is_comments, false)")
    found = per_row(lambda html: [{"kind": "caption" if _is_caption(n) else "body", "text": compact(n.text())} for n in unit_nodes(parse(html), scope)], UNIT, F.col("content_html"))
    return long_rows(some).select("book_id", "chapter_idx", F.posexplode(found).alias("unit_idx", "u")).select("book_id", "chapter_idx", "unit_idx", "u.*")


def model_name(provider: str, llm: str = "auto", model: str = "", glossary: list[tuple[str, str]] | None = None) -> str:
    """provider:model, or google, with twelve digits of the glossary's hash after it."""
    import hashlib

    name = "google" if provider == "google" else f"{llm}:{model}"
    return f"{name}|glossary:{hashlib.sha256(chr(10).join(f'{a}={b}' for a, b in glossary).encode()).hexdigest()[:12]}" if glossary else name


def translation_key(provider: Column, model: Column, source: Column, target: Column, words: Column) -> Column:
    """sha256 over provider, model, source language or auto, target and compact text."""
    language = F.coalesce(F.nullif(source, F.lit("")), F.lit("auto"))
    return F.sha2(F.concat_ws("\n", provider, F.coalesce(model, F.lit("")), language, target, text.compact_text(words)), 256)


def plan_translation(units: DataFrame, memory: DataFrame, provider: str, model: str, source: str, target: str) -> DataFrame:
    """(first_seen, text, cache_key, translated_text, missing) of each distinct compact text,
    first_seen being its first (book_id, chapter_idx, unit_idx). Same language: the text is
    its own translation. Texts are distinct before they meet the memory, on the key."""
    place = F.struct("book_id", "chapter_idx", "unit_idx")
    texts = units.select(place.alias("place"), text.compact_text(F.col("text")).alias("text")).where("text != ''").groupBy("text").agg(F.min("place").alias("first_seen"))
    keyed = texts.withColumn("cache_key", translation_key(F.lit(provider), F.lit(model), F.lit(source), F.lit(target), F.col("text")))
    same = text.languages_match(F.lit(source), F.lit(target))
    known = memory.select("cache_key", "translated_text")
    done = F.when(same, F.col("text")).otherwise(F.col("translated_text"))
    return keyed.join(known, "cache_key", "left").withColumn("translated_text", done).withColumn("missing", F.col("translated_text").isNull())


def upsert_memory(memory: DataFrame, new: DataFrame) -> DataFrame:
    """memory with new rows in place of old ones of the same key; of several new ones the
    last by created_at."""
    every = memory.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc("batch"), F.desc("created_at"), "translated_text"))
    return every.withColumn("k", last).where("k = 1").drop("k", "batch")


def _bucket(buckets: int) -> Column:
    return F.concat(F.lit(f"of{buckets}_"), F.pmod(F.xxhash64("cache_key"), F.lit(buckets)).cast("string"))


def write_memory(memory: DataFrame, path: str, buckets: int = 64) -> None:
    """memory as a store at path: a folder for each bucket of keys, by hash, whose name tells
    of how many it is one. A store holds a row at least."""
    memory.withColumn("bucket", _bucket(buckets)).repartition(buckets, "bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def upsert_memory_store(spark: SparkSession, path: str, new: DataFrame) -> None:
    """upsert_memory on a store that write_memory wrote. Only buckets that new rows fall into
    are read and written again; the files of the others stay.

    The merged buckets are complete in the shared folder before they replace the old ones;
    run it again after a failure, as an upsert may be repeated. One such job may run on a
    store at a time."""
    some = spark.read.parquet(path).select("bucket").first()
    buckets = int(some[0][2:].partition("_")[0])
    coming = stored(new.withColumn("bucket", _bucket(buckets)))
    touched = [r[0] for r in coming.select("bucket").distinct().collect()]  # as many as buckets
    if not touched:
        return
    old = spark.read.schema(T.StructType([*new.schema, T.StructField("bucket", T.StringType())])).parquet(path).where(F.col("bucket").isin(touched))
    merged = stored(upsert_memory(old.drop("bucket"), coming.drop("bucket")).withColumn("bucket", _bucket(buckets)))
    merged.repartition(buckets, "bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    dropped(coming, merged)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


class Packing:
    """Cuts texts into batches, greedily: one closes at `most` texts or where the next would
    pass `chars`. The state is the open batch's texts and characters."""

    columns = ["size"]

    def __init__(self, most: int, chars: int):
        self.most, self.chars = most, chars

    def _next(self, size: np.ndarray) -> np.ndarray:
        """Where the batch that starts at each text ends: found in the running sums."""
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(len(size))
        full = np.searchsorted(total, total[:-1] + self.chars, side="right") - 1
        return np.minimum(at + self.most, np.maximum(full, at + 1))

    def _first(self, state: tuple[int, int], size: np.ndarray) -> int:
        """The first text that does not fit an open batch; len(size) if all fit."""
        n, held = state
        return min(max(self.most - n, 0), int(np.searchsorted(np.cumsum(size), self.chars - held, side="right")))

    def run(self, state: tuple[int, int] | None, size: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
        begins, after = np.zeros(len(size), bool), self._next(size)
        i, start = (0, None) if state is None else (self._first(state, size), state)
        while i < len(size):
            begins[i], start, last = True, None, i
            i = int(after[i])
        if start is not None:  # no batch began
            return begins, (start[0] + len(size), start[1] + int(size.sum()))
        return begins, (len(size) - last, int(size[last:].sum()))

    def summary(self, size: np.ndarray) -> tuple:
        """Sizes of the first texts, one of which begins the part's first batch; for each, the
        state and the batches if it does; and what is added if none does. As a batch has
        `most` texts at most, so has the summary."""
        head, after = size[: self.most], self._next(size)
        known: dict[int, tuple[tuple[int, int], int]] = {}
        for first in range(len(head)):
            path = [first]
            while (i := int(after[path[-1]])) < len(size) and i not in known:
                path.append(i)
            end = known[i] if i < len(size) else ((len(size) - path[-1], int(size[path[-1] :].sum())), 0)
            for k, p in enumerate(reversed(path)):
                known[p] = (end[0], end[1] + k + 1)
        return head, [known[i] for i in range(len(head))], len(size), int(size.sum())

    def after(self, state: tuple[int, int] | None, summary: tuple) -> tuple[tuple[int, int], int]:
        head, ends, n, total = summary
        first = 0 if state is None else self._first(state, head)
        return ends[first] if first < len(head) else ((state[0] + n, state[1] + total), 0)


def _by_place(missing: DataFrame, bucket: Column) -> DataFrame:
    """missing dealt in order of bucket, book, chapter and unit."""
    at = F.col("first_seen")
    rows = missing.withColumns({"key": bucket.cast("string"), "size": F.coalesce(F.length("text"), F.lit(0)).cast("long"), "book": at["book_id"], "chapter": at["chapter_idx"], "unit": at["unit_idx"]})
    return ordered.dealt(rows, ["book", "chapter", "unit"])


def batch_texts(missing: DataFrame, most: int = 20, chars: int = 9000, buckets: int = 1, bucket: Column | None = None) -> DataFrame:
    """(bucket, text, batch) of missing (first_seen, text): in order, a batch closes at `most`
    texts or where the next would pass `chars`; a longer text is a batch of its own. Texts
    are dealt to `buckets` by hash, or by `bucket`, a bigint expression over missing; each
    is batched by itself. Buckets of any size are cut by many tasks: parts of a bucket sum
    up where its batches end for any batch that is open before them."""
    of = F.pmod(F.xxhash64("text"), F.lit(buckets)) if bucket is None else bucket.cast("long")
    cut = ordered.grouped(_by_place(missing.select("first_seen", "text"), F.coalesce(of, F.lit(0))).select("key", "part", "at", "size", "text"), Packing(most, chars))
    return cut.select(F.col("key").cast("long").alias("bucket"), "text", F.col("group").alias("batch"))


def chunk_texts(missing: DataFrame, size: int = 5) -> DataFrame:
    """missing with batch: fixed numbers of texts, in order of first_seen."""
    placed = ordered.numbered(_by_place(missing, F.lit("")))
    return placed.select(*missing.columns, F.floor(F.col("place") / size).alias("batch"))


def parse_glossary(raw: str | None) -> list[tuple[str, str]]:
    """Terms of a JSON object or of lines `a=b`, `a<tab>b`, `a`; # starts a comment. The
    longest source first, each source once."""
    import json

    pairs: list[tuple[str, str]] = []
    try:
        data = json.loads(raw or "")
        items = data.items() if isinstance(data, dict) else [(x.get("source"), x.get("target")) if isinstance(x, dict) else (x, x) for x in data]
        pairs = [(str(a or "").strip(), str(b or a or "").strip()) for a, b in items]
    except (ValueError, AttributeError, TypeError):
        for line in (raw or "").splitlines():
            line = line.strip()
            if line and not line.startswith("#"):
                a, _, b = line.partition("=" if "=" in line else "\t")
                pairs.append((a.strip(), b.strip() or a.strip()))
    out: dict[str, str] = {}
    for a, b in sorted((p for p in pairs if p[0]), key=lambda p: -len(p[0])):
        out.setdefault(a, b)
    return list(out.items())


def protect_terms(words: Column, terms: list[tuple[str, str]]) -> Column:
    """Terms replaced by placeholders."""
    for i, (source, _) in enumerate(terms):
        words = F.replace(words, F.lit(source), F.lit(f"__TERM_{i}__"))
    return words


def restore_terms(words: Column, terms: list[tuple[str, str]]) -> Column:
    for i, (_, target) in enumerate(terms):
        words = F.replace(words, F.lit(f"__TERM_{i}__"), F.lit(target))
    return words


def _halved(texts: list[str], fn: Callable[[list[str]], list[str]]) -> list[str]:
    """fn of texts; once more on failure, then of each half, down to single texts."""
    for attempt in (1, 2):
        try:
            got = fn(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} translations of {len(texts)} texts")
            return list(got)
        except Exception:
            if attempt == 2 and len(texts) == 1:
                raise
    half = len(texts) // 2
    return _halved(texts[:half], fn) + _halved(texts[half:], fn)


def translate_missing(batches: DataFrame, fn: Callable[[list[str]], list[str]], at_once: int = 3) -> DataFrame:
    """(text, translated_text) of batches (bucket, batch, text) by a caller's function, with at
    most at_once tasks calling it."""

    def called(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"text": part["text"], "translated_text": _halved(part["text"].tolist(), fn)})

    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("translated_text", T.StringType())])
    return batches.repartition(at_once, "bucket", "batch").groupBy("bucket", "batch").applyInPandas(called, kind)


DISPLAYS = ("underneath", "side_by_side", "popup_footnote", "replace")


def _applied(html: str | None, pairs: list | None, scope: str, display: str, first: int) -> str | None:
    if html is None or not pairs:
        return html
    said, root, number, notes = {p["text"]: p["translated"] for p in pairs}, parse(html), first, []

    def piece(tag: str, words: str, **attrs: str) -> Node:
        n = Node(tag, {k.strip("_"): v for k, v in attrs.items()})
        n.add(Node("#text", data=words))
        return n

    for n in unit_nodes(root, scope):
        new = said.get(compact(n.text()))
        if new is None:
            raise ValueError(f"no translation of {compact(n.text())[:80]!r}")
        if display == "replace":
            n.children = []
            n.add(Node("#text", data=new))
        elif display == "underneath":
            n.add(Node("br"))
            n.add(piece("span", new, class_="translation"))
        elif display == "side_by_side":
            left = Node("span", {"class": "original"})
            for c in n.children:
                left.add(c)
            n.children = []
            n.add(left)
            n.add(piece("span", new, class_="translation"))
        else:
            n.add(piece("a", f"[{number}]", href=f"#tr{number}", class_="noteref"))
            notes.append(piece("aside", new, id=f"tr{number}", class_="translation"))
            number += 1
    body = root.find("body") or root
    for n in notes:
        body.add(n)
    return root.html()


def apply_translations(chapters: DataFrame, units: DataFrame, translations: DataFrame, display: str = "underneath", scope: str = "article-captions") -> DataFrame:
    """chapters with translations (text, translated_text) put in; footnotes are numbered over
    the whole book, `replace` also replaces titles. A unit without one is an error."""
    if display not in DISPLAYS:
        raise ValueError(f"unknown display {display!r}")
    named = units.join(translations.select("text", "translated_text"), "text", "left")
    per = named.groupBy("book_id", "chapter_idx").agg(F.collect_list(F.struct("text", F.col("translated_text").alias("translated"))).alias("pairs"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("book_id").orderBy("chapter_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    joined = long_rows(chapters).join(per.withColumn("first_no", before), ["book_id", "chapter_idx"], "left")
    made = per_row(lambda html, pairs, first: _applied(html, pairs, scope, display, first or 1), T.StringType(), F.col("content_html"), F.col("pairs"), F.col("first_no"))
    out = joined.withColumn("content_html", made).drop("pairs", "n", "first_no")
    if display == "replace":
        titles = translations.select(F.col("text").alias("t_text"), F.col("translated_text").alias("t_new"))
        out = out.join(titles, text.compact_text(F.col("title")) == F.col("t_text"), "left").withColumn("title", F.coalesce("t_new", "title")).drop("t_text", "t_new")
    return out
