"""Books to bundles. books: bundle_id, book_idx, title, url, published_date, saved_at.
chapters: bundle_id, book_idx, chapter_idx, title, filename, is_article, is_comments."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import text, urls


def build_bundle(books: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, toc) of each bundle in book order. Chapters stay rows: they get a file name
    per book and a place in the spine. The toc has a row for each book with an article:
    `{date} - {title}` if dated, and the book's comments as children."""
    spine = F.row_number().over(Window.partitionBy("bundle_id").orderBy("book_idx", "chapter_idx")) - 1
    out = chapters.withColumn("spine", spine).withColumn("filename", F.concat(F.lit("b"), F.col("book_idx").cast("string"), F.lit("_"), "filename"))
    heads = out.groupBy("bundle_id", "book_idx").agg(
        F.min_by(F.when(F.col("is_article"), F.col("filename")), F.when(F.col("is_article"), F.col("chapter_idx"))).alias("article"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("is_comments"), F.struct("chapter_idx", "title", "filename")))), lambda c: F.struct(c["title"].alias("title"), c["filename"].alias("filename"))).alias("children"),
    )
    label = F.when(F.col("published_date").isNotNull(), F.concat(F.date_format("published_date", "yyyy-MM-dd"), F.lit(" - "), "title")).otherwise(F.col("title"))
    toc = books.join(heads.where("article IS NOT NULL"), ["bundle_id", "book_idx"]).select("bundle_id", "book_idx", label.alias("label"), F.col("article").alias("filename"), "children")
    return out, toc


def bundle_titles(books: DataFrame, start: str | None = None, end: str | None = None, discovered: bool = False, today: str | None = None) -> DataFrame:
    """(bundle_id, title): the site if there is one only, else Anthology or Discovered_Posts,
    with the range or today's date after it unless it is there already."""
    site = F.regexp_replace(urls.host(F.col("url")), r"^www\.", "")
    sites = F.collect_set(F.nullif(site, F.lit("")))
    base = F.when(F.size("sites") == 1, F.get("sites", 0)).otherwise("Discovered_Posts" if discovered else "Anthology")
    suffix = f"_{start}_to_{end}" if start and end else f"_from_{start}" if start else f"_until_{end}" if end else None
    day = F.lit(f"_{today}") if today else F.concat(F.lit("_"), F.date_format(F.current_date(), "yyyy-MM-dd"))
    tail = F.lit(suffix) if suffix else day
    named = books.groupBy("bundle_id").agg(sites.alias("sites")).select("bundle_id", base.alias("base"))
    return named.select("bundle_id", F.when(F.col("base").contains(F.substring(tail, 2, 100)), F.col("base")).otherwise(F.concat("base", tail)).alias("title"))


def toc_entries(chapters: DataFrame) -> DataFrame:
    """(bundle_id, spine, anchor, label, page_label): an entry per chapter; the anchor comes
    from its uid, file name or title, repeated ones get -{spine}. A column page_labels
    (array of (page, id)) gives children, the first of each id; a bundle's title comes
    first unless it equals the first chapter's."""
    base = text.safe_filename(F.coalesce(F.nullif("uid", F.lit("")), F.nullif("filename", F.lit("")), "title"))
    anchor = F.when(F.row_number().over(Window.partitionBy("bundle_id", "base").orderBy("spine")) > 1, F.concat("base", F.lit("-"), F.col("spine").cast("string"))).otherwise(F.col("base"))
    rows = chapters.withColumn("base", base).withColumn("anchor", anchor)
    top = rows.select("bundle_id", "spine", F.lit(-1).alias("place"), "anchor", F.coalesce("toc_title", "title").alias("label"), F.lit(None).cast("int").alias("page_label"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("bundle_id").orderBy("spine"))).where("k = 1")
    book = first.where(~text.titles_equivalent(F.col("bundle_title"), F.col("title"))).select("bundle_id", F.lit(-1).alias("spine"), F.lit(-1).alias("place"), F.lit("book").alias("anchor"), F.col("bundle_title").alias("label"), F.lit(None).cast("int").alias("page_label"))
    pages = rows.select("bundle_id", "spine", F.posexplode("page_labels").alias("place", "p"))
    pages = pages.withColumn("k", F.row_number().over(Window.partitionBy("bundle_id", "spine", "p.id").orderBy("place"))).where("k = 1")
    below = pages.select("bundle_id", "spine", "place", F.col("p.id").alias("anchor"), F.concat(F.lit("Page "), F.col("p.page").cast("string")).alias("label"), F.col("p.page").alias("page_label"))
    return book.unionByName(top).unionByName(below)


def apply_saved_at(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """chapters where each book's saved_at has gone to its first article chapter without one
    (null or empty); in a book without articles, to its first chapter without one."""
    # one order for all windows, so that a task sorts its rows once
    book = Window.partitionBy("bundle_id", "book_idx").orderBy("chapter_idx")
    article = F.coalesce("is_article", F.lit(False))
    whole = book.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    able = (F.coalesce("saved_at", F.lit("")) == "") & (article | ~F.max(article).over(whole))
    earlier = F.coalesce(F.max("able").over(book.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    first = chapters.withColumn("able", able).withColumn("takes", F.col("able") & ~earlier)
    own = books.select("bundle_id", "book_idx", F.col("saved_at").alias("book_saved_at"))
    given = first.join(own, ["bundle_id", "book_idx"], "left")
    return given.withColumn("saved_at", F.when(F.col("takes"), F.coalesce("book_saved_at", "saved_at")).otherwise(F.col("saved_at"))).drop("able", "takes", "book_saved_at")
