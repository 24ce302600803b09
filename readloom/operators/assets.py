"""Assets of books: duplicates, names, references, budgets.

assets: bundle_id, book_idx, asset_idx, filename, content, original_url, alt_urls."""


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions import text, urls
from readloom.functions.dom import parse
from readloom.functions.helpers import long_rows, per_row
from readloom.functions.tables import dropped, stored


def content_hash(content: Column) -> Column:
    """sha1 of the bytes; null for none."""
    return F.when(F.octet_length(content) > 0, F.sha1(content))


def url_keys(original: Column, alternatives: Column) -> Column:
    """Raw urls and their match keys, in order, each once."""
    every = F.filter(F.concat(F.array(original), F.coalesce(alternatives, F.array().cast("array<string>"))), lambda u: F.coalesce(u, F.lit("")) != "")
    both = F.flatten(F.transform(every, lambda u: F.array(u, urls.url_match_key(u))))
    return F.array_distinct(F.filter(both, lambda u: u != ""))


def _key_sets(assets: DataFrame) -> DataFrame:
    """(bundle_id, book_idx, asset_idx, filename, hash, keys): keys has the hash, then the url
    keys. The contents are read, but only their hashes go on."""
    keyed = assets.select("bundle_id", "book_idx", "asset_idx", "filename", content_hash(F.col("content")).alias("hash"), url_keys(F.col("original_url"), F.col("alt_urls")).alias("ukeys"))
    own = F.when(F.col("hash").isNotNull(), F.array(F.concat(F.lit("h:"), "hash"))).otherwise(F.array().cast("array<string>"))
    return keyed.select("bundle_id", "book_idx", "asset_idx", "filename", F.concat(own, F.transform("ukeys", lambda u: F.concat(F.lit("u:"), u))).alias("keys"))


_SET = ["bundle_id", "set"]


def _kept_sets(members: DataFrame) -> DataFrame:
    """The sets (bundle_id, set) that register their keys, of members (bundle_id, set, key),
    where a set is (book_idx, asset_idx), its rank. By rank, a set registers its keys unless
    one of them is registered.

    Parallel peeling: a set that has the least rank under each of its keys is kept, sets that
    share a key with it are not; the rest goes round again. Each round decides the first set
    of every group of sets that share keys, and all sets next to it."""
    kept, left = [], members
    while True:
        least = left.groupBy("bundle_id", "key").agg(F.min("set").alias("least"))
        seen = left.join(least, ["bundle_id", "key"])
        # one row for each set and each first of its keys
        meets = stored(seen.groupBy(*_SET, "least").agg(F.lit(1).alias("one")).drop("one"))
        won = meets.groupBy(_SET).agg(F.min("least").alias("first")).where(F.col("first") == F.col("set")).select(_SET)
        won = stored(won)
        kept.append(won)
        lost = meets.join(won.select("bundle_id", F.col("set").alias("least")), ["bundle_id", "least"], "left_semi").select(_SET).distinct()
        rest = stored(left.join(lost, _SET, "left_anti"))  # what won has lost to itself
        dropped(meets)
        if left is not members:
            dropped(left)
        left = rest
        if left.isEmpty():
            dropped(left)
            out = kept[0]
            for more in kept[1:]:
                out = out.union(more)
            return out


def asset_duplicates(assets: DataFrame) -> DataFrame:
    """(bundle_id, book_idx, asset_idx, filename, kept, kept_filename) of assets, in bundle
    order (book_idx, asset_idx). An asset is a duplicate if its content's hash is registered,
    else if one of its url keys is; a duplicate registers nothing, and takes the name of the
    asset that registered its hash before it, else its first such url key.

    Only keys that several sets hold can make duplicates: the others go first, and equal
    key sets are one. Contents are never shuffled. An asset without content and urls is kept;
    a null bundle is one of its own."""
    bundle = F.coalesce(F.concat(F.lit("+"), F.col("bundle_id").cast("string")), F.lit(""))
    rows = stored(_key_sets(assets).withColumn("bundle", F.col("bundle_id")).withColumn("bundle_id", bundle).withColumn("set", F.struct("book_idx", "asset_idx")))
    sets = rows.where(F.size("keys") > 0).groupBy("bundle_id", F.xxhash64("keys").alias("mark"), "keys").agg(F.min("set").alias("set"))
    # a key that one set holds in one row decides nothing
    held = rows.select("bundle_id", "set", F.explode("keys").alias("key"))
    common = stored(held.groupBy("bundle_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bundle_id", "key"))
    asked = stored(held.join(common, ["bundle_id", "key"], "left_semi"))
    members = stored(sets.select("bundle_id", "set", F.explode("keys").alias("key")).join(common, ["bundle_id", "key"], "left_semi"))
    kept = stored(_kept_sets(members))
    owners = stored(members.join(kept, _SET, "left_semi"))
    files = kept.join(rows.select("bundle_id", "set", "filename"), _SET).select("bundle_id", F.col("set").alias("owner"), "filename")
    hit = asked.join(owners.withColumnRenamed("set", "owner"), ["bundle_id", "key"]).where(F.col("owner") < F.col("set"))
    place = F.array_position(F.col("keys"), F.col("key"))
    first = hit.join(rows.select("bundle_id", "set", "keys"), _SET).groupBy(_SET).agg(F.min_by("owner", place).alias("owner"))
    target = stored(first.join(files, ["bundle_id", "owner"]).select("bundle_id", "set", F.col("filename").alias("target")))
    dropped(common, asked, members, kept, owners)
    out = rows.join(target, _SET, "left")
    return out.select(F.col("bundle").alias("bundle_id"), "book_idx", "asset_idx", "filename", F.col("target").isNull().alias("kept"), F.coalesce("target", "filename").alias("kept_filename"))


def _with(assets: DataFrame, found: DataFrame, ids: list[str]) -> DataFrame:
    """assets with the other columns of found, whose rows ids name. Contents stay where they
    are if found is small enough for Spark to broadcast it."""
    found = found.select(*[F.col(c).alias(f"of_{c}") for c in ids], *[c for c in found.columns if c not in ids])
    return assets.join(found, [assets[c].eqNullSafe(found[f"of_{c}"]) for c in ids]).drop(*[f"of_{c}" for c in ids])


def dedupe_assets(assets: DataFrame) -> DataFrame:
    """assets with kept and kept_filename, as asset_duplicates finds them; (bundle_id,
    book_idx, asset_idx) names an asset."""
    return _with(assets, stored(asset_duplicates(assets).drop("filename")), ["bundle_id", "book_idx", "asset_idx"])


def thread_duplicates(assets: DataFrame) -> DataFrame:
    """(thread_url, asset_idx, filename, kept, kept_filename) of the assets of threads: the
    first of each content in a thread is kept, as is all empty content. Hashes are grouped
    with partial sums, contents are not shuffled."""
    rows = stored(assets.select("thread_url", "asset_idx", "filename", content_hash(F.col("content")).alias("hash")))
    first = rows.where("hash IS NOT NULL").groupBy("thread_url", "hash").agg(F.min(F.struct("asset_idx", "filename")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("thread_url").alias("of"), F.col("hash").alias("same"), "first")
    found = rows.join(first, rows["thread_url"].eqNullSafe(first["of"]) & (rows["hash"] == first["same"]), "left")
    kept = F.coalesce(F.col("first.asset_idx") == F.col("asset_idx"), F.lit(True))
    return found.select("thread_url", "asset_idx", "filename", kept.alias("kept"), F.when(kept, F.col("filename")).otherwise(F.col("first.filename")).alias("kept_filename"))


def dedupe_thread_assets(assets: DataFrame) -> DataFrame:
    """assets of threads (thread_url, asset_idx, filename, content) with kept and
    kept_filename, as thread_duplicates finds them."""
    return _with(assets, stored(thread_duplicates(assets).drop("filename")), ["thread_url", "asset_idx"])


_SPACE = ["bundle", "folder", "core", "ext"]
_ROOT = [*_SPACE, "root"]
_FAMILY = [*_ROOT, "book_idx"]


def _stem(root: Column, book: Column, number: Column) -> Column:
    """The name that a root gives: itself (number 0), or the book's first, second ... of it."""
    return F.when(number == 0, root).otherwise(F.concat(F.lit("src"), book.cast("string"), F.lit("_"), root, F.when(number > 1, F.concat(F.lit("_"), number.cast("string"))).otherwise("")))


def _allotted(rows: DataFrame, no_plain: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """rows with number. The first row of a root has the plain name (unless it is among
    no_plain); the others count within their book, past the numbers that others hold. gaps
    (family, gap) has for each of those the place of the first row that it moves on."""
    first = rows.groupBy(_ROOT).agg(F.min("at").alias("first"))
    if no_plain is not None:
        first = first.join(no_plain, _ROOT, "left_anti")
    named = rows.join(first, _ROOT, "left")
    is_first = F.coalesce(F.col("first") == F.col("at"), F.lit(False))
    in_book = Window.partitionBy(_FAMILY).orderBy("at")
    counted = named.withColumn("plain", is_first).withColumn("place", F.row_number().over(in_book) - F.when(F.col("first.book_idx") == F.col("book_idx"), 1).otherwise(0)).drop("first")
    number = F.when(F.col("plain"), 0).otherwise(F.col("place"))
    if gaps is None:
        return counted.select(*rows.columns, number.cast("long").alias("number"))
    both = counted.withColumn("kind", F.lit(1)).unionByName(gaps.select(*_FAMILY, F.col("gap").alias("place"), F.lit(0).alias("kind")), allowMissingColumns=True)
    moved = F.sum(1 - F.col("kind")).over(Window.partitionBy(_FAMILY).orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("moved", moved).where("kind = 1").select(*rows.columns, F.when(F.col("plain"), 0).otherwise(F.col("place") + F.col("moved")).cast("long").alias("number"))


def _held(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What numbered rows take from other roots, as (root, since) and (family, number, since)."""
    stem = _stem(F.col("root"), F.col("book_idx"), F.col("number"))
    names = rows.select(*_SPACE, F.col("root").alias("of_root"), F.col("book_idx").alias("of_book"), F.col("number").alias("of_number"), F.col("at").alias("since"), stem.alias("stem"))
    plain = names.where("of_number > 0").select(*_SPACE, F.col("stem").alias("root"), "since")
    no_plain = plain.groupBy(_ROOT).agg(F.min("since").alias("since")).join(rows.groupBy(_ROOT).agg(F.min("at").alias("first")), _ROOT).where(F.col("since") < F.col("first")).select(_ROOT)
    book, rest = (F.regexp_extract("stem", r"(?s)^src(-?(?:0|[1-9]\d{0,8}))_(.+)$", i) for i in (1, 2))
    parsed = names.withColumns({"book_idx": F.when(book != "", book).cast("int"), "rest": rest}).where("book_idx IS NOT NULL")
    root, n = F.regexp_extract("rest", r"(?s)^(.+)_([1-9]\d{0,8})$", 1), F.regexp_extract("rest", r"(?s)^(.+)_([1-9]\d{0,8})$", 2)
    readings = F.array(F.struct(F.col("rest").alias("root"), F.lit(1).cast("long").alias("number")), F.struct(root.alias("root"), F.when(n != "", n).cast("long").alias("number")))
    told = parsed.withColumn("as", F.explode(readings)).select(*_SPACE, F.col("as.root").alias("root"), "book_idx", F.col("as.number").alias("number"), "since", "of_root", "of_book", "of_number")
    own = (F.col("root") == F.col("of_root")) & (F.col("book_idx") == F.col("of_book")) & (F.col("of_number") > 0)
    told = told.where((F.col("number") > 0) & ~own)
    taken = told.groupBy(*_FAMILY, "number").agg(F.min("since").alias("since")).join(rows.select(_FAMILY).distinct(), _FAMILY, "left_semi")
    return no_plain, taken


def _gaps(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """(family, gap) of the numbers taken before a row of the family came to them."""
    both = rows.where("number > 0").select(*_FAMILY, "number", F.col("at").alias("came"), F.lit(None).cast(taken.schema["since"].dataType).alias("since"), F.lit(1).alias("kind")).unionByName(taken.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    after = Window.partitionBy(_FAMILY).orderBy("number", "kind").rowsBetween(0, Window.unboundedFollowing)
    real = both.withColumn("came", F.first("came", ignorenulls=True).over(after)).where((F.col("kind") == 0) & (F.col("since") < F.col("came")))
    return real.select(*_FAMILY, (F.col("number") - F.row_number().over(Window.partitionBy(_FAMILY).orderBy("number")) + 1).alias("gap"))


def new_filenames(assets: DataFrame) -> DataFrame:
    """(bundle_id, book_idx, asset_idx, new_filename), unique in their bundle, in order of
    (book_idx, asset_idx): images/{root}{ext} if free, else src{book}_{root}{ext}, then _2,
    _3 ... book_idx is an integer.

    Every root of a book is numbered in a window of its own. Where no two rows get one name,
    that is what naming in order gives. Only roots that could have made a doubled name (they
    differ in such prefixes and numbers alone, as src1_a, a and a_2 do) are looked at again:
    a number that another root took earlier is left out and the places after it move on,
    until nothing changes. Each round settles at least the first row that was wrong, so the
    rounds are as many as names that displace each other in a row, not as rows."""
    path = F.regexp_replace(F.coalesce("filename", F.lit("")), r"(?s)[?#].*$", "")
    folder = F.when(path.startswith("images"), F.regexp_extract(path, r"^(images[^/]*(?:/.*)?)/[^/]*$", 1)).otherwise("images")
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(base, r"(?<=.)(\.[^.]*)$", 1)
    root = text.safe_filename(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))
    full = F.when(folder == "", "images").otherwise(folder)
    bundle = F.coalesce(F.concat(F.lit("+"), F.col("bundle_id").cast("string")), F.lit(""))
    rows = assets.select("bundle_id", bundle.alias("bundle"), "book_idx", "asset_idx", full.alias("folder"), F.when(root.isin("", "untitled"), "image").otherwise(root).alias("root"), F.when(ext == "", ".img").otherwise(ext).alias("ext"), F.struct("book_idx", "asset_idx").alias("at"))
    # names can only meet where roots are alike but for prefixes and numbers of this kind
    rows = rows.withColumn("core", F.regexp_replace(F.regexp_replace("root", r"^(?:src-?\d+(?:_|$))+", ""), r"(?:(?:^|_)\d+)+$", ""))
    named = stored(_allotted(rows))
    stem = _stem(F.col("root"), F.col("book_idx"), F.col("number"))
    doubled = stored(named.groupBy(*_SPACE, stem.alias("stem")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(_SPACE).distinct())
    done = named
    if not doubled.isEmpty():
        now = stored(named.join(doubled, _SPACE, "left_semi"))
        while True:
            no_plain, taken = _held(now)
            # what a root has lost or taken is known from the last round's names alone
            new = stored(_allotted(now.drop("number"), no_plain, _gaps(now, taken)))
            same = [*_FAMILY, "asset_idx", "number"]
            settled = new.select(same).exceptAll(now.select(same)).isEmpty()
            dropped(now)
            now = new
            if settled:
                break
        done = named.join(doubled, _SPACE, "left_anti").unionByName(now)
    return done.select("bundle_id", "book_idx", "asset_idx", F.concat("folder", F.lit("/"), stem, "ext").alias("new_filename"))


def assign_filenames(assets: DataFrame) -> DataFrame:
    """assets with new_filename, as new_filenames gives it."""
    return _with(assets, stored(new_filenames(assets)), ["bundle_id", "book_idx", "asset_idx"])


def _remapped(html: str | None, entries: list | None) -> str | None:
    names = {e["key"]: e["value"] for e in entries or []}
    if html is None or not names:
        return html
    root, changed = parse(html), False
    for n in root.find_all("img", "a"):
        attr = "src" if n.tag == "img" else "href"
        if (new := names.get(n.attrs.get(attr))) is not None:
            n.attrs[attr], changed = new, True
    return root.html() if changed else html


def remap_image_refs(chapters: DataFrame, mapping: DataFrame) -> DataFrame:
    """chapters with img sources and links renamed by mapping (book_id, old, new)."""
    names = mapping.where("old != new").groupBy("book_id").agg(F.map_entries(F.map_from_entries(F.collect_list(F.struct("old", "new")))).alias("names"))
    joined = long_rows(chapters).join(names, "book_id", "left")
    return joined.withColumn("content_html", F.when(F.col("names").isNull(), F.col("content_html")).otherwise(per_row(_remapped, T.StringType(), F.col("content_html"), F.col("names")))).drop("names")


# Most images and bytes of each preset; none for no bound.
PRESETS = {"compact": (200, 100 << 20), "balanced": (400, 200 << 20), "full": (None, None)}


def image_stats(assets: DataFrame, largest: int = 5) -> DataFrame:
    """(bundle_id, images, bytes, largest): the largest as (bytes, filename), ties by name."""
    sized = assets.select("bundle_id", "filename", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"))
    top = sized.withColumn("k", F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.desc("size"), "filename"))).where(F.col("k") <= largest)
    listed = top.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "size", "filename"))), lambda x: F.struct(x["size"].alias("size"), x["filename"].alias("filename"))).alias("largest"))
    return sized.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("images"), F.sum("size").alias("bytes")).join(listed, "bundle_id")


def check_image_budget(assets: DataFrame, preset: str = "balanced", max_images: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """image_stats with over_images, over_bytes and over (strictly more than the bound). An
    unknown preset counts as balanced; arguments override it."""
    images, size = PRESETS.get((preset or "").lower(), PRESETS["balanced"])
    images, size = max_images if max_images is not None else images, max_bytes if max_bytes is not None else size
    over = lambda c, bound: F.lit(False) if bound is None else F.col(c) > bound
    return image_stats(assets).withColumns({"over_images": over("images", images), "over_bytes": over("bytes", size)}).withColumn("over", F.col("over_images") | F.col("over_bytes"))


def reference_keys(url: Column) -> Column:
    """What an image and its asset may share: the match key, or the raw url where that is
    empty (equal urls have equal match keys), and a base name that says something."""
    name = F.substring_index(urls.until_query(url), "/", -1)
    plain = F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "[^a-z0-9]+", "")
    good = (F.length(name) > 8) & ~plain.rlike(f"^(?:{'|'.join(text.GENERIC_BASENAMES)}|[0-9]*)$")
    match = urls.bound(urls.url_match_key(url), lambda k: F.when(k == "", F.concat(F.lit("raw "), url)).otherwise(F.concat(F.lit("key "), k)))
    return F.array_compact(F.array(match, F.when(good, F.concat(F.lit("name "), F.lower(name)))))


def match_assets(images: DataFrame, assets: DataFrame) -> DataFrame:
    """images (book_id, image_idx, url) with the first asset (asset_idx, filename) of the
    book that has the same raw url, the same match key, or the same base name of over 8
    characters that is not generic; null if none."""
    every = F.filter(F.concat(F.array("original_url"), F.coalesce("alt_urls", F.array().cast("array<string>"))), lambda u: F.coalesce(u, F.lit("")) != "")
    have = assets.select("book_id", "asset_idx", "filename", F.explode(F.array_distinct(F.flatten(F.transform(every, reference_keys)))).alias("key"))
    first = have.groupBy("book_id", "key").agg(F.min(F.struct("asset_idx", "filename")).alias("asset"))
    hit = images.select("book_id", "image_idx", F.explode(reference_keys(F.col("url"))).alias("key")).join(first, ["book_id", "key"])
    best = hit.groupBy("book_id", "image_idx").agg(F.min("asset").alias("asset"))
    return images.join(best, ["book_id", "image_idx"], "left").withColumns({"asset_idx": F.col("asset.asset_idx"), "filename": F.col("asset.filename")}).drop("asset")


def image_references(chapters: DataFrame) -> DataFrame:
    """(book_id, filename) of every img source, each once."""
    found = F.regexp_extract_all("content_html", F.lit(r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return chapters.select("book_id", F.explode(found).alias("filename")).distinct()


def retain_referenced_assets(chapters: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets that a chapter of their book shows; all of a book that shows none."""
    used = stored(image_references(chapters))
    return assets.join(used, ["book_id", "filename"], "left_semi").unionByName(assets.join(used.select("book_id").distinct(), "book_id", "left_anti"))


def context_map_assets(chapters: DataFrame, assets: DataFrame) -> DataFrame:
    """Drawn maps that no chapter shows, of books whose text speaks of a map."""
    speaks = chapters.where(F.lower("content_html").rlike("mapped range|map shows")).select("book_id").distinct()
    where = F.lower(F.concat_ws(" ", "original_url", F.array_join("alt_urls", " ")))
    maps = assets.where((F.col("media_type") == "image/svg+xml") & where.contains("map") & ~where.rlike("timelapse|locator|logo|sprite"))
    return maps.join(speaks, "book_id", "left_semi").join(image_references(chapters), ["book_id", "filename"], "left_anti")
