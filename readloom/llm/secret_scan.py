"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched once for all kinds; texts with a hit get their spans from the
pieces between matches, since a match starts where the lengths before it end. The
hashes of the found values are then counted over the corpus by distinct repositories
and distinct owners: a value that several owners hold is a widely copied example, one
that a single owner holds in few repositories looks live.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

# The kinds in order, each with its pattern, the group that holds the
# value, and the least length of the value for a match to stand.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]{20,})", 1, 20),
]
BASE = ("assign", "access", "hex")
#: A text that this does not hit has no span of any kind.
ANY = r"(?i:password|passwd|secret|token|api_?key|bearer\x20)|AKIA|[0-9a-f]{24}|-----BEGIN |eyJ|gh[pousr]_"

SPAN = "struct<start:int,kind_no:int,kind:string,stop:int,value_hash:string,varied:boolean>"


def _spans(text: Column, number: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches; positions in code points, end exclusive."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["gap"])
        stop = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        value = F.regexp_extract(part["hit"], pattern, group)
        span = F.struct(
            begin.alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), stop.alias("stop"), F.sha2(value, 256).alias("value_hash"),
            (F.size(F.array_distinct(F.split(value, ""))) >= 8).alias("varied"),
        ).cast(SPAN)
        more = F.when(part["hit"].isNotNull() & (F.length(value) >= least), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(stop.alias("at"), more.alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def found_spans(text: Column) -> Column:
    """Spans of all kinds by start, then kind; empty for texts without a hit."""
    every = F.concat(*[_spans(text, k, *kind) for k, kind in enumerate(KINDS)])
    return F.when(text.rlike(ANY), F.array_sort(every)).otherwise(F.array().cast(f"array<{SPAN}>"))


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_scan(df: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = 3, live_repos: int = 5, carry: list[str] | None = None) -> DataFrame:
    """df (or its columns in carry) with secrets: an array of (kind, start, stop, value_hash, n_repos, n_owners,
    verdict), by start, then kind.

    verdict is `example` for a value that at least example_owners owners hold, `live` for
    a varied value (8 distinct characters) of one owner in at most live_repos
    repositories, else `unclear`. A null text counts as empty; null repositories and
    owners are not counted; repeated rows add nothing to distinct counts. An empty table
    gives an empty result. A column named secrets is replaced. A value's rows are counted
    after map-side distinct, so that a very common value is no hot key.
    """
    sid, spans, repo, owner, classes = util.free_name(df, "values_id", "spans", "repo", "owner", "classes")
    columns = [c for c in (carry or df.columns) if c != "secrets"]
    scanned = df.select(
        *[F.col(f"`{c}`") for c in columns], F.col(f"`{repo_col}`").cast("string").alias(repo), F.col(f"`{owner_col}`").cast("string").alias(owner),
        found_spans(util.text_or_empty(F.col(f"`{text_col}`"))).alias(spans),
    )
    # rows with the same values in the same order share their answer; others meet nothing
    values = F.array_join(F.transform(F.col(spans), lambda s: s["value_hash"]), ",")
    rows = util.stored(scanned.withColumn(sid, F.when(F.size(spans) > 0, F.sha2(values, 256)).otherwise(F.concat(F.lit("none "), F.xxhash64(repo, owner).cast("string")))))
    hits = rows.where(F.size(spans) > 0)
    each = hits.select(repo, owner, F.explode(F.transform(F.col(spans), lambda s: s["value_hash"])).alias("value_hash"))
    held = each.groupBy("value_hash").agg(F.count_distinct(repo).alias("n_repos"), F.count_distinct(owner).alias("n_owners"))
    sets = hits.groupBy(sid).agg(F.first(spans).alias(spans)).select(sid, F.explode(F.array_distinct(F.transform(F.col(spans), lambda s: s["value_hash"]))).alias("value_hash"))
    answers = sets.join(held, "value_hash").groupBy(sid).agg(F.map_from_entries(F.collect_list(F.struct("value_hash", F.struct("n_repos", "n_owners")))).alias(classes))

    def told(s: Column) -> Column:
        count = F.element_at(F.col(classes), s["value_hash"])
        live = s["varied"] & (count["n_owners"] <= 1) & (count["n_repos"] <= live_repos)
        verdict = F.when(count["n_owners"] >= example_owners, "example").when(live, "live").otherwise("unclear")
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value_hash"].alias("value_hash"), count["n_repos"].alias("n_repos"), count["n_owners"].alias("n_owners"), verdict.alias("verdict"))

    return rows.join(answers, sid, "left").select(*[F.col(f"`{c}`") for c in columns], F.transform(F.col(spans), told).alias("secrets"))
