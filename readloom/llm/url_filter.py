"""URL filters: a trie over reversed host labels and path segments.

The rules form one trie: from the top-level label down to the host, and from each host
node on over the segments of the rule's path. The trie is broadcast, as long as it has
at most MAX_RULES rules (checked); larger rule sets are joined on the url's own host
suffixes and path prefixes instead. The longest rule that fits decides, whether it
allows or blocks: the host with more labels first, then the longer path.
"""

from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import util

MAX_RULES = 100_000
MAX_CHARS = 20_000_000


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(util.text_or_empty(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(util.text_or_empty(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are reached by label or segment. A rule ends in a path node under the open
    last segment of its path ('' after a final slash), which a url's segment begins with."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for k, rule in enumerate(rules):
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(("host", label), {})
            *whole, opened = rule.path.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            # a later rule of the same host and path yields to an earlier block
            ends = node.setdefault("ends", {})
            if opened not in ends or rule.verdict == "block":
                ends[opened] = k

    def find(self, host: str, path: str) -> int | None:
        """Index of the longest rule that fits."""
        node, best = self.root, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            if (tree := node.get("paths")) is not None and (found := self._longest(tree, segments)) is not None:
                best = found  # more labels
        return best

    @staticmethod
    def _longest(node: dict, segments: list[str]) -> int | None:
        best = None
        for segment in segments:
            if ends := node.get("ends"):
                for n in range(len(segment), -1, -1):
                    if (found := ends.get(segment[:n])) is not None:
                        best = found
                        break
            node = node.get(("segment", segment))
            if node is None:
                break
        return best


def judged(df: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", trie_rules: int = MAX_RULES) -> DataFrame:
    """df with host, path, rule and verdict; columns of these names are replaced.

    A null url, or one without ://, has an empty host and path, no rule, and the default
    verdict. Of two rules with the same host and path the blocking one holds. Repeated
    rows are judged alike, each for itself.
    """
    if len(rules) <= trie_rules and sum(len(r.host) + len(r.path) for r in rules) <= MAX_CHARS:
        return _by_trie(df, rules, url_col, default)
    table = df.sparkSession.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    return judged_by_join(df, table, url_col, default)


def _by_trie(df: DataFrame, rules: list[Rule], url_col: str, default: str) -> DataFrame:
    util.small_batches(df.sparkSession, 5000)  # urls are short; a lower bound holds
    sent = df.sparkSession.sparkContext.broadcast((Trie(rules), [r.host + r.path for r in rules], [r.verdict for r in rules]))
    kind = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    @F.arrow_udf(kind)
    def verdicts(host: pa.Array, path: pa.Array) -> pa.Array:
        trie, names, says = sent.value
        found = [trie.find(h, p) if h else None for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)]
        name = pa.array([None if k is None else names[k] for k in found], pa.string())
        verdict = pa.array([default if k is None else says[k] for k in found], pa.string())
        return pa.StructArray.from_arrays([name, verdict], ["rule", "verdict"])

    names = [c for c in df.columns if c not in ("host", "path", "rule", "verdict") or c == url_col]
    (made, url) = util.free_name(df, "made", "url_in")
    parts = df.withColumn(url, F.col(f"`{url_col}`")).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn(made, verdicts("host", "path"))
    return parts.select(*[F.col(f"`{c}`") for c in names if c not in ("host", "path")], "host", "path", F.col(f"{made}.rule").alias("rule"), F.col(f"{made}.verdict").alias("verdict"))


def judged_by_join(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """As judged(), for a rule table (verdict, host, path) of any size. Distinct urls meet
    the rules of their host's suffixes by an equi-join: with each suffix come the lengths
    of its rules' paths (a few, collected by host), and only path prefixes of these
    lengths meet the rules themselves. Columns named host, path, rule or verdict are
    replaced, others kept, whatever their names."""
    url, best, h, p = util.free_name(df, "url_in", "best", "host_in", "path_in")
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block over allow
    lengths = one.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    urls = df.select(F.col(f"`{url_col}`").alias(url)).distinct().select(url, host_of(F.col(url)).alias("h"), path_of(F.col(url)).alias("p"))
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.where("h != ''").select(url, "p", F.explode(suffixes).alias("host")).join(lengths, "host")
    some = F.filter("lengths", lambda n: n <= F.length("p"))
    keys = hosts.select(url, "host", F.explode(F.transform(some, lambda n: F.substr(F.col("p"), F.lit(1), n))).alias("path"))
    fits = keys.join(one, ["host", "path"])
    most = F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct(F.length("host"), F.length("path")))
    found = fits.groupBy(F.col(url).alias(h)).agg(most.alias(best))
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    named = df.withColumn(url, F.col(f"`{url_col}`"))
    joined = named.join(found, F.col(url).eqNullSafe(F.col(h)), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in keep], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(f"{best}.rule").alias("rule"), F.coalesce(f"{best}.verdict", F.lit(default)).alias("verdict")
    )
