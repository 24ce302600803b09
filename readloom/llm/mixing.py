"""Mixing sources to target weights by temperature, in DataFrame functions only.

Weights are token shares to the power alpha, normalised. alpha runs from 0 (all sources
alike) to 1 (as they are); it is bisected, inside one SQL expression, to the least value
under which no source is repeated more than a limit, or to a target entropy. Of each
source the budget then takes whole epochs, and a part of one more: documents lie in
blocks by hash, each epoch permutes blocks and documents anew, and the part ends inside
one block. That border is found by descending two levels of blocks, so no task orders a
whole source, and every document compares itself with its source's border.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import util

STEPS = 60
#: Sources up to this many are broadcast (a few hundred bytes each).
MAX_BROADCAST = 50_000


def n_words(text: Column) -> Column:
    return F.regexp_count(util.text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def temperature(sizes: Column, budget: Column, max_repeats: float | None, entropy: float | None) -> Column:
    """alpha in [0, 1]. sizes: array of (tokens, sources of that size), tokens > 0."""

    def total(f) -> Column:
        return F.aggregate(sizes, F.lit(0.0), lambda acc, x: acc + x["n"] * f(x["tokens"]))

    def too_flat(alpha: Column) -> Column:
        power = lambda t: F.pow(t, alpha)
        if entropy is not None:  # natural logarithm; falls as alpha grows
            z = total(power)
            return F.log(z) - alpha * total(lambda t: F.pow(t, alpha) * F.log(t)) / z > entropy
        return F.aggregate(sizes, F.lit(0.0), lambda acc, x: F.greatest(acc, F.pow(x["tokens"], alpha - 1))) * budget / total(power) > max_repeats

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        flat = too_flat(mid)
        return F.struct(F.when(flat, mid).otherwise(acc["lo"]).alias("lo"), F.when(flat, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve, lambda acc: acc["hi"])
    return F.when(too_flat(F.lit(0.0)), found).otherwise(0.0)


def _permuted(seed: str, epoch: Column, block: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), block))


def mix_sources(
    df: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None,
    budget: int | None = None, max_repeats: float | None = 1.25, entropy: float | None = None, seed: str = "mix",
) -> DataFrame:
    """Rows of df, each as often as its source's budget takes it, with an epoch (from 0).

    budget defaults to all tokens (words, or tokens_col). Where even alpha = 1 repeats
    too often, alpha is 1. A null source is a source of its own; rows without tokens
    (null and empty texts) fill no budget and are not taken. Of repeated rows on the
    border all are taken. An empty table gives an empty result. A column named epoch is
    replaced.
    """
    src, tok, h, ident, mix_cut = util.free_name(df, "mix_source", "mix_tokens", "mix_hash", "mix_id", "mix_cut")
    columns = [c for c in df.columns if c != "epoch"]
    tokens = F.coalesce(F.col(f"`{tokens_col}`").cast("long"), F.lit(0)) if tokens_col else n_words(F.col(f"`{text_col}`"))
    text_id = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    # the null source gets a name that no other has
    named = df.select(
        *[F.col(f"`{c}`") for c in columns], F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias(src),
        tokens.alias(tok), text_id.alias(ident), F.md5(F.concat(F.lit(seed + "|"), text_id)).alias(h),
    ).where(F.col(tok) > 0)
    leaves = util.stored(named.select(src, tok, ident, h))
    sums = util.stored(leaves.groupBy(src).agg(F.sum(tok).alias("have")))
    all_tokens = F.lit(budget).cast("double") if budget is not None else F.col("all_tokens").cast("double")
    by_size = sums.groupBy(F.col("have").alias("tokens")).agg(F.count(F.lit(1)).alias("n"))
    line = by_size.agg(F.array_sort(F.collect_list(F.struct(F.col("tokens").cast("double").alias("tokens"), "n"))).alias("sizes"), F.sum(F.col("tokens") * F.col("n")).alias("all_tokens"), F.sum("n").alias("n_sources"))
    plan = line.select(temperature(F.col("sizes"), all_tokens, max_repeats, entropy).alias("alpha"), "sizes", all_tokens.alias("budget"), "n_sources")
    plan = plan.select("alpha", "budget", "n_sources", F.aggregate("sizes", F.lit(0.0), lambda acc, x: acc + x["n"] * F.pow(x["tokens"], F.col("alpha"))).alias("z"))
    alpha, total, n_sources, z = plan.first()  # four numbers
    if not n_sources:
        return df.select(*[F.col(f"`{c}`") for c in columns], F.lit(0).alias("epoch")).limit(0)
    quota = F.pow(F.col("have").cast("double"), F.lit(alpha)) / F.lit(z) * F.lit(total)
    sums = sums.withColumn("quota", quota).withColumn("whole", F.floor(F.col("quota") / F.col("have")).cast("int"))
    sums = util.stored(sums.withColumn("rest", F.col("quota") - F.col("whole") * F.col("have")))

    # the border of the part: a block, a block inside it, a document inside that
    small = (lambda t: F.broadcast(t)) if n_sources <= MAX_BROADCAST else (lambda t: t)
    at = leaves.join(small(sums), src).withColumn("p1", _permuted(seed, F.col("whole"), F.substr(h, F.lit(1), F.lit(3)))).withColumn("p2", _permuted(seed, F.col("whole"), F.substr(h, F.lit(4), F.lit(3))))

    def border(rows: DataFrame, order: list[str], cut: str, keep: list[str]) -> DataFrame:
        """The first group, in order, with which the sum reaches what is left."""
        groups = rows.groupBy(src, "rest", *order).agg(F.sum(tok).alias("t"))
        upto = F.sum("t").over(Window.partitionBy(src).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        found = groups.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("t") < F.col("rest")) & (F.col("rest") > 0))
        return found.select(src, F.struct(*order).alias(cut), (F.col("rest") - F.col("upto") + F.col("t")).alias("left"), *[F.col(x) for x in keep])

    c1 = util.stored(border(at, ["p1"], "c1", []))
    in1 = at.drop("rest").join(small(c1), src).where(F.col("p1") == F.col("c1.p1")).withColumnRenamed("left", "rest")
    c2 = util.stored(border(in1, ["p2"], "c2", []))
    in2 = in1.drop("rest").join(small(c2), src).where(F.col("p2") == F.col("c2.p2")).withColumnRenamed("left", "rest")
    c3 = border(in2, [h, ident], "c3", [])
    cuts = util.stored(sums.select(src, "whole").join(c1.drop("left"), src, "left").join(c2.drop("left"), src, "left").join(c3.drop("left"), src, "left"))

    p1 = _permuted(seed, F.col(f"{mix_cut}.whole"), F.substr(h, F.lit(1), F.lit(3)))
    p2 = _permuted(seed, F.col(f"{mix_cut}.whole"), F.substr(h, F.lit(4), F.lit(3)))
    here = F.struct(p1.alias("a"), p2.alias("b"), F.col(h).alias("c"), F.col(ident).alias("d"))
    edge = F.struct(F.col(f"{mix_cut}.c1.p1").alias("a"), F.col(f"{mix_cut}.c2.p2").alias("b"), F.col(f"{mix_cut}.c3.{h}").alias("c"), F.col(f"{mix_cut}.c3.{ident}").alias("d"))
    part = F.col(f"{mix_cut}.c3").isNotNull() & (here <= edge)
    times = F.col(f"{mix_cut}.whole") + F.when(part, 1).otherwise(0)
    epochs = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    packed = cuts.select(F.col(src), F.struct("whole", "c1", "c2", "c3").alias(mix_cut))
    return named.join(small(packed), src).select(*[F.col(f"`{c}`") for c in columns], F.explode(epochs).alias("epoch"))
