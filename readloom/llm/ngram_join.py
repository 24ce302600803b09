"""N-gram Jaccard join: which documents share 3/4 of their five-word shingles.

1. Every document becomes a set of hashed shingles. Equal sets form one class; the rest
   works on classes.
2. Blocks: in a common order, rare shingles first, two linked sets meet at their first
   shared member. Where it stands in each set bounds the overlap, and so the size of a
   partner; members beyond which no partner is left are not dealt out. The order comes
   from a sketch of all shingle counts, of fixed size. Packed arrays of (member, set,
   size, largest partner), 17 bytes an entry, go to buckets.
3. Sets of a small block are paired where size and place allow it. A large block is not
   paired up: its sets meet two pivots, of which one has the fewest rare members, as the
   original of many copies has. Pairs are bounded by size and bit counts of hashed
   bitmaps, then decided by intersecting sorted arrays; what links is joined into
   components.
4. In large blocks, sets that no other component of their block can still hold a partner
   for are left out, by size band. The rest is cut into size-banded tiles of bounded
   bytes. A tile compares its sets across components, by size, place and bit counts
   before exact intersection, and joins those that link as it goes, so it returns a few
   links, never its pairs. Sets linked already need no further comparison, as a component
   is the same whichever links show it.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, shingles, util

U64 = np.uint64
#: Slots of the count sketch (2 bytes each in a task, 1 when broadcast): a fixed bound.
SLOTS = 1 << 21
#: Members of a block that are paired directly.
SMALL = 32
#: A bucket's share of packed members, about.
BUCKET = 400_000
#: Estimated count from which a member is not gathered in one bucket.
HOT = 200_000
#: Bytes of the sets in a tile, about.
TILE = 8_000_000
#: Ratio of the sizes of a band, and bytes of a signature.
BAND, BITS_BYTES = 1.34, shingles.BITS // 8
#: Bits of the filter that names the rows to be fetched, 16 a set: at most 16 MB.
LEAST_FILTER, MOST_FILTER = 1 << 20, 1 << 27
#: Seeds tried for names of sets that do not collide.
SEEDS = 100


def _sketch(docs: DataFrame) -> np.ndarray:
    """Level (a rounded logarithm) of each slot's count over all documents' shingles."""
    part = SLOTS // 64

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            _, h = shingles.of_batch(*util.utf8(batch.column(0)))
            np.add.at(total, (h & U64(SLOTS - 1)).astype(np.int64), np.uint32(1))
        small = np.minimum(total, 65535).astype(np.uint16)
        yield pa.record_batch([pa.array(range(64), pa.int32()), pa.array([x.tobytes() for x in small.reshape(64, part)], pa.binary())], ["part", "counts"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(part, np.int64)
        for x in rows["counts"]:
            total += np.frombuffer(x, np.uint16)
        level = np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "level": [level.tobytes()]})

    rows = docs.select("text").mapInArrow(counted, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())]))
    done = rows.groupBy("part").applyInPandas(summed, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("level", T.BinaryType())])).collect()
    level = np.zeros(SLOTS, np.uint8)
    for r in done:  # 64 rows of fixed size
        level[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["level"], np.uint8)
    return level


def _described(docs: DataFrame, seed: int) -> DataFrame:
    """docs with n, node and check of its set in place of the text."""
    kind = T.StructType([T.StructField(x, T.LongType()) for x in ("n", "node", "check")])

    @F.arrow_udf(kind)
    def described(texts: pa.Array) -> pa.Array:
        size = len(texts)
        doc, h = shingles.of_batch(*util.utf8(texts))
        node, check = shingles.names(doc, h, size, seed)
        return pa.StructArray.from_arrays([pa.array(shingles.sizes(doc, size)), pa.array(node), pa.array(check)], ["n", "node", "check"])

    return docs.withColumn("set", described("text")).drop("text").select("*", "set.*").drop("set")


#: Steps of a doubling in the codes of sizes. Codes grow with sizes, so comparing them
#: never rules out what the sizes allow.
STEPS = 2048


def _code(size: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(np.maximum(size, 1))).astype(np.uint16)


#: Arrays of a packed record, one entry for a member of a set: the upper 40 bits of the
#: member's hash, the set, and the codes of its size and of its largest partner.
ENTRY = ["members", "nodes", "sizes", "most"]
ENTRY_KIND = [T.StructField(x, T.BinaryType()) for x in ENTRY]


def _packed_entry(h: np.ndarray, node: np.ndarray, n: np.ndarray, most: np.ndarray, i: int, j: int) -> list[bytes]:
    short = np.ascontiguousarray(h[i:j]).view(np.uint8).reshape(-1, 8)[:, 3:]
    return [short.tobytes(), node[i:j].tobytes(), n[i:j].tobytes(), most[i:j].tobytes()]


def _entries(part: pd.DataFrame) -> list[np.ndarray]:
    short, *rest = (np.frombuffer(b"".join(part[x]), kind) for x, kind in zip(ENTRY, (np.uint8, np.int64, np.uint16, np.uint16), strict=True))
    h = np.zeros((len(short) // 5, 8), np.uint8)
    h[:, :5] = short.reshape(-1, 5)
    return [h.view(np.int64).ravel(), *rest]


def _cut(key: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Starts of runs of equal keys, and (from, to) of each."""
    if not len(key):
        return np.zeros(0, np.int64), []
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return cut, list(zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True))


def _blocks(docs: DataFrame, level: np.ndarray, seed: int, buckets: int) -> DataFrame:
    """Rows (kind, a, b, n, most): kind 0 for a pair a < b of a small block, kind 1 for a
    member b of the large block a, with the codes of its size and its largest partner."""
    sent = docs.sparkSession.sparkContext.broadcast(level)
    hot_level = int(min(8 * np.log2(1 + HOT), 254))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, held, size, seen = sent.value, [], 0, set()
        for batch in batches:
            data, offsets = util.utf8(batch.column(0))
            n = len(offsets) - 1
            doc, h = shingles.of_batch(data, offsets)
            node, _ = shingles.names(doc, h, n, seed)
            at, most = shingles.prefixes(doc, h, n, level)
            new = np.zeros(n, bool)
            for i, name in enumerate(node.tolist()):  # equal sets of a task are dealt once
                if name not in seen:
                    seen.add(name)
                    new[i] = True
            at, most = at[new[doc[at]]], most[new[doc[at]]]
            held.append((h[at], node[doc[at]], _code(shingles.sizes(doc, n))[doc[at]], _code(most)))
            size += len(at)
            if size > 500_000:
                yield packed(level, held)
                held, size = [], 0
        if size:
            yield packed(level, held)

    def packed(level: np.ndarray, held: list) -> pa.RecordBatch:
        entries = [np.concatenate(x) for x in zip(*held, strict=True)]
        h, node = entries[:2]
        hot = level[h & U64(SLOTS - 1)] >= hot_level
        # a hot member is spread over all buckets by its set
        bucket = (np.where(hot, util.mixed(h ^ node.view(U64)), util.mixed(h)) >> U64(3)) % U64(buckets)
        key = bucket.astype(np.int64) * 2 + hot
        order = np.argsort(key, kind="stable")
        key = key[order]
        cut, parts = _cut(key)
        entries = [e[order] for e in entries]
        arrays = [pa.array(x, pa.binary()) for x in zip(*[_packed_entry(*entries, i, j) for i, j in parts], strict=True)]
        return pa.record_batch([pa.array(key[cut] // 2), pa.array(key[cut] % 2 == 1), *arrays], ["bucket", "hot", *ENTRY])

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        util.memory_returned()
        out = []
        for hot, part in rows.groupby("hot"):
            h, node, n, most = _entries(part)
            order = np.lexsort((node, h))
            h, node, n, most = (x[order] for x in (h, node, n, most))
            new = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])] if len(h) else np.zeros(0, bool)
            h, node, n, most = (x[new] for x in (h, node, n, most))  # equal sets once
            cut, _ = _cut(h)
            run = np.diff(np.r_[cut, len(h)])
            large = np.repeat((run > SMALL) | hot, run)
            out.append(np.stack([np.ones(int(large.sum()), np.int64), h[large], node[large], n[large], most[large]], axis=1))
            if not hot:
                h, node, n, most = (x[~large] for x in (h, node, n, most))
                pairs = []
                for d in range(1, SMALL):
                    i = np.flatnonzero(h[d:] == h[:-d])
                    if not len(i):
                        break
                    i = i[(n[i] <= most[i + d]) & (n[i + d] <= most[i])]
                    pairs.append(np.stack([node[i], node[i + d]], axis=1))
                if pairs:
                    found = np.unique(np.concatenate(pairs), axis=0)
                    none = np.zeros((len(found), 1), np.int64)
                    out.append(np.concatenate([none, found, none, none], axis=1))
        rows = np.concatenate(out)
        return pd.DataFrame({"kind": rows[:, 0].astype(np.int32), "a": rows[:, 1], "b": rows[:, 2], "n": rows[:, 3], "most": rows[:, 4]})

    dealt_kind = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("hot", T.BooleanType()), *ENTRY_KIND])
    met_kind = T.StructType([T.StructField("kind", T.IntegerType()), *[T.StructField(x, T.LongType()) for x in ("a", "b", "n", "most")]])
    return docs.select("text").mapInArrow(dealt, dealt_kind).groupBy("bucket").applyInPandas(met, met_kind)


def _stars(big: DataFrame) -> DataFrame:
    """(a, b): the sets of each large block with two pivots: the one whose members before
    the shared one are fewest for its size, and any other. Ties go to the same set in
    every block, so that blocks of the same sets share their pivots."""
    entry = F.struct(F.col("node").alias("pivot"), F.col("n").alias("n_p"), F.col("most").alias("most_p"))
    first = F.max_by(entry, F.struct(F.floor((F.col("most") - F.col("n")) / 20), F.xxhash64("node")))
    pivots = big.groupBy("block").agg(first.alias("x"), F.max_by(entry, F.xxhash64("node", F.lit(1))).alias("y"))
    pivots = pivots.select("block", F.explode(F.array_distinct(F.array("x", "y"))).alias("p")).select("block", "p.*")
    met = big.join(pivots, "block").where("node != pivot AND n <= most_p AND n_p <= most")
    return met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _may_link(na: np.ndarray, nb: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """False where sizes or bit counts rule the link out. Every bit that one side alone
    has stands for at least one member that the other side lacks."""
    over_a = na - np.bitwise_count(bits_a & ~bits_b).sum(axis=-1, dtype=np.int64)
    over_b = nb - np.bitwise_count(bits_b & ~bits_a).sum(axis=-1, dtype=np.int64)
    return shingles.linked(np.minimum(over_a, over_b), na, nb)


def _grid(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), U64).reshape(len(bits), -1)


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that size and bit counts allow."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    @F.arrow_udf(T.BooleanType())
    def allowed(na: pa.Array, nb: pa.Array, bits_a: pa.Array, bits_b: pa.Array) -> pa.Array:
        if not len(na):
            return pa.array([], pa.bool_())
        return pa.array(_may_link(na.to_numpy(), nb.to_numpy(), _grid(bits_a.to_pylist()), _grid(bits_b.to_pylist())))

    return pairs.join(side("a"), "a").join(side("b"), "b").where(allowed("n_a", "n_b", "bits_a", "bits_b")).select("a", "b")


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


FETCHED = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("members", T.BinaryType())])


def _places(key: np.ndarray, size: int) -> list[np.ndarray]:
    """Two places of a row's key in a filter of that many bits."""
    return [np.mod(key, size), np.mod(key >> 32, size)]


def _fetched(docs: DataFrame, rows: DataFrame, nodes: DataFrame, seed: int, arrays: bool = True) -> DataFrame:
    """(node, n, bits, members) of the sets named in nodes (node), once each, from the
    texts; without arrays, members are null. rows (node, row_key) names one row of each
    set. A filter of these rows' keys, broadcast, spares most other rows, the copies too;
    the join is exact."""
    wanted = util.stored(rows.join(nodes.distinct(), "node", "left_semi"))
    size = 1 << int(np.clip(np.ceil(np.log2(16 * max(wanted.count(), 1))), np.log2(LEAST_FILTER), np.log2(MOST_FILTER)))
    place = F.explode(F.array(F.expr(f"pmod(row_key, {size})"), F.expr(f"pmod(shiftright(row_key, 32), {size})")))
    marks = wanted.select(place.alias("place")).select(F.expr("cast(shiftright(place, 6) AS int)").alias("at"), F.expr("shiftleft(1L, cast(place % 64 AS int))").alias("bit"))
    words = np.zeros(size // 64, np.int64)
    for r in marks.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # at most size / 64 rows
        words[r["at"]] = r["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(words.view(U64))

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, seen = sent.value, set()
        for batch in batches:
            both = [(mask[at >> 6] >> (at & 63).astype(U64) & U64(1)).astype(bool) for at in _places(batch.column(0).to_numpy(), size)]
            data, offsets = util.utf8(batch.column(1).filter(pa.array(both[0] & both[1])))
            n = len(offsets) - 1
            doc, h = shingles.of_batch(data, offsets)
            node, _ = shingles.names(doc, h, n, seed)
            edge = np.searchsorted(doc, np.arange(n + 1))
            found = []
            for i in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                name = int(node[i])
                if name not in seen:
                    seen.add(name)
                    own = h[edge[i] : edge[i + 1]]
                    found.append((name, len(own), shingles.signature(own).tobytes(), own.tobytes() if arrays else None))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], FETCHED.names)

    sets = docs.select("row_key", "text").mapInArrow(fetched, FETCHED)
    one = F.first(F.struct("n", "bits", "members"))
    return sets.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(one.alias("s")).select("node", "s.*")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays share at least 3/4 of their union."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return shingles.linked(both, len(x), len(y))


def _decided(pairs: DataFrame, docs: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """The pairs (a, b) that link, by intersecting sorted arrays of hashes. The arrays are
    shuffled by set, where they meet the groups that want them, and then by group."""
    n_pairs = pairs.count()
    if not n_pairs:
        return pairs.sparkSession.createDataFrame([], PAIR)
    # pairs stay with their end that has most, up to 256 of them, so that few arrays are
    # sent to several groups; a group holds about 256 pairs
    degree = _ends(pairs).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    side = lambda x: degree.select(F.col("node").alias(x), F.col("degree").alias(f"degree_{x}"))
    first = F.col("degree_a") >= F.col("degree_b")
    hub, other = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    chunk = F.pmod(F.xxhash64(other), F.ceil(F.greatest("degree_a", "degree_b") / 256))
    grouped = util.stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.pmod(F.xxhash64(hub, chunk), F.lit(-(-n_pairs // 256))).alias("group")))
    wanted = grouped.select("group", F.col("a").alias("node")).union(grouped.select("group", "b")).distinct()
    shipped = _fetched(docs, rows, _ends(pairs), seed).join(wanted, "node").select(*[F.col(c).alias(c) for c in ("group", "node", "members")])

    def decided(todo: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        util.memory_returned()
        arrays = {k: np.frombuffer(x, U64) for k, x in zip(have["node"], have["members"], strict=True)}
        out = [(a, b) for a, b in zip(todo["a"], todo["b"], strict=True) if _links(arrays[a], arrays[b])]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    out = util.stored(grouped.groupBy("group").cogroup(shipped.groupBy("group")).applyInPandas(decided, PAIR))
    util.dropped(grouped)
    return out


#: A partner's code is at most this much below a set's: 3/4 of its size.
BELOW = int(STEPS * np.log2(4 / 3)) + 1


def _open(big: DataFrame, labels: DataFrame) -> DataFrame:
    """(block, node, label, n, most, band) of the large blocks' sets that may still link
    with a set of another component there; blocks with the same such sets are one."""
    named = big.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    blocks = named.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("block")
    named = util.stored(named.join(blocks, "block", "left_semi").withColumn("band", F.floor(F.col("n") / F.lit(float(STEPS * np.log2(BAND)))).cast("int")))
    # linked sizes lie in the same band or in neighbouring ones
    bands = named.groupBy("block", "band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("most").alias("reach"), F.min("n").alias("least"), F.max("n").alias("greatest"))
    near = bands.select("block", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "low", "high", "reach", "least", "greatest")
    near = near.groupBy("block", "band").agg(F.collect_list(F.struct("low", "high", "reach", "least", "greatest")).alias("near"))  # three at most
    meets = lambda x: ((x["low"] != F.col("label")) | (x["high"] != F.col("label"))) & (x["reach"] >= F.col("n")) & (x["least"] <= F.col("most")) & (x["greatest"] + BELOW >= F.col("n"))
    some = named.join(near, ["block", "band"]).where(F.exists("near", meets)).drop("near")
    some = util.stored(some)
    util.dropped(named)
    one = some.groupBy("block").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("sum_2"), F.count(F.lit(1)).alias("size"))
    same = one.groupBy("sum", "sum_2", "size").agg(F.min("block").alias("as"), F.collect_list("block").alias("block")).select("as", F.explode("block").alias("block"))
    # a pair may first meet in any of them
    merged = some.join(same, "block").groupBy(F.col("as").alias("block"), "node").agg(F.first(F.struct("label", "n", "band")).alias("x"), F.max("most").alias("most"))
    return merged.select("block", "node", "x.label", "x.n", "most", "x.band")


def _tiled(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join the components within each block, found tile by tile."""
    width = rows.groupBy("block", "band").agg(F.sum(8 * F.pow(F.lit(2.0), F.col("n") / STEPS) + BITS_BYTES).alias("bytes")).withColumn("tiles", F.ceil(F.col("bytes") / TILE))
    # a block that fits in one tile needs no bands
    whole = width.groupBy("block").agg(F.sum("bytes").alias("all")).where(F.col("all") <= TILE).select("block", F.lit(True).alias("fits"))
    width = util.stored(width.join(whole, "block", "left").where("fits IS NULL").select("block", "band", "tiles"))
    placed = rows.join(whole, "block", "left").join(width, ["block", "band"], "left")
    placed = placed.withColumn("tile", F.when(F.col("fits"), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("tiles")))).withColumn("band", F.when(F.col("fits"), 0).otherwise(F.col("band")))
    placed = util.stored(placed.select("block", "band", "tile", "node", "label", "most", F.coalesce("fits", F.lit(False)).alias("fits")))
    tiles = width.select("block", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    other = tiles.select("block", F.col("band").alias("band_2"), F.col("tile").alias("tile_2"))
    tasks = tiles.join(other, "block").where("(band = band_2 AND tile <= tile_2) OR band_2 = band + 1")
    task = F.xxhash64("block", "band", "tile", "band_2", "tile_2")
    # a task's sets: side 0 meets side 1, and itself where both are the same tile
    twice = tasks.withColumn("task", task).withColumn("alone", F.expr("band = band_2 AND tile = tile_2"))
    left = twice.select("block", "band", "tile", "task", F.when(F.col("alone"), 2).otherwise(0).alias("side"))
    right = twice.where("NOT alone").select("block", F.col("band_2").alias("band"), F.col("tile_2").alias("tile"), "task", F.lit(1).alias("side"))
    cut = placed.where("NOT fits").join(left.union(right), ["block", "band", "tile"]).select("task", "side", "node", "label", "most")
    once = placed.where("fits").select(F.xxhash64("block").alias("task"), F.lit(2).alias("side"), "node", "label", "most")
    todo = once.union(cut).join(sets, "node").select(*[F.col(c).alias(c) for c in ("task", "side", "node", "label", "most", "n", "bits", "members")])

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        util.memory_returned()
        out, parent = [], {}

        def root(k: int) -> int:
            while (up := parent.get(k, k)) != k:
                k = up
            return k

        rows = rows.sort_values(["n", "node"], ignore_index=True)
        n, side, nodes = (rows[x].to_numpy() for x in ("n", "side", "node"))
        most = np.ceil(2 ** ((rows["most"].to_numpy() + 1) / STEPS)).astype(np.int64)
        label, bits = rows["label"].to_numpy().copy(), _grid(rows["bits"].tolist())
        arrays = [np.frombuffer(m, U64) for m in rows["members"]]
        upto = np.searchsorted(n, most, side="right")
        for i in range(len(rows)):
            j = np.arange(i + 1, upto[i])
            j = j[(label[j] != label[i]) & (most[j] >= n[i]) & ((side[j] != side[i]) | (side[i] == 2))]
            j = j[_may_link(n[i], n[j], bits[i], bits[j])]
            for k in j.tolist():
                mine, theirs = root(int(label[i])), root(int(label[k]))
                if theirs != mine and _links(arrays[i], arrays[k]):
                    out.append((nodes[i], nodes[k]))
                    parent[theirs] = mine
                    label[label == theirs] = mine
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    links = util.stored(todo.groupBy("task").applyInPandas(compared, PAIR))
    util.dropped(placed, width)
    return links


def _labels(docs: DataFrame, described: DataFrame, entries: int, seed: int) -> DataFrame:
    """(node, label) of all sets that have a link."""
    one = util.stored(described.where("n > 0").groupBy("node").agg(F.min("row_key").alias("row_key")))
    blocks = util.stored(_blocks(docs, _sketch(docs), seed, max(8, -(-entries // BUCKET))))
    big = blocks.where("kind = 1").select(F.col("a").alias("block"), F.col("b").alias("node"), "n", "most")
    pairs = util.stored(blocks.where("kind = 0").select("a", "b").union(_stars(big)).distinct())
    signed = util.stored(_fetched(docs, one, _ends(pairs), seed, arrays=False))
    bounded = util.stored(_bounded(pairs, signed))
    links = _decided(bounded, docs, one, seed)
    labels = graph.components(links)
    util.dropped(pairs, signed, bounded)
    rows = util.stored(_open(big, labels))
    util.dropped(blocks)
    if rows.isEmpty():
        return labels
    sets = util.stored(_fetched(docs, one, rows.select("node"), seed))
    more = _tiled(rows, sets)
    whole = labels if more.isEmpty() else graph.components(links.union(more))
    util.dropped(rows, sets, links, more, one)
    return whole


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay when one document of each component does: the one with
    the smallest id. Wordless rows stay. Rows that share that id and the text stay
    together; rows without an id stay where no row of their component has one. An empty
    table gives an empty result; all columns of df are kept, whatever their names."""
    stay_id, stay_hash = util.free_name(df, "stay_id", "stay_hash")
    stay = ngram_components(df, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(stay_id), F.col("text_hash").alias(stay_hash)).distinct()
    stay = util.stored(stay)
    if stay.count() <= util.MAX_BROADCAST:  # else both sides are shuffled
        stay = F.broadcast(stay)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(stay_id)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(stay_hash))
    return df.join(stay, same, "left_semi")


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (smallest id reachable by
    links), text_hash (xxhash64 of the text, so that rows can be told apart that share
    an id but not the text).

    Null and wordless texts have no shingles and link with nothing: their component is
    their own id. Null ids take part and are never the smallest, unless all are null.
    Repeated rows are equal sets and so linked. An empty table gives an empty result.
    """
    util.small_batches(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("text_hash", F.xxhash64("text")).withColumn("row_key", F.xxhash64("doc_id", "text_hash"))
    for seed in range(SEEDS):
        rows = util.stored(_described(docs, seed))
        named = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("check", "n")).alias("x"), F.max(F.struct("check", "n")).alias("y"))
        if named.where("x != y").isEmpty():
            break  # no two sets share a name
        util.dropped(rows)
    else:
        raise RuntimeError(f"sets share names under {SEEDS} seeds")
    entries = rows.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    labels = _labels(docs, rows, int(entries), seed)
    some = rows.where("n > 0").select("doc_id", "text_hash", "n", "node")
    # what joins and groups need of each set, then of each component; neither is joined
    # back to its rows by a shuffle on a hot key
    classes = util.stored(some.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).join(labels, "node", "left"))
    linked = util.stored(classes.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets")))
    joined = util.with_groups(classes.where("label IS NOT NULL").select("node", "label", "rows"), linked, ["label"], "sets").select("node", "component_id", "rows")
    groups = util.stored(joined.union(classes.where("label IS NULL AND rows > 1").select("node", "least", "rows")))
    full = util.with_groups(some, groups, ["node"], "rows").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash")
    return full.union(none)
