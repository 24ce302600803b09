"""Exact top-k by inner product over an impact-ordered index, a score at a time.

Components become integers, floor(scale * x). Spark packs the vectors into tiles. A tile holds
postings (vector, value) by dimension, in segments by quantised impact: the value's size in
half bits. For each level of impact it keeps what of every vector's length lies below that level.

Queries pass in blocks. A block and a tile are searched level by level, in descending impact;
after each, a vector's score is at most what it has so far plus the query's length times the
vector's rest. Once few pairs can still reach their query's k-th best score, these, and only
these, are scored exactly from the whole vectors; until that is proved the next level follows.

Every block of queries must meet every tile. Tiles are dealt into groups of a few, and each
block goes to every group once. A task reads its group's tiles, then passes the blocks along
them one by one; nothing passes through the driver.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import util

#: Vectors of a tile and queries of a block.
TILE = 2048
BLOCK = 256
#: Tiles of a group, on average: a task holds them all, some 2 MB each.
HELD = 4
#: Pairs are scored exactly once they are at most this share of all.
FEW = 1 / 32
NONE = np.iinfo(np.int64).min

_TILES = T.StructType(
    [
        T.StructField("tile", T.LongType()), T.StructField("dim", T.IntegerType()),
        *[T.StructField(c, T.BinaryType()) for c in ("ids", "vectors", "docs", "segments", "rests")],
        T.StructField("asked", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("floor", T.LongType()), T.StructField("vector", T.BinaryType())]))),
    ]
)
_BLOCKS = T.StructType([T.StructField("dim", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("ids", "vectors", "floors")]])
_HITS = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])


def postings(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors (n, dim): vector numbers by descending level, then dimension; segments
    (level's number, dimension, end); and lengths (levels, n) of what lies below each level."""
    part, level = np.frexp(np.abs(x).astype(np.float64))
    level = 2 * level + (part >= 0.5**0.5)  # half bits
    doc, dim = np.nonzero(x)
    own = level[doc, dim]
    order = np.lexsort((doc, dim, -own))
    doc, dim, own = doc[order], dim[order], own[order]
    present = np.unique(own)[::-1]
    number = np.searchsorted(-present, -own)
    edge = np.flatnonzero(np.diff(number * x.shape[1] + dim, append=-1))
    segments = np.stack([number[edge], dim[edge], edge + 1], axis=1)
    square = x.astype(np.float64) ** 2
    # the sums are rounded up, so that the bound holds
    rests = np.array([np.sqrt((square * (level < p)).sum(axis=1)) * (1 + 1e-12) for p in present]).reshape(len(present), len(x))
    return doc.astype(np.uint16 if len(x) <= 1 << 16 else np.uint32), segments.astype(np.int64), rests


def top(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of each query, best first; ties by smaller id, an id once."""
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, scores = query[new], ids[new], scores[new]
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[keep], scores[keep]


class Best:
    """A block's queries, and for each its best pairs so far and the score that a pair must
    reach to be among them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.vectors, self.floors, self.k = ids, vectors, floors.copy(), k
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.pairs = (np.zeros(0, np.int64),) * 3

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = (scores >= self.floors[query]) & (ids != self.ids[query])
        more = (query[ok], ids[ok], scores[ok])
        self.pairs = top(*[np.concatenate(x) for x in zip(self.pairs, more, strict=True)], self.k)
        query, _, scores = self.pairs
        full = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == self.k - 1)
        self.floors[query[full]] = np.maximum(self.floors[query[full]], scores[full])


def searched(best: Best, ids: np.ndarray, x: np.ndarray, docs: np.ndarray, segments: np.ndarray, rests: np.ndarray) -> int:
    """Adds a tile's vectors to a block's best; returns how many postings were processed."""
    q = np.ascontiguousarray(best.vectors.T)
    reached = np.zeros((len(x), len(best.ids)), np.int64)
    at = done = 0
    for level, rest in enumerate(rests):
        while at < len(segments) and segments[at, 0] == level:
            _, dim, end = segments[at]
            held = docs[done:end]
            reached[held] += x[held, dim][:, None] * q[dim]
            at, done = at + 1, end
        if 2 * done < len(docs) and level + 1 < len(rests):
            continue  # too early to prove much
        bound = best.floors - (np.outer(rest, best.norms) * (1 + 1e-9) + 1)  # as real numbers, with room for rounding
        doc, query = np.nonzero(reached >= bound)
        if len(doc) <= FEW * reached.size:
            break
    else:  # all levels are summed: the scores are exact
        doc, query = np.nonzero(reached >= best.floors)
        best.add(query, ids[doc], reached[doc, query])
        return done
    for a in range(0, len(doc), 1 << 14):
        d, n = doc[a : a + (1 << 14)], query[a : a + (1 << 14)]
        best.add(n, ids[d], (x[d] * best.vectors[n]).sum(axis=1))
    return done


def _cut(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Tiles of a partition's vectors, those of one length together, with their queries and
    the k-th best score that each has in its own tile."""
    part, count = TaskContext.get().partitionId(), 0
    held: dict[int, list] = {}

    def packed(dim: int) -> pa.RecordBatch:
        nonlocal count
        ids, x, asks = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
        docs, segments, rests = postings(x)
        mine = Best(ids[asks], x[asks], np.full(int(asks.sum()), NONE), k)
        searched(mine, ids, x, docs, segments, rests)
        asked = [{"id": i, "floor": f, "vector": v.tobytes()} for i, f, v in zip(mine.ids.tolist(), mine.floors.tolist(), mine.vectors, strict=True)]
        count += 1
        cells = [ids, x, docs, segments, rests]
        return pa.record_batch([pa.array([part << 32 | count], pa.int64()), pa.array([dim], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells], pa.array([asked], _ASKED)], _TILES.names)

    for batch in batches:
        ids, asks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        size, flat = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        for dim in np.unique(size).tolist():
            rows = np.flatnonzero(size == dim)
            while len(rows):
                room = TILE - sum(len(h[0]) for h in held.get(dim, []))
                some, rows = rows[:room], rows[room:]
                held.setdefault(dim, []).append((ids[some], flat[start[some][:, None] + np.arange(dim)], asks[some]))
                if len(some) == room:
                    yield packed(dim)
    for dim in list(held):
        yield packed(dim)


_ASKED = pa.list_(pa.struct([("id", pa.int64()), ("floor", pa.int64()), ("vector", pa.binary())]))


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's queries (dim, id, floor, vector)."""
    held: dict[int, list[dict]] = {}

    def packed(dim: int) -> pa.RecordBatch:
        rows = held.pop(dim)
        cells = [np.array([r["id"] for r in rows]).tobytes(), b"".join(r["vector"] for r in rows), np.array([r["floor"] for r in rows]).tobytes()]
        return pa.record_batch([pa.array([dim], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], _BLOCKS.names)

    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["dim"], []).append(row)
            if len(held[row["dim"]]) == BLOCK:
                yield packed(row["dim"])
    for dim in list(held):
        yield packed(dim)


def _paired(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best pairs of each block over the tiles of its group; these come first."""
    group, tiles = None, []

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if group != (row["group"], row["dim"]):
                group, tiles = (row["group"], row["dim"]), []
            ids = np.frombuffer(row["ids"], np.int64)
            x = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["dim"])
            if row["floors"] is None:
                segments = np.frombuffer(row["segments"], np.int64).reshape(-1, 3)
                levels = int(segments[-1, 0]) + 1 if len(segments) else 0
                docs = np.frombuffer(row["docs"], np.uint16 if len(ids) <= 1 << 16 else np.uint32)
                tiles.append((ids, x, docs, segments, np.frombuffer(row["rests"]).reshape(levels, len(ids))))
                continue
            best = Best(ids, x, np.frombuffer(row["floors"], np.int64), k)
            for tile in tiles:
                searched(best, *tile)
            query, found, scores = best.pairs
            yield pa.record_batch([pa.array(best.ids[query]), pa.array(found), pa.array(scores)], _HITS.names)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, in double precision; null where the vector is null,
    a component is null or not finite, or the length's square exceeds 2 ** 62."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floors = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    size = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double") * scale) + 1, F.lit(2.0)))
    return F.when(finite & (size <= float(1 << 62)), floors)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, the k rows of
    largest integer inner product of floor(scale * component), ranks from 1, ties by smaller
    id. The result is exact.

    Null ids, and vectors that are null or hold null or non-finite components, take no part,
    nor do those longer than 2 ** 31, whose products need not fit a long. Vectors of different
    length are not compared; empty ones score 0 with each other. Rows of the query's own id
    are no candidates. Rows that repeat an id and a vector count once; an id with several
    vectors is listed once, with its best pair. Fewer than k candidates are all listed. An
    empty table gives an empty result; extra columns take no part.
    """
    spark = df.sparkSession
    util.small_batches(spark)  # a tile or a block is a row of its own
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole(F.col(f"`{vector_col}`"), scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull()).groupBy("id", "x").agg(F.max("asks").alias("asks"))
    tiles = util.stored(rows.mapInArrow(lambda batches: _cut(batches, k), _TILES))
    asked = tiles.select("dim", F.explode("asked").alias("q")).select("dim", "q.id", "q.floor", "q.vector")
    n = asked.count()
    blocks = util.stored(asked.repartition(max(1, -(-n // BLOCK))).mapInArrow(_blocked, _BLOCKS))
    some = tiles.count()
    groups = max(1, -(-some // HELD), min(some, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = tiles.drop("asked").withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int")).drop("tile")
    dealt = right.unionByName(left, allowMissingColumns=True).repartitionById(groups, "group")
    hits = dealt.sortWithinPartitions("group", "dim", F.col("floors").isNotNull()).mapInArrow(lambda batches: _paired(batches, k), _HITS)
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
