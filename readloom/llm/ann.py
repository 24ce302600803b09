"""Approximate nearest neighbours by shifted space-filling curves, made exact on demand.

1. Several Hilbert curves, each over its own projection and shift, order the vectors.
   Spark range-partitions each order; its partitions are cut into blocks of neighbouring
   keys, packed one to a row, with a centre and a radius.
2. A query searches its own block and the neighbouring ones on every curve; the lists
   merge and are reranked on the original vectors in double precision.
3. Blocks of the first curve that can still hold a nearer vector, by centre and radius,
   are searched too (complete=True): the stated query set against the blocks, AT_ONCE
   queries at a time, each pass written before the next. In data without clusters this
   reaches most blocks, and without it recall is low; the README gives figures.

Of equal vectors only the k + 1 smallest ids can be among a query's k nearest, so no
others enter a block: a very common vector fills none. They are found in two steps, the
first over salted parts of the rows.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import util

CURVES = 4
#: Projected dimensions and bits of each: 56 bits of key.
AXES = 8
DEPTH = 7
BLOCK = 512
#: Queries that are broadcast at a time: a fixed bound.
AT_ONCE = 4096
SEED = 20
#: Parts of the rows of one vector in the first of two steps.
SALTS = 64


def hilbert(cells: np.ndarray, depth: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points, (n, axes) below 2 ** depth. Every
    step of the walk visits a neighbouring cell."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    bit = 1 << (depth - 1)
    while bit > 1:
        low = bit - 1
        for i in range(axes):
            up = (x[i] & bit) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn, bit = np.zeros(x.shape[1], np.int64), 1 << (depth - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(depth - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> b & 1)
    return key


def projections(dim: int, curves: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For each curve an orthonormal map to AXES dimensions and a shift in [0, 1/2)."""
    rng = np.random.default_rng(seed)
    axes = min(AXES, dim)
    maps = np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :axes] for _ in range(curves)])
    return maps, rng.random((curves, axes)) / 2


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def sequential(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order, so equal vectors score alike."""
    return np.cumsum(x.astype(np.float64) * q.astype(np.float64), axis=1)[:, -1]


def best(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, near: np.ndarray, k: int, floor: float = -np.inf) -> tuple[list[int], list[float]]:
    """The k best of ids for one query, with approximate scores near, from floor up."""
    ok = np.flatnonzero((ids != own) & (near >= floor - 1e-9))
    if len(ok) > k:
        edge = np.partition(near[ok], len(ok) - k)[len(ok) - k]
        ok = ok[near[ok] >= edge - 1e-9]
    exact = sequential(q, x[ok])
    order = np.lexsort((ids[ok], -exact))[:k]
    return ids[ok][order].tolist(), exact[order].tolist()


HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])


def _merged(hits: DataFrame, k: int) -> DataFrame:
    """One list of the k best for each query."""
    pairs = F.flatten(F.collect_list(F.arrays_zip((F.transform("scores", lambda s: -s)).alias("away"), F.col("ids").alias("vec_id"))))
    return hits.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(pairs)), 1, k).alias("top"))


def valid(vector: Column) -> Column:
    """Not null, of some length, without null or non-finite components, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, complete: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product to each row
    where is_query holds, the row's own id left out, nearest first, ties to smaller ids.

    Null ids and vectors that are null, zero, or hold null or non-finite components take
    no part. Vectors of different length are not compared. Rows that repeat an id with the
    same vector count once; with several vectors, each vector counts as that id and the
    best one is listed. Fewer than k candidates are all listed. With complete=False only
    the curves' windows are searched. An empty table gives an empty result.
    """
    util.small_batches(df.sparkSession, BLOCK)
    vec = F.col(f"`{vector_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & valid(F.col("v"))).distinct()
    rows = util.stored(rows)
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())  # one job for each
    parts = [_of_length(rows.where(F.size("v") == n), n, k, curves, complete) for n in lengths]
    if not parts:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = parts[0]
    for p in parts[1:]:
        top = top.union(p)
    # an id with several vectors is listed once, with its best
    listed = top.select("query_id", F.explode("top").alias("hit")).groupBy("query_id", F.col("hit.vec_id").alias("vec_id")).agg(F.max(-F.col("hit.away")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return listed.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(rows: DataFrame, dim: int, k: int, curves: int, complete: bool) -> DataFrame:
    spark = rows.sparkSession
    maps, shifts = projections(dim, curves)
    axes = maps.shape[2]
    least = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for part in (["v", "salt"], ["v"]):
        order = F.row_number().over(Window.partitionBy(*part).orderBy("id"))
        least = least.withColumn("order", order).where(F.col("order") <= k + 1)
    least = util.stored(least.select("id", "v", "asks", "order"))
    others = rows.where("asks").join(least.select("id", "v"), ["id", "v"], "left_anti")
    some = least.union(others.select("id", "v", "asks", F.lit(k + 2)))
    wide = T.ArrayType(T.DoubleType())

    @F.arrow_udf(wide)
    def projected(v: pa.Array) -> pa.Array:
        x = _matrix(v).astype(np.float64)
        return pa.array(list(np.einsum("nd,cda->nca", x, maps).reshape(len(x), -1)), pa.list_(pa.float64()))

    table = util.stored(some.withColumn("place", projected("v")))
    spread = table.select(*[F.min(F.col("place")[i]).alias(f"lo{i}") for i in range(curves * axes)], *[F.max(F.col("place")[i]).alias(f"hi{i}") for i in range(curves * axes)]).first()
    low, high = (np.array(spread[i * curves * axes : (i + 1) * curves * axes]).reshape(curves, axes) for i in (0, 1))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keyed(place: pa.Array) -> pa.Array:
        p = _matrix(place).reshape(len(place), curves, axes) if len(place) else np.zeros((0, curves, axes))
        unit = (p - low) / np.maximum(high - low, 1e-300) / 2 + shifts
        cells = np.clip(unit * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64)
        return pa.array(list(np.stack([hilbert(cells[:, c], DEPTH) for c in range(curves)], axis=1)), pa.list_(pa.int64()))

    laid = table.select("id", "v", "asks", "order", F.posexplode(keyed("place")).alias("curve", "key"))
    laid = laid.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    names = ["ids", "vectors", "asks", "centre"]
    kind = T.StructType([T.StructField("curve", T.IntegerType()), T.StructField("block", T.LongType()), *[T.StructField(x, T.BinaryType()) for x in names], T.StructField("radius", T.DoubleType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, bool, int, np.ndarray]] = []

        def packed(rows_: list) -> pa.RecordBatch:
            nonlocal count
            x = np.stack([r[4] for r in rows_])
            centre = x.astype(np.float64).mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
            # a query that is not among the k + 1 smallest of its equals is no candidate
            ids = np.array([r[1] if r[3] <= k + 1 else -1 - r[1] for r in rows_], np.int64)
            count += 1
            return pa.record_batch(
                [pa.array([rows_[0][0]], pa.int32()), pa.array([part << 32 | count], pa.int64()), *[pa.array([b], pa.binary()) for b in (ids.tobytes(), x.astype(np.float64).tobytes(), np.array([r[2] for r in rows_]).tobytes(), centre.tobytes())], pa.array([radius])],
                ["curve", "block", *names, "radius"],
            )

        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("v")))
            column = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()
            for row in zip(column("curve"), column("id"), column("asks"), column("order"), x, strict=True):
                if held and (held[0][0] != row[0] or len(held) == BLOCK):
                    yield packed(held)
                    held = []
                held.append(row)
        if held:
            yield packed(held)

    blocks = util.stored(laid.select("curve", "id", "asks", "order", "v").mapInArrow(cut, kind))
    # the order of the blocks of each curve: a small table, one row for BLOCK vectors
    seq = util.stored(blocks.select("curve", "block").withColumn("seq", F.row_number().over(Window.partitionBy("curve").orderBy("block")).cast("long")))
    numbered = blocks.join(seq, ["curve", "block"])
    near = F.explode(F.array(*[F.col("seq") + d for d in (-1, 0, 1)]))
    ask = numbered.select("curve", near.alias("seq"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("asks").alias("q_asks"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, dim)
                q_ids, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vectors"]).reshape(-1, dim)
                asks = np.frombuffer(r["q_asks"], bool)
                q_ids, q, x, ids = np.maximum(q_ids, -1 - q_ids)[asks], q[asks], x[ids >= 0], ids[ids >= 0]
                if len(q) and len(ids):
                    score = q @ x.T
                    found += [(int(i), *best(q[j], i, ids, x, score[j], k)) for j, i in enumerate(q_ids.tolist())]
            yield _packed_hits(found)

    windows = numbered.select("curve", "seq", "ids", "vectors").join(ask, ["curve", "seq"])
    first = util.stored(_merged(windows.select("ids", "vectors", "q_ids", "q_vectors", "q_asks").mapInArrow(searched, HITS), k))
    if not complete:
        return first
    floor = F.when(F.size("top") >= k, -F.element_at("top", k)["away"]).otherwise(float("-inf"))
    asked = table.where("asks").select("id", F.col("v").cast(wide).alias("v")).join(first.select(F.col("query_id").alias("id"), floor.alias("floor")), "id", "left")
    asked = util.stored(asked.select("id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))
    one_curve = blocks.where("curve = 0").select("ids", "vectors", "centre", "radius")
    out = first.select("query_id", F.transform("top", lambda x: x["vec_id"]).alias("ids"), F.transform("top", lambda x: -x["away"]).alias("scores"))
    # the driver holds one pass of queries, and the plan does not grow with their number
    place, held = f"{util.shared_dir(spark)}/table-{uuid.uuid4().hex}", []

    def passed() -> None:
        if held:
            hits, sent = _rest(one_curve, held, dim, k)
            hits.write.mode("append").parquet(place)
            sent.destroy()
            held.clear()

    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == AT_ONCE:
            passed()
    passed()
    more = [spark.read.schema(HITS).parquet(place)] if not asked.isEmpty() else []
    for hits in more:
        out = out.union(hits)
    return _merged(out, k)


def _packed_hits(found: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.list_(pa.float64()))], HITS.names)


def _rest(blocks: DataFrame, asked: list, dim: int, k: int) -> tuple[DataFrame, Broadcast]:
    """The best of all blocks that can hold a vector as near as a query's k-th so far, and
    the broadcast that holds the queries."""
    sent = blocks.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in asked], np.int64), np.array([r["v"] for r in asked], np.float64).reshape(-1, dim), np.array([r["floor"] for r in asked])))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, floor = sent.value
        floor = floor.copy()
        norm = np.sqrt((q * q).sum(axis=1))
        kept: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                bound = q @ np.frombuffer(r["centre"]) + norm * r["radius"]
                want = np.flatnonzero(bound >= floor - 1e-9)
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, dim)
                x, ids = x[ids >= 0], ids[ids >= 0]
                if not len(want) or not len(ids):
                    continue
                score = q[want] @ x.T
                for j in np.flatnonzero(score.max(axis=1) >= floor[want] - 1e-9).tolist():
                    n = int(want[j])
                    got = best(q[n], int(q_ids[n]), ids, x, score[j], k, floor[n])
                    have = kept.setdefault(n, [])
                    have += [(-s, i) for i, s in zip(*got, strict=True)]
                    have.sort()
                    del have[k:]
                    if len(have) == k:
                        floor[n] = max(floor[n], -have[-1][0])
        yield _packed_hits([(int(q_ids[n]), [i for _, i in x], [-s for s, _ in x]) for n, x in kept.items()])

    return blocks.mapInArrow(searched, HITS), sent
