"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is a polynomial in its UTF-8 bytes modulo 2**31 - 1, at two
points, with the byte length. Chunks of CHUNK bytes are hashed side by side in one
matrix product, and neighbouring chunks combine by length-shifted arithmetic:
H(ab) = H(a) * x ** len(b) + H(b). Texts with equal fingerprints are then compared
chunk by chunk: each chunk is a grouping key, so that equal chunks meet in the map-side
hash table and one row for each distinct chunk is shuffled, however large the group.
Fingerprints under which chunks differ (collisions) are split by the whole text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from . import util

MOD = 2**31 - 1
#: Two evaluation points, any numbers in 2 .. MOD - 2.
POINTS = (1_103_515_245, 1_566_083_941)
CHUNK = 1024
#: Characters of one compared chunk.
COMPARED = 1 << 16


def shift(point: int, length: int) -> int:
    """The factor that moves a hash past `length` more bytes."""
    return pow(point, length, MOD)


def combined(a: int, b: int, length_b: int, point: int) -> int:
    """Hash of two neighbouring pieces from the hashes of each."""
    return (a * shift(point, length_b) + b) % MOD


def _chunk_weights() -> np.ndarray:
    columns = []
    for x in POINTS:
        p = np.array([pow(x, CHUNK - 1 - i, MOD) for i in range(CHUNK)], np.int64)
        columns += [p >> 16, p & 0xFFFF]  # halves, so that float64 sums stay exact
    return np.stack(columns, axis=1).astype(np.float64)


_WEIGHTS = _chunk_weights()


def hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hash at both points of every text of a batch."""
    out = np.zeros((2, len(offsets) - 1), np.uint64)
    for a, b in util.slabs(data, offsets):
        length = offsets[a + 1 : b + 1] - offsets[a:b]
        chunks = -(-length // CHUNK)
        total = int(chunks.sum())
        if not total:
            continue
        # zero bytes in front leave the polynomial as it is
        padded = np.zeros(total * CHUNK, np.uint8)
        end = np.cumsum(chunks) * CHUNK
        move = np.repeat(end - offsets[a + 1 : b + 1], length)
        padded[np.arange(offsets[a], offsets[b]) + move] = data[offsets[a] : offsets[b]]
        part = np.concatenate([m.astype(np.float64) @ _WEIGHTS for m in np.array_split(padded.reshape(total, CHUNK), -(-total // 1024))]).astype(np.uint64)
        left = np.repeat(np.cumsum(chunks), chunks) - 1 - np.arange(total)  # chunks that follow
        some, begin = chunks > 0, np.cumsum(chunks) - chunks
        for k, x in enumerate(POINTS):
            h = ((part[:, 2 * k] % MOD << np.uint64(16)) + part[:, 2 * k + 1]) % MOD
            step = shift(x, CHUNK)
            table = np.ones(int(chunks.max()), np.uint64)
            for i in range(1, len(table)):
                table[i] = int(table[i - 1]) * step % MOD
            sums = np.add.reduceat(h * table[left] % MOD, begin[some])
            out[k, a:b][some] = sums % MOD
    return out[0], out[1]


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in ("h1", "h2", "size")]))
def fingerprint(texts: pa.Array) -> pa.Array:
    data, offsets = util.utf8(texts)
    h1, h2 = hashes(data, offsets)
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (h1, h2, np.diff(offsets))], ["h1", "h2", "size"])


def normalised(text: Column) -> Column:
    """Null is empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(util.text_or_empty(text), util.SPACE, " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_columns: list[str] | None = None) -> DataFrame:
    """df (or its keep_columns) with keep_id, group_size, kept and text_sha256.

    Rows are equal if their normalised texts are; null counts as empty, and empty texts
    equal each other. The smallest id of a group stays; null ids come last; of repeated
    rows with that id one stays. An empty table gives an empty result. If df has a column
    of one of the new names, it is replaced. Very long texts are hashed in chunks.
    """
    util.small_batches(df.sparkSession)
    names = ["keep_id", "group_size", "kept", "text_sha256"]
    columns = [c for c in (keep_columns or df.columns) if c not in names]
    inner = ["row_id", "norm", "h1", "h2", "size", "tie", "first_id", "rows_in", "fp", "split", "turn", "chunk_no", "chunk"]
    row_id, norm, h1, h2, size, tie, first, rows_in, fp, split, turn, chunk_no, chunk = util.free_name(df, *inner)
    key = [h1, h2, size]
    named = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{id_col}`").alias(row_id), normalised(F.col(f"`{text_col}`")).alias(norm))
    named = named.withColumn(fp, fingerprint(norm)).select("*", *[F.col(f"{fp}.{x}").alias(y) for x, y in zip(("h1", "h2", "size"), key, strict=True)]).drop(fp)
    slim = util.stored(named.select(row_id, *key))
    grouped = lambda rows, by: rows.groupBy(*by).agg(F.min(row_id).alias(first), F.count(F.lit(1)).alias(rows_in)).where(F.col(rows_in) > 1)
    groups = util.stored(grouped(slim, key))
    # the grouping compares the chunks themselves
    pieces = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.length(norm) / COMPARED).cast("int")), lambda i: F.substr(F.col(norm), i * COMPARED + 1, F.lit(COMPARED)))).alias(chunk_no, chunk)
    repeated = util.with_groups(named.select(*key, norm), groups, key, rows_in).where(F.col(rows_in).isNotNull())
    variants = repeated.select(*key, pieces).groupBy(*key, chunk_no, chunk).agg(F.lit(1).alias("one"))
    collided = util.stored(variants.groupBy(*key, chunk_no).count().where("count > 1").select(*key).distinct())
    if not collided.isEmpty():
        by = [*key, tie]
        mark = collided.withColumn(split, F.lit(True))
        tied = lambda rows: rows.join(mark, key, "left").withColumn(tie, F.when(F.col(split), F.col(norm)).otherwise("")).drop(split)
        named = tied(named)
        groups = util.stored(grouped(named, by))
        key = by
    rows = util.with_groups(named, groups, key, rows_in)
    # of rows that repeat the id that stays, one does; mostly there are none
    alike = slim.groupBy(*key[:3], row_id).agg(F.count(F.lit(1)).alias(rows_in)).where(F.col(rows_in) > 1)
    mine = F.col(rows_in).isNull() | F.col(row_id).eqNullSafe(F.col(first))
    if alike.isEmpty():
        rows = rows.withColumn(turn, F.lit(1))
    else:
        many = mine & F.col(rows_in).isNotNull()
        here = rows.where(many).withColumn(turn, F.row_number().over(Window.partitionBy(*key, row_id).orderBy(row_id)))
        rows = here.unionByName(rows.where(~many).withColumn(turn, F.lit(1)))
    keep_id = F.when(F.col(rows_in).isNull(), F.col(row_id)).otherwise(F.col(first)).alias("keep_id")
    return rows.select(
        *[F.col(f"`{c}`") for c in columns], keep_id, F.coalesce(F.col(rows_in), F.lit(1).cast("long")).alias("group_size"), (mine & (F.col(turn) == 1)).alias("kept"), F.sha2(norm, 256).alias("text_sha256")
    )
