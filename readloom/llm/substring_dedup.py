"""Substring dedup by relative Lempel-Ziv factors.

Every document is reference and target at once. The reference is cut into blocks around
anchors: of the short word grams of each window, the one with the least hash. Equal
windows have equal anchors, so the index of an anchor's blocks holds every place at
which a window could start again. A block is the run of windows under one anchor; each
is parsed greedily against all others of its index. A factor begins at the first window
that another place has too and is the longest run of windows from there that some other
place repeats: the places are sorted by what follows, and a place's longest match is the
one with a neighbour. At both ends of a factor, the first and the last word are compared as well.
The next factor starts at the first window after it, which may overlap its last words.
A factor's words, up to the end of its last window, are a duplicate span; factors that
meet at a border merge.

1. Anchors are counted, packed by hash range, and those of more than one place set bits
   in a filter of fixed size, which is broadcast.
2. Blocks under such an anchor are dealt out by it, in packed arrays; of an anchor with
   very many blocks, each window is a block and goes by its own hash. Within a task,
   blocks that repeat are settled at once and one marker stands for each window, so a
   passage in very many documents sends a bounded number of rows from each task.
3. Buckets parse their blocks, and spans go back to their documents.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import util

U64 = np.uint64
WINDOW = 35
SLICES = 64
#: The filter has SLICES times as many bits: 16 MB, a fixed bound.
SLICE_BITS = 1 << 21
#: Characters of text for each bucket, about.
BUCKET_CHARS = 8_000_000
HELD = 1_000_000
#: An anchor is hot with so many blocks, or one in so many characters of all texts, which
#: bounds the list of hot anchors to a million.
HOT, HOT_CHARS = 20_000, 60_000_000
#: Filters that one task unites.
UNITED = 256


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value among each `width` consecutive ones."""

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[a] <= g[b], a, b)

    at, reach = np.arange(len(g)), 1
    while 2 * reach <= width:
        at = lesser(at[:-reach], at[reach:])
        reach *= 2
    rest = width - reach
    return lesser(at[:-rest], at[rest:]) if rest else at


def windows(data: np.ndarray, offsets: np.ndarray, width: int):
    """For each window of a batch of texts: its text, first word, hash, anchor, the
    anchor's place, and short codes of its first and last word. Windows do not cross texts."""
    word, _, _, first = util.words(data, offsets, lower=False)
    short = width // 2 + 1
    z = np.zeros(0, np.int64)
    if len(word) < width:
        return z, z, z.astype(U64), z.astype(U64), z, z.astype(np.uint32)
    g = util.grams(word, short)
    place = _least(g, width - short + 1)
    start = np.arange(len(word) - width + 1)
    text = np.searchsorted(first, start, side="right") - 1
    inside = start + width <= first[text + 1]
    start, text, place = start[inside], text[inside], place[inside]
    edges = (word[start] >> U64(48) << U64(16) | word[start + width - 1] >> U64(48)).astype(np.uint32)
    return text, start - first[text], util.grams(word, width)[start], g[place], place, edges


def _slot(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = ((anchor >> U64(8)) % U64(buckets)).astype(np.int64)
    return bucket, bucket % SLICES * SLICE_BITS + ((anchor >> U64(40)) % U64(SLICE_BITS)).astype(np.int64)


def _filter(docs: DataFrame, width: int, buckets: int, hot_from: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the anchors that occur at more than one place, and by chance of others; and
    the hot anchors, sorted."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            bucket, _ = _slot(value, buckets)
            order = np.argsort(bucket, kind="stable")
            value, count, bucket = value[order], count[order], bucket[order]
            cut = _runs(bucket)
            parts = []
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(value)], strict=True):
                often = count[i:j] > 2
                twice = np.repeat(value[i:j], np.minimum(count[i:j], 2))
                parts.append((twice.tobytes(), value[i:j][often].tobytes(), count[i:j][often].tobytes()))
            return pa.record_batch([pa.array(bucket[cut]), *[pa.array(x, pa.binary()) for x in zip(*parts, strict=True)]], kind.names)

        for batch in batches:
            data, offsets = util.utf8(batch.column(0))
            for a, b in util.slabs(data, offsets):
                *_, anchor, place, _ = windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                held.append(anchor[np.r_[True, place[1:] != place[:-1]]] if len(place) else anchor)
                size += len(held[-1])
            if size > HELD:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    def marked(rows: pd.DataFrame) -> pd.DataFrame:
        value = np.sort(np.frombuffer(b"".join(rows["anchors"]), U64))
        bucket, slot = _slot(value[1:][value[1:] == value[:-1]], buckets)
        bits = np.zeros(SLICE_BITS, bool)
        bits[slot % SLICE_BITS] = True
        often, inverse = np.unique(np.frombuffer(b"".join(rows["often"]), U64), return_inverse=True)
        total = np.bincount(inverse, np.frombuffer(b"".join(rows["times"]), np.int64), len(often))
        number = int(rows["bucket"].iloc[0])
        return pd.DataFrame({"slice": [number % SLICES], "branch": [number // SLICES // UNITED], "bits": [np.packbits(bits).tobytes()], "hot": [often[total >= hot_from].tobytes()]})

    def united(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SLICE_BITS // 8, np.uint8)
        for x in rows["bits"]:
            bits |= np.frombuffer(x, np.uint8)
        return rows.iloc[:1].assign(bits=[bits.tobytes()], hot=[b"".join(rows["hot"])])

    kind = T.StructType([T.StructField("bucket", T.LongType()), *[T.StructField(x, T.BinaryType()) for x in ("anchors", "often", "times")]])
    sliced = T.StructType([T.StructField("slice", T.LongType()), T.StructField("branch", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("hot", T.BinaryType())])
    rows = docs.select("text").mapInArrow(anchors, kind).groupBy("bucket").applyInPandas(marked, sliced)
    # united in two steps, so that no task takes all filters of a slice
    rows = rows.groupBy("slice", "branch").applyInPandas(united, sliced).groupBy("slice").applyInPandas(united, sliced)
    out, hot = np.zeros(SLICES * SLICE_BITS // 8, np.uint8), [np.zeros(0, U64)]
    for r in rows.collect():  # SLICES rows of fixed size, and the hot anchors
        out[r["slice"] * SLICE_BITS // 8 : (r["slice"] + 1) * SLICE_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
        hot.append(np.frombuffer(r["hot"], U64))
    return out, np.sort(np.concatenate(hot))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys, the last one first; equal keys have equal ranks."""
    order = np.lexsort(keys)
    cut = _runs(*[k[order] for k in keys])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(order)]))
    return rank


def factors(block: np.ndarray, h: np.ndarray, edges: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy parse of blocks against each other: (first, last) windows of the factors, as
    indexes. block: the block of each window, in order; h, edges: a window's hash and the
    codes of its outer words; known: hashes of windows that other tasks settled, each of
    which makes factors of one window."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.r_[np.flatnonzero(np.diff(block)) + 1, len(h)]
    left = left[np.searchsorted(left, np.arange(len(h)), side="right")] - np.arange(len(h))  # windows up to the block's end
    # ranks of the runs of 1, 2, 4 .. windows, or fewer at a block's end
    ranks, width = [_numbered(edges, h)], 1
    while width < left.max():
        after = np.full(len(h), -1, np.int64)
        inside = np.flatnonzero(left > width)
        after[inside] = ranks[-1][inside + width]
        ranks.append(_numbered(after, ranks[-1]))
        width *= 2
    # places in order of what follows; neighbours share the longest runs
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = np.minimum(a + shared, len(h) - 1), np.minimum(b + shared, len(h) - 1)
        shared += (np.minimum(left[a], left[b]) - shared >= 1 << k) * (ranks[k][i] == ranks[k][j]) << k
    length = np.zeros(len(h), np.int64)
    length[a] = shared
    length[b] = np.maximum(length[b], shared)
    length = np.maximum(length, np.isin(h, known) if len(known) else 0)
    first, last, at = [], [], 0
    starts = np.flatnonzero(length > 0)
    while True:
        i = int(np.searchsorted(starts, at))
        if i == len(starts):
            return np.array(first, np.int64), np.array(last, np.int64)
        at = int(starts[i])
        first.append(at)
        at += int(length[at])
        last.append(at - 1)


SPANS = T.StructType([T.StructField(x, T.LongType()) for x in ("k1", "k2", "first", "last")])


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(k1, k2, first, last): factors, as the first words of their first and last window,
    of the text with key (k1, k2). docs: k1, k2, text."""
    chars = int(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    buckets = SLICES * max(1, -(-chars // (BUCKET_CHARS * SLICES)))
    sent = docs.sparkSession.sparkContext.broadcast(_filter(docs, width, buckets, max(HOT, chars // HOT_CHARS)))
    arrays = {"keys": np.int64, "starts": np.int64, "counts": np.int64, "hashes": U64, "edges": np.uint32, "known": U64, "done": np.int64}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (mask, hot), held, size = sent.value, [], 0
        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            data, offsets = util.utf8(batch.column(2))
            for a, b in util.slabs(data, offsets):
                text, start, h, anchor, place, edges = windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                bucket, slot = _slot(anchor, buckets)
                maybe = (mask[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
                text, start, h, anchor, place, edges, bucket = (x[maybe] for x in (text, start, h, anchor, place, edges, bucket))
                if not len(h):
                    continue
                if len(hot):
                    often = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
                    place, bucket = np.where(often, -1 - np.arange(len(h)), place), np.where(often, _slot(h, buckets)[0], bucket)
                new = np.ones(len(h), bool)
                new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
                held.append((key[text + a], start, h, edges, bucket, np.cumsum(new)))
                size += len(h)
            if size > HELD:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        base = np.cumsum([0, *[x[5][-1] for x in held]])
        block = np.concatenate([x[5] + b for x, b in zip(held, base, strict=False)])
        key, start, h, edges, bucket = (np.concatenate([x[i] for x in held]) for i in range(5))
        # what repeats here is settled; a marker for each window tells the others
        first, last = factors(block, h, edges, np.zeros(0, U64))
        done = np.concatenate([key[first], start[first, None], start[last, None]], axis=1)
        over = np.zeros(len(h) + 1, np.int64)
        np.add.at(over, first, 1)
        np.add.at(over, last + 1, -1)
        settled = np.cumsum(over[:-1]) > 0
        marker, at = np.unique(h[settled], return_index=True)
        marker_bucket = bucket[settled][at]
        key, start, h, edges, bucket, block = (x[~settled] for x in (key, start, h, edges, bucket, block))
        cut = _runs(block, start - np.arange(len(start))) if len(start) else np.zeros(0, np.int64)
        length = np.diff(np.r_[cut, len(start)])
        rows = np.union1d(bucket[cut], marker_bucket) if len(cut) or len(marker) else np.zeros(1, np.int64)

        def by_bucket(of: np.ndarray, *values: np.ndarray) -> list[list[bytes]]:
            order = np.argsort(of, kind="stable")
            low, high = (np.searchsorted(of[order], rows, side=x).tolist() for x in ("left", "right"))
            return [[np.ascontiguousarray(v[order[i:j]]).tobytes() for i, j in zip(low, high, strict=True)] for v in values]

        share = np.arange(len(done)) * len(rows) // max(len(done), 1)  # settled factors pass through
        out = [*by_bucket(bucket[cut], key[cut], start[cut], length), *by_bucket(bucket, h, edges), *by_bucket(marker_bucket, marker), *by_bucket(rows[share], done)]
        return pa.record_batch([pa.array(rows, pa.int64()), *[pa.array(x, pa.binary()) for x in out]], ["bucket", *arrays])

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        keys, start, length, h, edges, known, done = (np.frombuffer(b"".join(rows[x]), kind) for x, kind in arrays.items())
        block = np.repeat(np.arange(len(start)), length)
        word = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(len(h))
        first, last = factors(block, h, edges, np.unique(known))
        found = np.concatenate([keys.reshape(-1, 2)[block[first]], word[first, None], word[last, None]], axis=1)
        out = np.concatenate([found, done.reshape(-1, 4)])
        return pd.DataFrame({n: out[:, i] for i, n in enumerate(SPANS.names)})

    kind = T.StructType([T.StructField("bucket", T.LongType()), *[T.StructField(x, T.BinaryType()) for x in arrays]])
    return docs.select("k1", "k2", "text").mapInArrow(dealt, kind).groupBy("bucket").applyInPandas(met, SPANS)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Factors (from, to) in words, in order; those that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """df (or its columns in carry) with n_words, n_removed, spans (from, to: words of the
    text) and kept_text, the words left joined by one space.

    Words are runs of other than ASCII white space, unchanged. A window of `width` words
    counts as repeated if the same words start anywhere else, in the same text or another,
    repeated rows included. Null and short texts have no window and keep all words. An
    empty table gives an empty result; columns with the new names are replaced. Words are
    compared by hashes: 64 bits for each window and 32 for its outer words.
    """
    util.small_batches(df.sparkSession)
    new = ["n_words", "n_removed", "spans", "kept_text"]
    columns = [c for c in (carry or df.columns) if c not in new]
    k1, k2, text, found = util.free_name(df, "k1", "k2", "text_in", "found")
    named = df.select(*[F.col(f"`{c}`") for c in columns], util.text_or_empty(F.col(f"`{text_col}`")).alias(text), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-1)).alias(k1))
    named = named.withColumn(k2, F.xxhash64(text))
    runs = repeated_windows(named.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(text).alias("text")), width)
    # equal rows of one id have equal spans, which all find: each counts once
    spans = runs.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set(F.struct("first", (F.col("last") + width).alias("last"))).alias(found))
    kind = T.StructType(
        [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField("kept_text", T.StringType())]
    )

    @F.arrow_udf(kind)
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        data, offsets = util.utf8(texts)
        out = []
        for i, list_ in enumerate(lists.to_pylist()):
            words = data[offsets[i] : offsets[i + 1]].tobytes().split()
            spans = merged([(x["first"], x["last"]) for x in list_ or []])
            left, at = [], 0
            for a, b in spans:
                left += words[at:a]
                at = b
            left += words[at:]
            out.append({"n_words": len(words), "n_removed": len(words) - len(left), "spans": [{"start": a, "stop": b} for a, b in spans], "kept_text": b" ".join(left).decode()})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_text", pa.string())]))

    (made,) = util.free_name(df, "made")
    joined = named.join(spans, [k1, k2], "left").withColumn(made, cut(text, found))
    return joined.select(*[F.col(f"`{c}`") for c in columns], *[F.col(f"{made}.{x}").alias(x) for x in new])
