"""Ranked lexical search: the best documents for each item of a query set.

1. Segments: tasks cut documents into segments of SEGMENT rows and keep, for each term of the
   items, a bitmap of the segment's documents that hold it, and its occurrences in them.
   Counts over all segments give the statistics that weights need.
2. Search: in each segment, the bitmaps of an item's terms give every document the mask of
   the terms it matches. Documents with one mask form a group, whose score is bounded by the
   sum of the segment's largest impacts. Groups are scored by descending bound, until it is
   below the k-th best score that the task has found for the item so far.

Items are a stated query set: they pass in blocks of AT_ONCE items and BLOCK_BYTES of text,
and only a block's terms are broadcast. Documents are shuffled nowhere; k rows for each item
leave a task.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import util

SEGMENT = 4096
AT_ONCE = 1024
BLOCK_BYTES = 4 << 20
#: Bytes of terms: digits, letters, and all bytes of characters beyond ASCII.
LETTERS = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Weight of a document's length in its scores, in parts of a hundred.
LENGTH = 75


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order, with repeats; only A-Z is lower-cased."""
    return _TERM.findall((text or "").encode().lower())


class Vocabulary:
    """Terms by number, found in texts by their hash and proved by their bytes."""

    def __init__(self, terms: list[bytes]):
        at = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        data = np.frombuffer(b"".join(terms), np.uint8)
        order = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, util.U64)
        if terms:
            hashes = util.words(data, at, lower=False, letters=LETTERS)[0]
            order = np.argsort(hashes)
            self.hashes = hashes[order]
            if (self.hashes[1:] == self.hashes[:-1]).any():
                raise ValueError("two terms share a hash")
        self.order, self.at, self.data = order, at, data

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch of texts: the words of each, and text and number of each known term."""
        hashes, begin, end, first = util.words(data, offsets, lower=True, letters=LETTERS)
        size = np.diff(first)
        if not len(self.hashes) or not len(hashes):
            return size, np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[place] == hashes)
        term = self.order[place[hit]]
        begin, length = begin[hit], end[hit] - begin[hit]
        same = length == self.at[term + 1] - self.at[term]
        hit, term, begin, length = hit[same], term[same], begin[same], length[same]
        run = np.repeat(np.cumsum(length) - length, length)
        step = np.arange(len(run)) - run
        found = data[np.repeat(begin, length) + step]
        found = found + (((found >= 65) & (found <= 90)).astype(np.uint8) << 5)
        wrong = found != self.data[np.repeat(self.at[term], length) + step]
        ok = np.add.reduceat(wrong, np.cumsum(length) - length) == 0 if len(length) else np.zeros(0, bool)
        text = np.searchsorted(first, hit[ok], side="right") - 1
        return size, text, term[ok]


SEGMENTS = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("n_docs", "n_terms")],
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("terms", "holders")],
        *[T.StructField(c, T.BinaryType()) for c in ("ids", "nulls", "sizes", "bitmaps", "counts")],
    ]
)


def _segment(held: list[tuple]) -> pa.RecordBatch:
    """One row of documents (ids, null ids, sizes) and postings (document, term, count). Documents
    without a known term only enter the statistics."""
    base = np.cumsum([0, *[len(h[0]) for h in held]])
    ids, nulls, sizes = (np.concatenate([h[k] for h in held]) for k in range(3))
    doc = np.concatenate([h[3] + b for h, b in zip(held, base[:-1], strict=True)])
    term, count = (np.concatenate([h[k] for h in held]) for k in (4, 5))
    kept, doc = np.unique(doc, return_inverse=True)
    order = np.lexsort((doc, term))
    doc, term, count = doc[order], term[order], count[order]
    terms, row = np.unique(term, return_inverse=True)
    bits = np.zeros((len(terms), len(kept)), bool)
    bits[row, doc] = True
    cells = [ids[kept].tobytes(), nulls[kept].tobytes(), sizes[kept].tobytes(), np.packbits(bits, axis=1).tobytes(), count.astype(np.int64).tobytes()]
    numbers = [pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), pa.array([terms.tolist()], pa.list_(pa.int64())), pa.array([np.bincount(row, minlength=len(terms)).tolist()], pa.list_(pa.int64()))]
    return pa.record_batch([*numbers, *[pa.array([c], pa.binary()) for c in cells]], SEGMENTS.names)


class _Best:
    """The k best (score, id) of one item; higher scores first, then smaller ids, null last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """What a score must reach to be listed."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        good = scores >= self.floor
        scores, ids, nulls = (np.concatenate(x) for x in ((self.scores, scores[good]), (self.ids, ids[good]), (self.nulls, nulls[good])))
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


def masks_of(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of a (terms, documents) bit matrix, and each document's number among them."""
    packed = np.packbits(bits, axis=0, bitorder="little")
    words = np.zeros((-(-len(packed) // 8) * 8, bits.shape[1]), np.uint8)
    words[: len(packed)] = packed
    words = np.ascontiguousarray(words.T).view("<u8")
    group, number = np.zeros(bits.shape[1], np.int64), 1
    for w in words.T:  # one word of the mask after another
        values, inverse = np.unique(w, return_inverse=True)
        group, number = group * len(values) + inverse, number * len(values)
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
    return bits[:, first], group


def _searched(row: dict, items: list[tuple], total: int, length: int, best: dict[int, _Best], k: int) -> None:
    """Adds one segment's documents to the best of each item (number, terms, weights)."""
    terms = np.array(row["terms"], np.int64)
    ids, nulls, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool), np.frombuffer(row["sizes"], np.int64)
    bits = np.unpackbits(np.frombuffer(row["bitmaps"], np.uint8).reshape(len(terms), -1), axis=1, count=len(ids)).astype(bool)
    term_of, doc_of = np.nonzero(bits)
    count = np.frombuffer(row["counts"], np.int64)
    m = 100 - LENGTH + LENGTH * sizes * total // length
    impact = 1_000_000_000 * count // (1000 * count + 8 * m[doc_of])
    start = np.searchsorted(term_of, np.arange(len(terms) + 1))
    highest = np.maximum.reduceat(impact, start[:-1])
    for number, wanted, weights in items:
        place = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        here = terms[place] == wanted
        place, weights = place[here], weights[here]
        if not len(place):
            continue
        masks, group = masks_of(bits[place])
        bound = (weights * highest[place]) @ masks
        order = np.argsort(-bound, kind="stable")
        docs = np.argsort(group, kind="stable")
        edge = np.searchsorted(group[docs], np.arange(masks.shape[1] + 1))
        mine, at, step = best.setdefault(number, _Best(k)), 0, k
        while at < len(order) and bound[order[at]] >= mine.floor:
            some = order[at : at + step]
            at, step = at + step, 2 * step
            some = some[bound[some] >= mine.floor]
            ask = np.sort(np.concatenate([docs[edge[g] : edge[g + 1]] for g in some]))
            score = np.zeros(len(ask), np.int64)
            for t, w in zip(place.tolist(), weights.tolist(), strict=True):
                held = doc_of[start[t] : start[t + 1]]
                p = np.minimum(np.searchsorted(held, ask), len(held) - 1)
                score += np.where(held[p] == ask, w * impact[start[t] + p], 0)
            mine.add(score, ids[ask], nulls[ask])


HITS = T.StructType([T.StructField(c, T.LongType()) for c in ("item", "score", "doc")])


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """(item, score, doc): the k best of every task for each of a block of items, by number."""
    counted = [(r["item"], terms_of(r["text"])) for r in items]
    listed = sorted({t for _, ts in counted for t in ts})
    number = {t: i for i, t in enumerate(listed)}
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(listed))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            data, offsets = util.utf8(batch.column(1))
            ids = batch.column(0)
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in util.slabs(data, offsets):
                size, text, term = sent.value.found(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                pair, count = np.unique(text * max(1, len(listed)) + term, return_counts=True)
                held.append((ids[a:b], nulls[a:b], size, pair // max(1, len(listed)), pair % max(1, len(listed)), count))
                n += b - a
                if n >= SEGMENT:
                    yield _segment(held)
                    held, n = [], 0
        if held:
            yield _segment(held)

    segments = util.stored(docs.mapInArrow(cut, SEGMENTS))
    total, length = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    pairs = segments.select(F.explode(F.arrays_zip("terms", "holders")).alias("p"))
    df = {r[0]: r[1] for r in pairs.groupBy("p.terms").agg(F.sum("p.holders")).collect()}  # one row for each of the block's terms
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    asks = []
    for item, ts in counted:
        known = [number[t] for t in ts if weight.get(number[t], 0) > 0]
        wanted, repeats = np.unique(np.array(known, np.int64), return_counts=True)
        if len(wanted):
            asks.append((item, wanted, repeats * np.array([weight[t] for t in wanted.tolist()], np.int64)))
    queries = docs.sparkSession.sparkContext.broadcast(asks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["terms"]:
                    _searched(row, queries.value, total, length, best, k)
        for item, x in best.items():
            yield pa.record_batch([pa.array([item] * len(x.ids), pa.int64()), pa.array(x.scores), pa.array(x.ids, mask=x.nulls)], HITS.names)

    hits = util.stored(segments.mapInArrow(search, HITS))
    util.dropped(segments)
    sent.destroy()
    queries.destroy()
    return hits


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id_col, rank, id_col, score): the k documents of highest score above 0 for each
    row of items, ranks from 1, ties by ascending id, null ids last.

    Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z is
    lower-cased. With N documents that hold a term, L terms in all, and a term's df holders,
    its weight is floor(1000 ln((2N + 2) / (2df + 1))); of tf occurrences in a document of n
    terms it scores weight * (10^9 tf div (1000 tf + 8m)), m = 25 + 75nN div L, for each time
    that the item names it. All but the logarithm is integer arithmetic.

    Null and termless texts match nothing, as documents and as items. Rows that repeat an id
    are documents, or items, of their own. Empty tables give an empty result; extra columns
    take no part. The two id columns have different names in the result.
    """
    if id_col == item_id_col:
        raise ValueError("name the id of documents and that of items differently")
    spark = docs.sparkSession
    util.small_batches(spark)
    col = lambda name: F.col(f"`{name}`")
    asked = items.select(F.monotonically_increasing_id().alias("item"), col(item_id_col).alias("item_id"), util.text_or_empty(col(item_text_col)).alias("text"))
    asked = util.stored(asked)
    rows, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // AT_ONCE), -(-size // BLOCK_BYTES))
    texts = docs.select(col(id_col).cast("long").alias("doc"), util.text_or_empty(col(text_col)).alias("text"))
    hits = None
    for b in range(blocks):  # each holds AT_ONCE items or so, whatever their number
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else asked
        found = _block(texts, part.select("item", "text").collect(), k)
        hits = found if hits is None else hits.union(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select(F.col("item_id").alias(item_id_col), "rank", F.col("doc").alias(id_col), "score")
