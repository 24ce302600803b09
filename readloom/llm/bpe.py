"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Each code point gets a class (letter, number, white space, apostrophe, other), refined
by what follows it, so that the pattern's look-ahead is part of the class. A small
automaton over these classes says where a match begins. Its transition functions are
composed: blocks of code points are run side by side from every state at once, the
blocks' functions are scanned with the associative composition, and a second pass from
the now known states yields the borders. No regular expression is run. The slices are
merged by rank, once for each distinct slice of a task.
"""

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import util

# What a code point is.
LETTER, NUMBER, BLANK, OTHER = range(4)
# What the automaton reads: a class with what it needs to know of the next code points.
(L, N, O, QUOTE_1, QUOTE_2, LAST_SPACE, LAST_BLANK, MORE_BLANK) = range(8)
# States: what the match at hand may go on with.
(IN_L, IN_N, IN_O, PREFIX, RUN, AFTER_1, AFTER_2A, AFTER_2B, DONE) = range(9)
STATES = 9
#: Code points in a block of the scan.
BLOCK = 128
#: White_Space of Unicode, fixed values.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next state and whether a match begins here, both by [class, state]."""
    step = np.zeros((8, STATES), np.uint8)
    begins = np.ones((8, STATES), bool)
    fresh = {L: IN_L, N: IN_N, O: IN_O, QUOTE_1: AFTER_1, QUOTE_2: AFTER_2A, LAST_SPACE: PREFIX, LAST_BLANK: DONE, MORE_BLANK: RUN}
    for c in range(8):
        step[c, :] = fresh[c]
    # a run goes on; one space may stand before it
    for c, state in ((L, IN_L), (N, IN_N), (O, IN_O)):
        for s in (state, PREFIX):
            step[c, s], begins[c, s] = state, False
    # within a run of other signs, or after its space, an apostrophe is one of them
    for c in (QUOTE_1, QUOTE_2):
        for s in (IN_O, PREFIX):
            step[c, s], begins[c, s] = IN_O, False
    # the one or two letters of a contraction, known to be there
    for s, then in ((AFTER_1, DONE), (AFTER_2A, AFTER_2B), (AFTER_2B, DONE)):
        step[L, s], begins[L, s] = then, False
    # white space before the last of its run; the last one stands apart when a sign follows
    step[MORE_BLANK, RUN], begins[MORE_BLANK, RUN] = RUN, False
    return step, begins


STEP, BEGINS = _automaton()


@functools.cache
def _class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = BLANK
    return table


def classes(points: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Refined class of each code point; last marks the final one of each text."""
    n = len(points)
    kind = _class_table()[points]
    out = np.array([L, N, MORE_BLANK, O], np.uint8)[kind]
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = kind[1:] != BLANK
    solid_next &= ~last
    final = (kind == BLANK) & solid_next
    out[final] = np.where(points[final] == 32, LAST_SPACE, LAST_BLANK)
    quote = np.flatnonzero((points == 39) & ~last)
    if len(quote):
        a = points[quote + 1]
        one = np.isin(a, [ord(x) for x in "stmd"])
        out[quote[one]] = QUOTE_1
        longer = quote[~one & ~last[quote + 1]]
        a, b = points[longer + 1], points[longer + 2]
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[longer[two]] = QUOTE_2
    return out


def scan(symbols: np.ndarray) -> np.ndarray:
    """State before each symbol, from DONE, by composition of transition functions."""
    n = len(symbols)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    flat = STEP.ravel()
    # the function of each block: the state after it for every state before it
    f = np.tile(np.arange(STATES, dtype=np.intp), (blocks, 1))
    base = columns.astype(np.intp) * STATES
    for k in range(BLOCK):
        f = flat[base[k][:, None] + f]
    # inclusive scan of the functions with composition, which is associative
    reach = 1
    while reach < blocks:
        later = f[reach:].copy()
        f[reach:] = np.take_along_axis(later, f[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.full(blocks, DONE, np.intp)
    state[1:] = f[:-1, DONE]
    before = np.empty((BLOCK, blocks), np.uint8)
    for k in range(BLOCK):
        before[k] = state
        state = flat[base[k] + state].astype(np.intp)
    return before.T.ravel()[:n]


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of every match in a batch of texts (UTF-8, end to end), in order."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of code points
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    edge = np.searchsorted(at, offsets)
    last = np.zeros(len(points), bool)
    last[edge[1:][edge[1:] > edge[:-1]] - 1] = True
    symbols = classes(points, last)
    begin = BEGINS[symbols, scan(symbols)]
    begin[edge[:-1][edge[1:] > edge[:-1]]] = True
    return _settle(symbols, begin, edge, at)


def _settle(symbols: np.ndarray, begin: np.ndarray, edge: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Runs the automaton anew from each text's start, where the text before it left
    another state than DONE; the first symbols decide until both agree on a border."""
    for k in edge[1:-1]:
        k = int(k)
        if k >= len(symbols):
            break
        state = DONE
        i = k
        while True:
            fresh = bool(BEGINS[symbols[i], state]) or i == k
            agree = fresh and begin[i] and i > k
            begin[i] = fresh
            state = int(STEP[symbols[i], state])
            i += 1
            if agree or i >= len(symbols):
                break
    return at[begin]


class Vocabulary:
    """Ranks of a tiktoken file; merged slices are kept, up to a bound: when the newer half
    is full, the older one is let go, so that frequent slices stay."""

    KEPT = 1 << 18

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.pieces = {i: x for x, i in self.ranks.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        if (found := self.cache.get(piece)) is not None:
            return found
        if (ids := self.older.get(piece)) is None:
            ids = (self.ranks[piece],) if piece in self.ranks else self._merge(piece)
        if len(self.cache) >= self.KEPT // 2:
            self.cache, self.older = {}, self.cache
        self.cache[piece] = ids
        return ids

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        import heapq

        # linked parts; a heap of pairs, so that long slices stay fast
        n = len(piece)
        end = list(range(1, n + 1))
        prev, alive = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := self.ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0 and (r := self.ranks.get(piece[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        return tuple(self.ranks[piece[i : end[i]]] for i in range(n) if alive[i])


_VOCABULARIES: dict[bytes, Vocabulary] = {}


def forgotten() -> None:
    """Merged slices are let go when a task ends: its worker lives on beside those of later
    stages."""
    for vocab in _VOCABULARIES.values():
        vocab.cache, vocab.older = {}, {}
    util.memory_returned()


def vocabulary(lines: bytes) -> Vocabulary:
    key = hashlib.sha256(lines).digest()
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(lines)
    return _VOCABULARIES[key]


def encode_batch(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> Iterator[list[int]]:
    """Token ids of each text."""
    for a, b in util.slabs(data, offsets):
        part = data[offsets[a] : offsets[b]]
        rel = offsets[a : b + 1] - offsets[a]
        cut = borders(part, rel)
        raw, first = part.tobytes(), np.searchsorted(cut, rel).tolist()
        cut = [*cut.tolist(), len(raw)]
        known, merged = vocab.cache, vocab.merged
        for i in range(b - a):
            ids: list[int] = []
            for k in range(first[i], first[i + 1]):
                piece = raw[cut[k] : cut[k + 1]]
                ids.extend(known.get(piece) or merged(piece))
            yield ids


def decode(ids: list[int], vocab: Vocabulary) -> tuple[bytes, np.ndarray]:
    """The bytes of a list of ids, and where each token's bytes begin (and the end)."""
    pieces = list(map(vocab.pieces.__getitem__, ids))
    offsets = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)), out=offsets[1:])
    return b"".join(pieces), offsets


def read_ranks(path: str) -> bytes:
    """The vocabulary file, below 4 MB (checked), to be sent along with the tasks."""
    with open(path, "rb") as f:
        lines = f.read(4_000_001)
    if len(lines) > 4_000_000:
        raise ValueError(f"{path}: a vocabulary of over 4 MB is not sent to every task")
    return lines


def bpe_encode(df: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """df with the token ids of each text; a null or empty text has none. A column of
    that name is replaced. Texts are whole, whatever their length."""
    util.small_batches(df.sparkSession)
    lines = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                data, offsets = util.utf8(texts)
                yield pa.array([np.array(x, np.int32) for x in encode_batch(data, offsets, vocabulary(lines.value))], pa.list_(pa.int32()))
        finally:
            forgotten()

    return df.withColumn(ids_col, encoded(F.col(f"`{text_col}`")))


def bpe_decode(df: DataFrame, ranks_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """df with the bytes of each id list as text_col and each token's first byte as
    text_col + '_offsets'. A null list counts as empty; an unknown id is an error."""
    util.small_batches(df.sparkSession)
    lines = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("offsets", T.ArrayType(T.LongType()))])

    @F.arrow_udf(kind)
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for ids in batches:
                vocab = vocabulary(lines.value)
                both = [decode(x or [], vocab) for x in ids.to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([x for x, _ in both], pa.binary()), pa.array([y for _, y in both], pa.list_(pa.int64()))], ["bytes", "offsets"])
        finally:
            forgotten()

    (made,) = util.free_name(df, "made")
    return df.withColumn(made, decoded(F.col(f"`{ids_col}`"))).withColumns({text_col: F.col(f"{made}.bytes"), f"{text_col}_offsets": F.col(f"{made}.offsets")}).drop(made)


def bpe_round_trip(df: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "token_ids", same_col: str = "round_trip") -> DataFrame:
    """df with the token ids of each text and whether they decode to its bytes. The ids are
    made and decoded in one pass, in one worker a task, and the decoded bytes stay there. A
    null text is an empty one, without ids. Columns with these names are replaced."""
    util.small_batches(df.sparkSession)
    lines = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())])

    @F.arrow_udf(kind)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                vocab = vocabulary(lines.value)
                data, offsets = util.utf8(texts)
                made, same = [], []
                for i, ids in enumerate(encode_batch(data, offsets, vocab)):
                    made.append(np.array(ids, np.int32))
                    same.append(decode(ids, vocab)[0] == data[offsets[i] : offsets[i + 1]].tobytes())
                yield pa.StructArray.from_arrays([pa.array(made, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["ids", "same"])
        finally:
            forgotten()

    (made,) = util.free_name(df, "made")
    return df.withColumn(made, coded(F.col(f"`{text_col}`"))).withColumns({ids_col: F.col(f"{made}.ids"), same_col: F.col(f"{made}.same")}).drop(made)


def bpe_digest(df: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256, for checks and inventories:
    the ids are made and decoded in one pass and only their digests are returned."""
    util.small_batches(df.sparkSession)
    lines = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("bytes", T.StringType())])

    @F.arrow_udf(kind)
    def digests(texts: pa.Array) -> pa.Array:
        vocab = vocabulary(lines.value)
        data, offsets = util.utf8(texts)
        n, ids_hex, bytes_hex = [], [], []
        for ids in encode_batch(data, offsets, vocab):
            n.append(len(ids))
            ids_hex.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            bytes_hex.append(hashlib.sha256(decode(ids, vocab)[0]).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(bytes_hex, pa.string())], ["n", "ids", "bytes"])

    (made,) = util.free_name(df, "made")
    return df.withColumn(made, digests(F.col(f"`{text_col}`"))).withColumns({"n_tokens": F.col(f"{made}.n"), "ids_sha256": F.col(f"{made}.ids"), "decoded_sha256": F.col(f"{made}.bytes")}).drop(made)
