"""Word shingles of documents as hashed sets, and what the n-gram join needs of them."""

import numpy as np

from . import util

WORDS = 5
U64 = np.uint64
#: Bits of a signature.
BITS = 2048


def of_batch(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: the text's index and the hash, both sorted. Texts
    are lower-cased (A-Z); with fewer than k words the whole sequence is one shingle."""
    docs, hashes = [], []
    for a, b in util.slabs(data, offsets):
        word, _, _, first = util.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        count = np.diff(first)
        doc = np.repeat(np.arange(b - a), np.maximum(count - k + 1, 0))
        full = util.grams(word, k)
        at = np.arange(len(word) - k + 1 if len(word) >= k else 0)
        inside = np.searchsorted(first, at, side="right") - 1
        full = full[at + k <= first[inside + 1]] if len(at) else full
        few = np.flatnonzero((count > 0) & (count < k))
        whole = [util.mixed(util.grams(word[first[i] : first[i + 1]], int(count[i])) + U64(count[i])) for i in few]
        doc = np.concatenate([doc, few])
        h = np.concatenate([full, *whole]) if len(few) else full
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        docs.append(doc[new] + a)
        hashes.append(h[new])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(docs), np.concatenate(hashes)


def sizes(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n)[:n]


def names(doc: np.ndarray, h: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, by sums over its members; a seed varies the first."""
    out = []
    for salt in (2 * seed + 1, 0):
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(util.mixed(h + U64(salt)), out=total[1:])
        edge = np.searchsorted(doc, np.arange(n + 1))
        out.append(util.mixed(total[edge[1:]] - total[edge[:-1]] + U64(salt)).view(np.int64))
    return out[0], out[1]


def signature(h: np.ndarray) -> np.ndarray:
    """BITS / 8 bytes: bit (hash mod BITS) is set for every member of one set."""
    bits = np.zeros(BITS, bool)
    bits[(h >> U64(17)) % U64(BITS)] = True
    return np.packbits(bits)


def prefixes(doc: np.ndarray, h: np.ndarray, n: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first members of each set in the common order (rare before common, by level of
    the hash's slot, then by hash), as indexes, and the largest partner each still allows.
    Of two linked sets, the first shared member is among these in both. A pair whose first
    shared member has t members from there on overlaps in t members at most, which bounds
    the partner's size."""
    slot = h & U64(len(level) - 1)
    key = (level[slot].astype(U64) << U64(56)) | (h >> U64(8))
    order = np.lexsort((key, doc))
    count = sizes(doc, n)
    start = np.cumsum(count) - count
    rank = np.arange(len(doc)) - start[doc[order]]
    own = count[doc[order]]
    most = (7 * (own - rank) - 3 * own) // 3
    chosen = 4 * most >= 3 * own
    return order[chosen], most[chosen]


def linked(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    """Whether sets of a and b members that share `both` are 3/4 alike."""
    return 7 * both >= 3 * (a + b)
