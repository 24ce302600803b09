"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing on a document. The counts
of the vote patterns over the whole corpus (at most 3 ** labellers rows) feed an
expectation-maximisation that estimates how often each labeller says what on good and on
bad documents, and so a posterior for every pattern. The posteriors are the training
labels of a linear scorer over hashed features, which judges the documents.
"""

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import util

#: Dimensions of the hashed features.
DIMENSIONS = 4096
#: Rows on which the scorer is fitted, at most about; a bound, not a share.
FIT_ROWS = 8_000
#: What a byte pair's share counts for, against a bin.
PAIR_WEIGHT = 5.0
#: Bytes of text that are looked at together.
SLAB = 1 << 18
#: Documents below this score are rejected.
THRESHOLD = 0.3

# Classes of bytes.
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 1 if "a" <= _ch <= "z" else 2 if "A" <= _ch <= "Z" else 4 if "0" <= _ch <= "9" else 64 if _c >= 128 else 32 if _c in b" \t\n\r\x0b\x0c" else 8 if _ch in ".,;:'\"-()?" else 16
_EDGES = np.array([0.002, 0.01, 0.03, 0.07, 0.15, 0.3, 0.5, 0.7, 0.85])


class Labeller(NamedTuple):
    name: str
    statistic: str
    bad_above: float
    good_below: float


#: Overlapping heuristics: above one bound of a statistic a vote for bad, below the other
#: for good, nothing between. Texts of fewer than MIN_WORDS words get no votes on words.
LABELLERS = [
    Labeller("signs", "signs", 0.02, 0.006),
    Labeller("shouting", "upper", 0.30, 0.08),
    Labeller("one word", "top", 0.25, 0.12),
    Labeller("few words", "repeats", 0.65, 0.45),
    Labeller("bare signs", "bare", 0.06, 0.02),
    Labeller("lines again", "lines", 0.30, 0.05),
    Labeller("few letters", "other", 0.14, 0.06),
    Labeller("ends in signs", "ends", 0.15, 0.03),
    Labeller("stutter", "stutter", 0.20, 0.06),
]
MIN_WORDS = 12
STATISTICS = ["signs", "upper", "top", "repeats", "bare", "lines", "other", "ends", "stutter"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Shares in [0, 1] by text, the words' counts, and each word's text and shape."""
    n = len(offsets) - 1
    kind = _CLASS[data]
    text_of = np.repeat(np.arange(n), np.diff(offsets))

    def share(mark: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(text_of[mark], minlength=n)[:n] / np.maximum(of, 1)

    size = np.diff(offsets)
    letters = np.bincount(text_of[(kind & (1 | 2 | 64)) > 0], minlength=n)[:n]
    signs = kind == 16
    word, begin, end, first = util.words(data, offsets, lower=False)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    # distinct words, and the most frequent one's share
    order = np.lexsort((word, doc))
    w, d = word[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(w)])
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[at], times)
    distinct = np.bincount(d[at], minlength=n)[:n]
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    total = lambda mark: np.bincount(doc[mark], minlength=n)[:n] / np.maximum(count, 1)
    if len(word):
        mask = np.bitwise_or.reduceat(kind & ~np.uint8(32), np.stack([begin, np.minimum(end, len(kind) - 1)], 1).ravel())[::2].astype(np.int64)
        whole = end == len(kind)
        mask[whole] = [int(np.bitwise_or.reduce(kind[b:e])) for b, e in zip(begin[whole], end[whole], strict=True)]
        shape = mask | kind[begin].astype(np.int64) << 8 | kind[end - 1].astype(np.int64) << 16
        last = kind[end - 1]
    else:
        shape, last, mask = np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    # lines of a text that repeat: hashed as the words between line ends
    breaks = np.cumsum(data == 10)
    line = breaks[begin] if len(begin) else np.zeros(0, np.int64)
    line_new = np.ones(len(word), bool)
    line_new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(line_new)
    place = np.arange(len(word)) - np.repeat(starts, np.diff(np.r_[starts, len(word)])) if len(word) else np.zeros(0, np.int64)
    hashes = np.add.reduceat(util.mixed(word + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts) if len(word) else np.zeros(0, np.uint64)
    line_doc = doc[starts] if len(word) else np.zeros(0, np.int64)
    order = np.lexsort((hashes, line_doc))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    lines = np.bincount(line_doc, minlength=n)[:n]
    found = {
        "signs": share(signs, size),
        "upper": share(kind == 2, letters),
        "top": top / np.maximum(count, 1),
        "repeats": 1 - distinct / np.maximum(count, 1),
        "bare": total((mask & ~np.int64(16)) == 0),
        "lines": np.bincount(line_doc[order][again], minlength=n)[:n] / np.maximum(lines, 1),
        "other": share((kind & (4 | 8 | 16)) > 0, size),
        "ends": total(last == 16),
        "stutter": total(same),
    }
    return found, count, doc, shape


def votes(found: dict[str, np.ndarray], count: np.ndarray) -> np.ndarray:
    """Of each labeller: 0 nothing, 1 good, 2 bad; a pattern number in base 3 by text."""
    code = np.zeros(len(count), np.int64)
    for rule in reversed(LABELLERS):
        x = found[rule.statistic]
        say = np.where(x > rule.bad_above, 2, np.where(x < rule.good_below, 1, 0))
        code = code * 3 + np.where(count >= MIN_WORDS, say, 0)
    return code


def pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, share): pairs of neighbouring bytes of a text, of which letters are
    lower-cased, and each pair's share of all of them."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[1:] == text[:-1]
    pair, times = np.unique((text[1:] << 16 | low[:-1] << 8 | low[1:])[inside], return_counts=True)
    row = pair >> 16
    return row, pair & 0xFFFF, times / np.maximum(np.diff(offsets) - 1, 1)[row]


def hashed(found: dict[str, np.ndarray], count: np.ndarray, doc: np.ndarray, shape: np.ndarray, bytes_: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features (text, dimension, value): binned statistics, shares of word shapes,
    and, of what no labeller looks at, shares of byte pairs."""
    n = len(count)
    rows, dims, values = [], [], []

    def add(row: np.ndarray, name: np.ndarray, value: np.ndarray) -> None:
        rows.append(row)
        dims.append((util.mixed(name.astype(np.uint64)) >> np.uint64(13)) % np.uint64(DIMENSIONS))
        values.append(value)

    for k, name in enumerate(STATISTICS):  # shares of a few words say little
        bin_ = np.where(count >= MIN_WORDS, np.searchsorted(_EDGES, found[name]), 99)
        add(np.arange(n), (k + 1 << 40) + bin_, np.ones(n))
    add(np.arange(n), (99 << 40) + np.log2(np.maximum(count, 1)).astype(np.int64), np.ones(n))
    pair, times = np.unique(doc.astype(np.int64) << 32 | shape, return_counts=True)
    row = pair >> 32
    add(row, pair & 0xFFFFFFFF, times / (count[row] + MIN_WORDS))  # a few words weigh less
    of, name, share = bytes_
    add(of, (98 << 40) + name, share * PAIR_WEIGHT)
    return np.concatenate(rows), np.concatenate(dims).astype(np.int64), np.concatenate(values)


#: The prior of how often a labeller says bad, in either class: uniform between these.
#: Each looks for one defect of several, so it misses at least half of the bad documents.
SAYS_BAD = (1e-3, 0.5)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern (rows of votes), P(vote | class) of each
    labeller as (labeller, bad/good, vote), and the share of good.

    The model: votes are independent given the class. A labeller says bad with a rate of
    its own in each class; where it does not, it says good or nothing at one rate, which
    does not depend on the class, as a labeller that sees no defect knows no more. The
    M-step maximises the expected log likelihood under the uniform prior SAYS_BAD: it is
    concave in each rate, so the maximum is the expected frequency, moved to the nearer
    end where it lies outside; the rate of good among votes that are not bad is pooled over
    the classes. Each labeller starts out as right in 4 of 5 votes."""
    k = patterns.shape[1]
    bad = np.tile([0.5, 0.16], (k, 1))  # P(says bad | class), class 0 is bad
    weight = counts.astype(float)
    says_good = np.array([(weight[patterns[:, j] == 1].sum() + 1) / (weight[patterns[:, j] != 2].sum() + 2) for j in range(k)])
    good = 0.7

    def table() -> np.ndarray:
        rest = 1 - bad
        return np.stack([rest * (1 - says_good)[:, None], rest * says_good[:, None], bad], axis=2)

    for _ in range(rounds):
        says = np.log(table())
        like = [np.log(share) + sum(says[j, c, patterns[:, j]] for j in range(k)) for c, share in ((0, 1 - good), (1, good))]
        posterior = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        for c, p in ((1, posterior), (0, 1 - posterior)):
            mass = weight * p
            frequency = [mass[patterns[:, j] == 2].sum() / max(mass.sum(), 1e-9) for j in range(k)]
            bad[:, c] = np.clip(frequency, *SAYS_BAD)
        good = float(np.clip((weight * posterior).sum() / weight.sum(), 0.01, 0.99))
    return posterior, table(), good


def fit(rows: np.ndarray, dims: np.ndarray, values: np.ndarray, target: np.ndarray, passes: int = 300, step: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on soft targets (the last one is the constant)."""
    w, g2 = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    n = len(target)
    for _ in range(passes):
        z = np.bincount(rows, values * w[dims], n) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.r_[np.bincount(dims, values * error[rows], DIMENSIONS), error.sum()] / n
        g[:-1] += decay * w[:-1]
        g2 += g * g
        w -= step * g / np.sqrt(g2) * 0.1
    return w


def scores(data: np.ndarray, offsets: np.ndarray, w: np.ndarray) -> np.ndarray:
    n, out = len(offsets) - 1, []
    for a, b in util.slabs(data, offsets, SLAB):
        part = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        rows, dims, values = hashed(*statistics(*part), pairs(*part))
        z = np.bincount(rows, values * w[dims], b - a) + w[-1]
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.concatenate(out) if n else np.zeros(0)


@F.arrow_udf(T.LongType())
def _pattern(texts: pa.Array) -> pa.Array:
    data, offsets = util.utf8(texts)
    parts = [votes(*statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[:2]) for a, b in util.slabs(data, offsets, SLAB)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))


_SPARSE = T.StructType([T.StructField("dims", T.BinaryType()), T.StructField("values", T.BinaryType())])


@F.arrow_udf(_SPARSE)
def _features(texts: pa.Array) -> pa.Array:
    """Packed arrays of two and four bytes an entry."""
    data, offsets = util.utf8(texts)
    out = []
    for a, b in util.slabs(data, offsets, SLAB):
        part = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        rows, dims, values = hashed(*statistics(*part), pairs(*part))
        order = np.argsort(rows, kind="stable")
        edge = np.searchsorted(rows[order], np.arange(b - a + 1)).tolist()
        dims, values = dims[order].astype(np.uint16), values[order].astype(np.float32)
        out += [(dims[i:j].tobytes(), values[i:j].tobytes()) for i, j in itertools.pairwise(edge)]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["dims", "values"])


class Model(NamedTuple):
    weights: np.ndarray
    accuracies: dict[str, float]
    good_share: float


def train(df: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model | None:
    """Votes of all rows; the scorer on about fit_rows rows, chosen by a hash of the text.
    An empty table gives no model."""
    util.small_batches(df.sparkSession)
    text = util.text_or_empty(F.col(f"`{text_col}`"))
    voted = df.select(text.alias("text"), _pattern(text).alias("pattern"))
    found = sorted((r["pattern"], r["count"]) for r in voted.groupBy("pattern").count().collect())  # at most 3 ** 9 rows
    if not found:
        return None
    codes, counts = (np.array(x, np.int64) for x in zip(*found, strict=True))
    digits = np.stack([codes // 3**j % 3 for j in range(len(LABELLERS))], axis=1)
    posterior, says, good = em(digits, counts)
    said = {r.name: float(good * says[j, 1, 1] + (1 - good) * says[j, 0, 2]) / max(float(1 - good * says[j, 1, 0] - (1 - good) * says[j, 0, 0]), 1e-9) for j, r in enumerate(LABELLERS)}
    part = min(1.0, fit_rows / int(counts.sum()))
    chosen = voted.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(part * 1_000_003) + 1)
    # equal texts would tip the bound and add nothing new
    sample = chosen.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.first("pattern").alias("pattern"), F.count(F.lit(1)).alias("times"))
    lines = sample.select("h", "pattern", _features("text").alias("x")).select("h", "pattern", "x.*").toArrow().sort_by("h")
    if not len(lines):
        return Model(np.r_[np.zeros(DIMENSIONS), 1.0], said, good)
    dims, values = (np.frombuffer(b"".join(x.as_py() for x in lines.column(c)), t) for c, t in (("dims", np.uint16), ("values", np.float32)))
    size = np.array([len(x.as_py()) // 2 for x in lines.column("dims")])
    target = posterior[np.searchsorted(codes, lines.column("pattern").to_numpy())]
    return Model(fit(np.repeat(np.arange(len(lines)), size), dims.astype(np.int64), values, target), said, good)


def judged(df: DataFrame, text_col: str = "text", model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """df with quality_score, in [0, 1], and quality_kept. Without a model one is trained
    on df. A null text counts as empty; empty texts are judged like others, by their
    features; equal texts get equal scores. Columns with these names are replaced."""
    util.small_batches(df.sparkSession)
    model = model or train(df, text_col)
    weights = model.weights if model else np.zeros(DIMENSIONS + 1)
    sent = df.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(np.round(scores(*util.utf8(texts), sent.value), 9))

    return df.withColumn("quality_score", scored(F.col(f"`{text_col}`"))).withColumn("quality_kept", F.col("quality_score") >= threshold)
