"""Merkle manifest of a table: a tree of SHA-256 digests that keeps midstates.

Every row is a leaf. Leaves of a group (a language) ascend by id; every 8 consecutive nodes
become one parent until one node remains, the group's subroot; the subroots, ordered by
group, become the root in the same way.

A child's digest as hex text is 64 bytes, one block of SHA-256, so the hash state before each
child slot is 8 words. A parent keeps a copy of these states, and folding a replaced child
resumes the state before its slot with the replacement and the right siblings only. States
must outlive a task, which those of the standard library cannot, so the compression function
is written here over numpy vectors, one lane for each node.

On Spark: rows are dealt by ranges of (group, id), numbered by counts of the ranges, and
packed 512 to a row; the packs grow three levels each (`levels`), then their roots are packed again.
Folding walks down: each pack hands its children the records above them.
"""

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import util

FAN = 8
#: Levels of the tree in one pack; FAN ** LEVELS nodes enter it.
LEVELS = 3

_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, math.isqrt(p) + 1))]


def _cube_root(n: int) -> int:
    x = 1 << -(-n.bit_length() // 3)
    while (y := (2 * x + n // (x * x)) // 3) < x:
        x = y
    return x


#: The hash's constants by their rule: 32 bits after the point of roots of the first primes.
FIRST = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _PRIMES[:64]], np.uint32)
#: Four hex digits as one big-endian word, for each 16 bits.
_HEX = np.frombuffer("".join(f"{i:04x}" for i in range(1 << 16)).encode(), ">u4").astype(np.uint32)

RECORD = np.dtype([("count", "u1"), ("states", "<u4", (FAN, 8)), ("children", "<u4", (FAN, 8))])
STEP = np.dtype([("slot", "u1"), ("record", RECORD)])


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def compressed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, n) after one block (16, n) of big-endian words each."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + w[i - 7] + (_turn(x, 7) ^ _turn(x, 18) ^ x >> np.uint32(3)) + (_turn(y, 17) ^ _turn(y, 19) ^ y >> np.uint32(10)))
        up = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ e & (f ^ g)) + (w[i] + _ROUND[i])
        down = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b | c & (a | b))
        a, b, c, d, e, f, g, h = up + down, a, b, c, d + up, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def _taken(state: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """States (n, 8) after the hex text of one digest (n, 8) each."""
    block = np.empty((16, len(digest)), np.uint32)
    block[0::2], block[1::2] = _HEX[digest.T >> np.uint32(16)], _HEX[digest.T & np.uint32(0xFFFF)]
    return compressed(np.ascontiguousarray(state.T), block).T


def _closed(state: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Digests (n, 8) of messages of `count` blocks whose states are given."""
    block = np.zeros((16, len(state)), np.uint32)
    block[0], block[15] = 1 << 31, count.astype(np.uint32) * 512
    return compressed(np.ascontiguousarray(state.T), block).T


def parents(children: np.ndarray, sizes: list[int]) -> np.ndarray:
    """A RECORD for each run of FAN consecutive children (n, 8); runs end with their part
    (sizes). Its states are those before each slot."""
    at, rows = 0, []
    for n in sizes:
        rows += [np.arange(i, min(i + FAN, at + n)) for i in range(at, at + n, FAN)]
        at += n
    out = np.zeros(len(rows), RECORD)
    out["count"] = [len(r) for r in rows]
    if rows:
        owner = np.repeat(np.arange(len(rows)), out["count"])
        slot = np.concatenate([np.arange(len(r)) for r in rows])
        out["children"][owner, slot] = children
    state = np.tile(FIRST, (len(rows), 1))
    for j in range(FAN):
        out["states"][:, j] = state
        go = np.flatnonzero(out["count"] > j)
        state[go] = _taken(state[go], out["children"][go, j])
    return out


def digests(records: np.ndarray) -> np.ndarray:
    """Digests (n, 8) of parents, from the state before their last child."""
    last = records["count"].astype(np.int64) - 1
    at = np.arange(len(records))
    state = records["states"][at, last]
    return _closed(_taken(state, records["children"][at, last]), records["count"]) if len(records) else np.zeros((0, 8), np.uint32)


def resumed(records: np.ndarray, at: np.ndarray, slot: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Digests of records[at] with the child in `slot` replaced by `new` (n, 8): the state
    before the slot goes on with the replacement and the right siblings."""
    count = records["count"][at].astype(np.int64)
    state = _taken(records["states"][at, slot], new)
    for j in range(1, FAN):
        go = np.flatnonzero(slot + j < count)
        if not len(go):
            break
        state[go] = _taken(state[go], records["children"][at[go], slot[go] + j])
    return _closed(state, count)


def _depth(n: int, most: int) -> int:
    """Levels of a pack in a tree of n nodes."""
    levels, left = 0, n
    while left > 1 and levels < most:
        left, levels = -(-left // FAN), levels + 1
    return levels


def _words(cells: pa.Array) -> np.ndarray:
    """Digests (n, 8) of 32-byte cells."""
    return np.frombuffer(b"".join(cells.to_pylist()), ">u4").reshape(-1, 8).astype(np.uint32)


def _bytes(words: np.ndarray) -> list[bytes]:
    whole = words.astype(">u4").tobytes()
    return [whole[i : i + 32] for i in range(0, len(whole), 32)]


def _grown(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Packs with their parents (`nodes`, level by level) and the digest that remains."""
    for batch in batches:
        nodes_of = batch.column("nodes")
        sizes = pc.list_value_length(nodes_of).to_pylist()
        level = _words(nodes_of.flatten().field("digest"))
        depth = [_depth(n, levels) for n in batch.column("n").to_pylist()]
        kept: list[list[bytes]] = [[] for _ in sizes]
        done: list[bytes] = [b""] * len(sizes)
        live = list(range(len(sizes)))
        for s in range(levels + 1):
            cut, at, left = [], 0, []
            for i in live:
                if depth[i] == s:  # one node is left
                    done[i] = _bytes(level[at : at + 1])[0]
                else:
                    cut.append(level[at : at + sizes[i]])
                    left.append(i)
                at += sizes[i]
            if not left:
                break
            made = parents(np.concatenate(cut), [sizes[i] for i in left])
            level, at, live = digests(made), 0, left
            for i in left:
                sizes[i] = -(-sizes[i] // FAN)
                kept[i].append(made[at : at + sizes[i]].tobytes())
                at += sizes[i]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b"".join(x) for x in kept], pa.binary()), pa.array(done, pa.binary())], names=[*batch.schema.names, "records", "digest"])


def _parsed(batch: pa.RecordBatch, levels: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each pack: its nodes, levels, records, and the steps above it."""
    sizes = pc.list_value_length(batch.column("nodes")).to_pylist()
    depth = [_depth(n, levels) for n in batch.column("n").to_pylist()]
    records = [np.frombuffer(x, RECORD) for x in batch.column("records").to_pylist()]
    above = [np.frombuffer(x, STEP) for x in batch.column("path").to_pylist()]
    return list(zip(sizes, depth, records, above, strict=True))


def _starts(size: int, depth: int) -> list[int]:
    """Where each level's parents begin among a pack's records."""
    out, at = [], 0
    for _ in range(depth):
        out.append(at)
        size = -(-size // FAN)
        at += size
    return out


_DOWN = T.StructType([T.StructField("key", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("id", T.StringType()), T.StructField("path", T.BinaryType())])


def _handed_down(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """For each node of a pack, the steps from it to the root."""
    for batch in batches:
        paths = []
        for size, depth, records, above in _parsed(batch, levels):
            starts = _starts(size, depth)
            own = np.zeros((size, depth), STEP)
            c = np.arange(size)
            for s in range(depth):
                own[:, s]["slot"] = c >> 3 * s & 7
                own[:, s]["record"] = records[starts[s] + (c >> 3 * (s + 1))]
            tail = above.tobytes()
            paths += [x.tobytes() + tail for x in own]
        flat = batch.column("nodes").flatten()
        owner = pc.list_parent_indices(batch.column("nodes"))
        out = [batch.column("key").take(owner), flat.field("pos"), flat.field("id"), pa.array(paths, pa.binary())]
        yield pa.RecordBatch.from_arrays(out, names=["key", "pos", "id", "path"])


def _folded(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """For each leaf the hash of its proof, and the root that its claimed digest gives."""
    for batch in batches:
        packs = _parsed(batch, levels)
        flat = batch.column("nodes").flatten()
        owner = pc.list_parent_indices(batch.column("nodes"))
        records = np.concatenate([np.zeros(0, RECORD), *[x for _, _, r, above in packs for x in (r, above["record"])]])
        text = [x.astype(">u4").tobytes().hex().encode() for x in records["children"]]
        count = records["count"].astype(int)
        text = [x[: 64 * n] for x, n in zip(text, count.tolist(), strict=True)]
        most = max([depth + len(above) for _, depth, _, above in packs], default=0)
        total = sum(size for size, *_ in packs)
        at, slot = np.full((most, total), -1), np.zeros((most, total), np.int64)
        proofs, base, begin = [], 0, 0
        for size, depth, own, above in packs:
            c, cols = np.arange(size), slice(begin, begin + size)
            for s, start in enumerate(_starts(size, depth)):
                at[s, cols], slot[s, cols] = base + start + (c >> 3 * (s + 1)), c >> 3 * s & 7
            up = base + len(own)
            for k in range(len(above)):
                at[depth + k, cols], slot[depth + k, cols] = up + k, above["slot"][k]
            tail = b"".join(text[up + k][: 64 * s] + text[up + k][64 * s + 64 :] for k, s in enumerate(above["slot"].tolist()))
            where, place = at[:depth, cols].T.tolist(), slot[:depth, cols].T.tolist()
            for a, b in zip(where, place, strict=True):
                near = b"".join(text[r][: 64 * s] + text[r][64 * s + 64 :] for r, s in zip(a, b, strict=True))
                proofs.append(hashlib.sha256(near + tail).hexdigest())
            base, begin = up + len(above), begin + size
        now = _words(flat.field("claim"))
        for s in range(most):
            go = np.flatnonzero(at[s] >= 0)
            now[go] = resumed(records, at[s][go], slot[s][go], now[go])
        roots = [x.hex() for x in _bytes(now)]
        take = lambda name: batch.column(name).take(owner)
        leaf = [x.hex() for x in flat.field("digest").to_pylist()]
        out = [flat.field("id"), pa.array(leaf, pa.string()), take("subroot"), take("root"), pa.array(proofs, pa.string()), pa.array(roots, pa.string())]
        yield pa.RecordBatch.from_arrays(out, names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def row_digest(values: list[Column]) -> Column:
    """SHA-256 (32 bytes) of values: each `-` if null, else its UTF-8 bytes counted, `:`, itself."""
    parts = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with pos, from 0 in the order `by` of their key, and the key's rows n. The order
    is cut into ranges of all rows, so a key of any size is spread; equal rows too."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    order = ["key", *by, "tie"]
    dealt = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = util.stored(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    ranges = ranged.groupBy("key", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("key")
    before = F.coalesce(F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n"))
    placed = ranged.withColumn("part", part).join(ranges, ["key", "part"])
    return placed.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _packed(nodes: DataFrame, levels: int) -> DataFrame:
    """Stored packs of nodes (key, n, pos, id, digest, claim): at most FAN ** levels to a
    row, with the records that grow on them."""
    entry = F.struct("pos", "id", "digest", "claim")
    packs = nodes.groupBy("key", "n", F.floor(F.col("pos") / FAN**levels).alias("pack")).agg(F.sort_array(F.collect_list(entry)).alias("nodes"))
    kind = T.StructType([*packs.schema.fields, T.StructField("records", T.BinaryType()), T.StructField("digest", T.BinaryType())])
    return util.stored(packs.mapInArrow(partial(_grown, levels=levels), kind))


def _tree(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Packs of every round; those of a key that fits one pack hold its last node."""
    rounds, size = [_packed(nodes, levels)], FAN**levels
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > size:
        up = rounds[-1].where(F.col("n") > size).select("key", F.ceil(F.col("n") / size).alias("n"), F.col("pack").alias("pos"), F.lit(None).cast("string").alias("id"), "digest", F.lit(None).cast("binary").alias("claim"))
        rounds.append(_packed(up, levels))
        most = -(-most // size)
    return rounds


def _tops(rounds: list[DataFrame], levels: int) -> DataFrame:
    """(key, digest) of what remains of each key."""
    out = None
    for packs in rounds:
        part = packs.where(F.col("n") <= FAN**levels).select("key", "digest")
        out = part if out is None else out.union(part)
    return out


def _with_paths(rounds: list[DataFrame], last: DataFrame, levels: int) -> DataFrame:
    """The first round's packs with `path`, the steps above them, and what else last (key,
    path, ...) has for their key."""
    more = [c for c in last.columns if c not in ("key", "path")]
    handed = None
    for r in range(len(rounds) - 1, -1, -1):
        packs = rounds[r].drop("digest")
        own = packs.where(F.col("n") <= FAN**levels).join(last, "key")
        if handed is not None:
            far = packs.where(F.col("n") > FAN**levels).join(handed, ["key", "pack"])
            own = own.unionByName(far.join(last.drop("path"), "key"))
        if r:
            handed = util.stored(own.drop(*more).mapInArrow(partial(_handed_down, levels=levels), _DOWN).select("key", F.col("pos").alias("pack"), "path"))
    return own


def merkle_manifest(df: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", changed: Column | None = None, changes: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each of df.

    leaf is the digest of `columns`, subroot its group's, root the table's. proof_sha256 is
    the hash of the leaf's siblings, level by level to the root, left to right. Rows where
    `changed` holds are claimed to have the values `changes` in place of their own;
    folded_root is the root that the claimed row (else the row itself) gives with the
    original siblings, and verified whether it is the root.

    Null values are digested as `-`; a null group is one of its own and comes first, as does
    a null id; equal ids ascend by digest, and rows equal in all columns are leaves of their
    own with equal digests, in either order. Texts may have any length. A lone leaf is its
    group's subroot. An empty table gives an empty result; other columns take no part.
    """
    col = lambda name: F.col(f"`{name}`")
    key = F.when(col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), col(group_col).cast("string")))
    leaf = row_digest([col(c) for c in columns])
    claim = leaf
    if changed is not None:
        claim = F.when(changed, row_digest([(changes or {}).get(c, col(c)) for c in columns])).otherwise(leaf)
    leaves = util.stored(df.select(key.alias("key"), col(id_col).alias("id"), leaf.alias("digest"), claim.alias("claim")))
    numbered = _numbered(leaves, ["id", "digest"])
    rounds = _tree(numbered, levels)
    names = {"key": F.lit(""), "id": F.col("key"), "digest": F.col("digest"), "claim": F.lit(None).cast("binary")}
    groups = util.stored(_tops(rounds, levels))
    above = _tree(_numbered(groups.select(*[c.alias(k) for k, c in names.items()]), ["id"]), levels)
    top = _tops(above, levels).first()  # one row, or none of an empty table
    root = F.lit(top["digest"].hex() if top else None).cast("string")
    start = _tops(above, levels).select("key", F.lit(b"").alias("path"))
    to_root = _with_paths(above, start, levels).mapInArrow(partial(_handed_down, levels=levels), _DOWN).select(F.col("id").alias("key"), "path")
    last = to_root.join(groups.select("key", F.lower(F.hex("digest")).alias("subroot")), "key").withColumn("root", root)
    packs = _with_paths(rounds, util.stored(last), levels)
    util.dropped(leaves)
    out = T.StructType([T.StructField("id", leaves.schema["id"].dataType), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]])
    folded = packs.select("key", "n", "pack", "nodes", "records", "path", "subroot", "root").mapInArrow(partial(_folded, levels=levels), out)
    return folded.withColumnRenamed("id", id_col).withColumn("verified", F.col("folded_root") == F.col("root"))
