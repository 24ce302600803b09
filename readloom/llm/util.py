"""Helpers shared by the training-data operators.

Text reaches Python as Arrow buffers; the helpers here give numpy views of the
UTF-8 bytes, so that no Python string is made for a whole text.
"""

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only white space that splits words here.
SPACE = r"[\x20\x09-\x0D]+"
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the one the cluster names in
    spark.checkpoint.dir. Where it is unset, a local session gets a temporary one (driver
    and executors are one process there); a cluster must name it."""
    sc = spark.sparkContext
    place = sc.getCheckpointDir()
    if place is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        place = sc.getCheckpointDir()
    return place


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again. This cuts the
    lineage with files that outlive any executor, and avoids a second computation. The
    shuffle files of the writing job are given back when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote, once nothing that is still to run reads them."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if folder.getName().startswith("table-"):
                folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the rows of an Arrow batch, since a row may hold a very long text. The bound
    of the session is only ever lowered, so that no operator undoes another's."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Groups up to this many are broadcast (some 50 bytes each); of more, only the hot ones,
#: with at least HOT_ROWS rows each, so rows / HOT_ROWS of them at most.
MAX_BROADCAST = 500_000
HOT_ROWS = 100_000


def with_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """rows joined (left) to groups, one row for each key with `size` rows at most, so
    that no key gathers its rows in one task. groups should be a stored table."""
    if groups.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(groups), key, "left")
    (mark,) = free_name(rows, "is_hot")
    hot, cold = groups.where(F.col(size) >= HOT_ROWS), groups.where(F.col(size) < HOT_ROWS)
    marked = rows.join(F.broadcast(hot.select(*key, F.lit(True).alias(mark))), key, "left")
    some = marked.where(F.col(mark)).drop(mark).join(F.broadcast(hot), key)
    return some.unionByName(marked.where(F.col(mark).isNull()).drop(mark).join(cold, key, "left"))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def memory_returned() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside those
    of other stages. Where the C library has no such call, only Arrow's pool is cleared."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and len(texts) + 1 offsets. Null is empty."""
    memory_returned()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, at, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 2**64)
_POWER: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept between calls."""
    have = _POWER.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        have = _POWER[name] = np.cumprod(steps, dtype=U64)
    return have[:n]


_BYTE = mixed(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of a batch: 64-bit hashes, start and end bytes,
    and for each text the index of its first word (len + 1 values). With letters (256 flags),
    words are the longest runs of such bytes instead."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, np.zeros(len(offsets), np.int64)
    if lower:
        data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13))) if letters is None else letters[data]
    # a word also ends where its text ends
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:n]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    # sum of byte values times powers; shifted to the word's start by the inverse power
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * _powers("up", _P, n), out=total[1:])
    h = (total[end] - total[begin]) * _powers("down", _INVERSE, n)[begin]
    return mixed(h + (end - begin).astype(U64)), begin, end, np.searchsorted(begin, offsets)


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, len(word) - k + 1 values (crossing texts too)."""
    m = len(word) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(word) + 1, U64)
    np.cumsum(word * _powers("up", _P, len(word)), out=total[1:])
    return mixed((total[k:] - total[:-k]) * _powers("down", _INVERSE, m))


def slabs(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 18):
    """Cut a batch at text borders into parts of about `size` bytes: (from, to) texts."""
    a = 0
    while a < len(offsets) - 1:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(max(b, a + 1), len(offsets) - 1)
        yield a, b
        a = b
