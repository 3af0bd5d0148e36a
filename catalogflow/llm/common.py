"""What the operators share: tables, a place to cut lineage, word hashing in numpy."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: \x20 and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset the session must be a local one (tests); then a temporary folder of this
    machine is set, as all threads live here.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="catalogflow-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Rows that go to a Python worker at once while a table is cut: whole texts, so not many.
ARROW_ROWS = 1_000


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there.

    Columnar and compressed, so smaller than a checkpoint of rows, and a lost executor costs no
    more than reading it again. The folder goes with :func:`release`, at the latest when the driver's
    JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(int(batch), ARROW_ROWS) if int(batch) > 0 else ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    where, fs = _folder(spark, path)
    fs.deleteOnExit(where)
    read = spark.read.schema(df.schema).parquet(path)
    read._cut_path = path
    return read


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Delete the folders of tables that :func:`cut` returned and that nothing reads any more."""
    for df in tables:
        where, fs = _folder(df.sparkSession, df._cut_path)
        fs.delete(where, True)


#: A cut table is broadcast up to so many bytes in its files (rows of numbers take some four times
#: as many in memory).
BROADCAST_BYTES = 4 << 20


def small(df: DataFrame, bytes_: int | None = None) -> DataFrame:
    """Hint a broadcast of ``df``, a table that was cut, if its files hold at most ``bytes_``
    (BROADCAST_BYTES); else leave it as it is, for a join that shuffles."""
    where, fs = _folder(df.sparkSession, df._cut_path)
    size = fs.getContentSummary(where).getLength()
    return F.broadcast(df) if size <= (BROADCAST_BYTES if bytes_ is None else bytes_) else df


def given_back(batches: Iterator) -> Iterator:
    """The items of a task's iterator; after the last, what the task has freed goes back to the system. Workers are
    used again by later stages, whose tasks need the memory, and an allocator keeps it otherwise."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any case of letters."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id) -> "F.Column":
    """True for the fold that no model learns from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# Hashing of bytes and of words in numpy.

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CHUNK = 1 << 20


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240131)
    of_byte = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    odd = 0x9E3779B97F4A7C15
    power, inverse = (np.full(_CHUNK + (1 << 16), p, np.uint64) for p in (odd, pow(odd, -1, 1 << 64)))
    power[0] = inverse[0] = 1
    return of_byte, np.cumprod(power), np.cumprod(inverse)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    _, power, inverse = _tables()
    if n <= len(power):
        return power[:n], inverse[:n]
    long = [np.full(n, x[1], np.uint64) for x in (power, inverse)]
    for x in long:
        x[0] = 1
    return np.cumprod(long[0]), np.cumprod(long[1])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.translate(_LOWER) if lower else data).split()


#: Longer words count by a digest of their bytes; so many words are hashed at once.
_LONG_WORD, _AT_ONCE = 16, 50_000
_PLACES = np.random.default_rng(20240202).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words: a polynomial over the bytes, from prefix sums, then mixed.

    A polynomial modulo 2**64 is weak on long regular strings, so words of more than 16 bytes stand in
    it as 17 bytes of their BLAKE2b.
    """
    out = np.empty(len(words), np.uint64)
    of_byte, power, inverse = _tables()
    for lo in range(0, len(words), _AT_ONCE):
        own = words[lo : lo + _AT_ONCE]
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        if lengths.max() > _LONG_WORD:
            own = list(own)
            for i in np.flatnonzero(lengths > _LONG_WORD).tolist():
                own[i], lengths[i] = hashlib.blake2b(own[i], digest_size=_LONG_WORD + 1).digest(), _LONG_WORD + 1
        data = np.frombuffer(b"".join(own), np.uint8)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(of_byte[data] * power[: len(data)], out=sums[1:])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        out[lo : lo + len(own)] = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed(out)


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words, in order; of the whole text if it has fewer.

    A run of up to 8 words is the sum of their hashes, each times an odd number drawn for its place; a
    longer run is a polynomial over them, from prefix sums.
    """
    if not words:
        return np.empty(0, np.uint64)
    k, n = min(k, len(words)), len(words)
    h = word_hashes(words)
    if k <= len(_PLACES):
        total = h[: n - k + 1] * _PLACES[0]
        for j in range(1, k):
            total += h[j : n - k + 1 + j] * _PLACES[j]
    else:
        power, inverse = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * power[:-1], out=sums[1:])
        total = (sums[k:] - sums[: n - k + 1]) * inverse[: n - k + 1]
    return mixed(total + np.uint64(k * 0x9FB21C651E98DF25 % 2**64))
