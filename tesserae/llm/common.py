"""Shared pieces: reading tables, cutting lineage in the shared folder, vectorised word hashing.

Word hashing works on UTF-8 bytes with numpy: one pass over a block of texts gives the bounds
and 64-bit hashes of all words in it, so that no Python code runs once per word.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked on in blocks of about so many bytes, which bounds a worker's memory.
BLOCK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of long texts stay small, so that a Python worker's memory is bounded."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def trim() -> None:
    """Give freed memory back to the system: workers outlive their tasks, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if give_back is not None:
        give_back(0)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow whose worker keeps no freed memory from batch to batch, or after the last."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in run(batches):
                yield out
                del out
                trim()
        finally:
            trim()

    return trimmed


class Scratch:
    """Tables written to the folder named in spark.checkpoint.dir, which all executors share.

    Each cut ends the lineage: a lost executor costs a reread, not a recomputation. Where the
    setting is missing and the master is local (tests), a temporary folder is set instead.
    Operators drop their tables as soon as nothing reads them; those that a returned DataFrame still reads
    go when the driver ends, or with Scratch.clean().
    """

    _roots: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
            root = found.get() if found.isDefined() else None
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
            root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        self.spark, self.root = spark, f"{root.rstrip('/')}/tesserae/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.made: dict[str, DataFrame] = {}
        Scratch._roots[self.root] = spark

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write a table and read it again."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.made[path] = out
        return out

    def keep(self, *dfs: DataFrame) -> None:
        """Delete all cut tables but these."""
        kept = {df._scratch_path for df in dfs}
        self.drop(*[df for path, df in self.made.items() if path not in kept])

    def drop(self, *dfs: DataFrame) -> None:
        """Delete cut tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in dfs:
            self.made.pop(df._scratch_path, None)
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps."""
        gc.collect()
        self.spark._jvm.System.gc()

    @classmethod
    def clean(cls) -> None:
        """Delete all tables of this driver that are still there. DataFrames that read them can't be used any more."""
        while cls._roots:
            root, spark = cls._roots.popitem()
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def _at_exit() -> None:
    try:
        Scratch.clean()
    except (Py4JError, OSError):  # the JVM has gone before: the folder stays as Spark's own checkpoints do
        pass


atexit.register(_at_exit)


# --- word hashing ---------------------------------------------------------------------------

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _PRIME)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators of words that end at white space: space and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Separators of words made of ASCII letters, digits and anything beyond ASCII, after lower-casing.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[48:58] = NON_ALNUM[97:123] = NON_ALNUM[128:] = False

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, for n positions at least."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES * 2)
        inverse = _U(pow(int(_PRIME), -1, 1 << 64))
        up, down = np.full(m, _PRIME, _U), np.full(m, inverse, _U)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)]
    return _powers[0], _powers[1]


def _hash_block(block: bytes, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = _LOWER[np.frombuffer(block, np.uint8)]
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~sep[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _power_tables(len(b) + 1)
    total = np.empty(len(b) + 1, _U)
    total[0] = 0
    np.cumsum(_BYTE_CODE[b] * up[: len(b)], dtype=_U, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return starts, ends, mix(h ^ (ends - starts).astype(_U) * _PRIME)


def word_blocks(texts: list[bytes | None], sep: np.ndarray) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole texts: (first row, texts, word counts, starts, ends, hashes).

    starts and ends are byte positions within each word's own text. A null text has no words.
    A text longer than a block is hashed piece by piece, cut at separators.
    """
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") < BLOCK_BYTES):
            size += len(texts[j] or b"") + 1
            j += 1
        rows = texts[i:j]
        if len(rows) == 1 and size > 2 * BLOCK_BYTES:
            starts, ends, hashes = _long(rows[0], sep)
            counts = np.array([len(starts)])
        else:
            lens = np.array([len(t or b"") + 1 for t in rows])
            at = np.concatenate([[0], np.cumsum(lens)])
            starts, ends, hashes = _hash_block(b"\n".join(t or b"" for t in rows), sep)
            bounds = np.searchsorted(starts, at)
            counts = np.diff(bounds)
            shift = np.repeat(at[:-1], counts)
            starts, ends = starts - shift, ends - shift
        yield i, rows, counts, starts, ends, hashes
        i = j


def _long(text: bytes, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, i = [], 0
    low = bytes(int(x) for x in _LOWER)
    seps = frozenset(int(x) for x in np.flatnonzero(sep))
    while i < len(text):
        j = min(i + BLOCK_BYTES, len(text))
        while j < len(text) and low[text[j]] not in seps:  # to the end of a word
            j += 1
        s, e, h = _hash_block(text[i:j], sep)
        parts.append((s + i, e + i, h))
        i = j
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def texts_of(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes; null stays None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
