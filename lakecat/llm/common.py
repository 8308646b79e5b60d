"""What the operators share: the shared folder, document keys, words and blocks of texts.

A word is a maximal run of characters other than space and U+0009 to U+000D. On UTF-8 bytes that is what
``bytes.split()`` without arguments gives, so all code here works on encoded text.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words.
SPACES = " \t\n\x0b\f\r"
#: Regular expression class of the same characters, for Java and RE2.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is set, one of this machine in local mode, as in tests; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakecat-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class _Staged(threading.local):
    def __init__(self):
        self.paths: list[str] = []


#: Paths that this thread of the driver has staged and not deleted yet.
_STAGED = _Staged()


def staging(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/lakecat-{what}-{uuid.uuid4().hex}"
    _STAGED.paths.append(path)
    return path


def release(spark: SparkSession, kept: Iterable[str] = (), since: int = 0) -> None:
    """Delete what was staged, from the since-th path on, but for the kept paths; for when results that read it are not needed any more."""
    kept = set(kept)
    for path in _STAGED.paths[since:]:
        if path not in kept:
            drop_path(spark, path)


def staged_so_far() -> int:
    return len(_STAGED.paths)


def staged(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write df below the shared folder and read it back: cuts the lineage and survives lost executors."""
    return staged_at(df, staging(df.sparkSession, what), compression)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged_at(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """As staged, at a path of `staging`. The files of the job's own shuffles, which nothing reads once the rows are written, go with the job."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    if path in _STAGED.paths:
        _STAGED.paths.remove(path)


def crc_fold(column: str | Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo folds. A null id counts as fold 1: it is never held out."""
    id_ = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)), F.lit(1))


def blocks(batch: pa.RecordBatch, limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `limit` bytes of text each (one row at least), so that long texts do not add up."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    sizes = np.frombuffer(texts.buffers()[1], np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
    sizes -= sizes[0]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def encoded(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]


def out_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a polynomial hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def give_back() -> None:
    """Return what a task has freed to the system: Python workers live on, and idle ones count against the executor's memory."""
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


class Slots(dict):
    """Numbers keys in the order of their first look-up; `new` holds those not seen before."""

    def __init__(self, known: Iterable = ()):
        super().__init__((k, i) for i, k in enumerate(known))
        self.new: list = []

    def __missing__(self, key) -> int:
        at = self[key] = len(self)
        self.new.append(key)
        return at

    def taken(self) -> list:
        """The new keys; they are not new any more."""
        out, self.new = self.new, []
        return out


class Growing:
    """An array that entries are added to; room doubles, so that adding costs by what is added."""

    def __init__(self, dtype, start: Iterable = ()):
        start = np.asarray(start if isinstance(start, np.ndarray) else list(start), dtype)
        self._room, self._n = start.copy(), len(start)

    @property
    def all(self) -> np.ndarray:
        return self._room[: self._n]

    def add(self, values: np.ndarray) -> None:
        n = self._n + len(values)
        if n > len(self._room):
            room = np.empty(max(n, 2 * len(self._room)), self._room.dtype)
            room[: self._n] = self.all
            self._room = room
        self._room[self._n : n] = values
        self._n = n


class Powers:
    """Powers of an odd number modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.of = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.of) < n:
            step = np.uint64(int(self.of[-1]) * int(self.base) % (1 << 64))
            self.of = np.concatenate([self.of, self.of * step])
        return self.of[:n]


def _both(base: int) -> tuple[Powers, Powers]:
    return Powers(base), Powers(pow(base, -1, 1 << 64))


_BYTES, _WORDS = _both(0x9E3779B97F4A7C15), _both(0xD6E8FEB86659FD93)


#: Entries that are hashed at a time.
_SPAN = 1 << 20


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: tuple[Powers, Powers]) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair; equal for equal content, wherever and in whichever array it stands.

    Starts and ends ascend. Work and memory go by spans of values, so that powers are as few as a span or the longest range.
    """
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _SPAN, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        first, last = starts[a:b] - lo, ends[a:b] - lo
        up, down = (p.upto(hi - lo + 1) for p in powers)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((values[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        out[a:b] = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        a = b
    return out


def byte_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(values, starts, ends, _BYTES)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries."""
    at = np.arange(max(0, len(words) - k + 1))
    return range_hashes(words, at, at + k, _WORDS)
