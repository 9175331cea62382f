"""What the operators of this package share: tables, staging, word arrays."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "own" not in _OWN_DIR:
        _OWN_DIR["own"] = "file://" + tempfile.mkdtemp(prefix="framewright-")
    return _OWN_DIR["own"]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/framewright/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---- memory of Python workers -------------------------------------------------------------------------------

#: Rows that Spark hands to a Python worker at once. Texts are cut further by `chunks`; this bounds what is in flight before.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows an Arrow batch to BATCH_ROWS; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def trimmed(run):
    """A function for mapInArrow that gives free memory back to the system when a task ends: workers are used again by other stages."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # no glibc
                pass

    return wrapped


# ---- words as arrays ---------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLDED = _BYTE[_LOWER]

#: Byte classes. SPACED: runs of anything but ASCII white space. WORDED: runs of ASCII letters and digits and of all bytes beyond ASCII.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
WORDED = np.zeros(256, dtype=bool)
WORDED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
#: Values that are hashed at once: what bounds the tables of powers, however long a text is.
BLOCK = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 to n - 1, mod 2^64; kept, and grown by doubling."""
    for k, base in enumerate((_BASE, _INVERSE)):
        have = _POWERS[k]
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
        _POWERS[k] = have
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A polynomial hash of each stretch of v, by blocks; first: where each stretch begins, one longer."""
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    for p in range(0, len(v), BLOCK):
        part = v[p : p + BLOCK]
        power, inverse = _powers(BLOCK + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        t = np.arange(int(np.searchsorted(first, p, side="right")) - 1, int(np.searchsorted(first, p + len(part))))
        t = t[t < len(out)]
        a, b = np.maximum(first[t] - p, 0), np.minimum(first[t + 1] - p, len(part))
        shift = inverse[a]
        if first[t[0]] < p:
            shift[0] = pow(_BASE, int(p - first[t[0]]), 2**64)
        out[t] += (total[b] - total[a]) * shift
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column, "").cast(pa.large_string())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


class Words:
    """The words of a run of texts: hash (64 bits, A-Z folded), start and end byte, and where each text's words begin (first, one longer)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray = WORDED):
        n = len(data)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = kind[data]
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside[:n]
        cut = np.zeros(n + 1, dtype=bool)
        cut[at] = True
        self.start = np.flatnonzero(inside & (~before | cut))
        self.end = np.flatnonzero(before & (~inside | cut))
        del inside, before, cut
        self.hash = mix(self._sums(data))
        self.first = np.searchsorted(self.start, at)
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def _sums(self, data: np.ndarray) -> np.ndarray:
        """A polynomial hash of each word, by blocks of whole words; of a word longer than a block, piece by piece."""
        out = np.empty(len(self.start), dtype=np.uint64)
        power, inverse = _powers(BLOCK + 1)
        i = 0
        while i < len(out):
            a = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, a + BLOCK, side="right")))
            if self.end[i] - a > BLOCK:
                h = 0
                for p in range(a, int(self.end[i]), BLOCK):
                    piece = _FOLDED[data[p : min(p + BLOCK, int(self.end[i]))]]
                    h += int((piece * power[: len(piece)]).sum()) * pow(_BASE, p - a, 2**64)
                out[i] = h % 2**64
            else:
                part = _FOLDED[data[a : self.end[j - 1]]]
                total = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(part * power[: len(part)], out=total[1:])
                at = self.start[i:j] - a
                out[i:j] = (total[self.end[i:j] - a] - total[at]) * inverse[at]
            i = j
        return out

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k words in a row within a text, and the word at which each begins."""
        h, n = self.hash, len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            total = total * np.uint64(_BASE) + h[j : j + n]
        begin = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return mix(total[begin] + np.uint64(k)), begin


def chunks(batches, text: str, most: int = 4_000_000):
    """Record batches cut so that the texts of each have at most so many bytes, or are a single text."""
    for batch in batches:
        n, sizes = batch.num_rows, None
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes), 0
        while begin < n:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column over values; first has where each row's begin, one longer than the rows."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, type=kind))


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
