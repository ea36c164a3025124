"""What the operators of this subpackage share: table access, staging, byte kernels for Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.session import shared_dir

CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a staged frame that nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Spark's estimate of the bytes that df reads; where it has none, 64 MB a shuffle partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * (64 << 20)


# --- bytes ---------------------------------------------------------------------------------------------------


def byte_values(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null counts as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Returns freed memory to the system at a task's end: workers stay for the next stage, which may need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(values: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of values that hold about `limit` bytes; a longer value is alone."""
    a = size = 0
    for b, v in enumerate(values):
        if size and size + len(v) > limit:
            yield a, b
            a, size = b, 0
        size += len(v)
    if a < len(values):
        yield a, len(values)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if _powers["n"] < n:
        size = max(n, CHUNK_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """h with h[j] - h[i] the hash of data[i:j] times base**i; n + 1 values. fold: A-Z count as a-z."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_TABLE[_LOWER] if fold else _TABLE)[data] * powers(len(data))[0], out=h[1:])
    return h


#: Classes of bytes that words consist of.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False


def word_hashes(text: bytes, word_byte: np.ndarray = SPACED) -> np.ndarray:
    """64-bit hashes of the lower-cased (A-Z) words of one text, in order."""
    return batch_words([text], word_byte)[0]


def batch_words(texts: list[bytes], word_byte: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts one after the other, and each text's number of words."""
    out, counts = [], np.zeros(len(texts), np.int64)
    for a, b in chunks(texts):
        if b - a == 1 and len(texts[a]) > 4 * CHUNK_BYTES:  # a very long text goes in pieces, cut between words
            text, at = texts[a], 0
            while at < len(text):
                end = min(len(text), at + CHUNK_BYTES)
                while end < len(text) and word_byte[text[end]]:
                    end += 1
                h, n = batch_words_of(text[at:end], np.array([0, end - at]), word_byte)
                out.append(h)
                counts[a] += n[0]
                at = end
            continue
        sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        h, counts[a:b] = batch_words_of(b" ".join(texts[a:b]) + b" ", bounds, word_byte)
        out.append(h)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def batch_words_of(joined: bytes, bounds: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = word_byte[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = prefix_hash(data, fold=True)
    out = mix((h[ends] - h[starts]) * powers(len(data) + 1)[1][starts])
    return out, np.diff(np.searchsorted(starts, bounds))


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k consecutive words of each text (of all its words if it has fewer), and how many each text has."""
    ends = np.cumsum(counts)
    starts = ends - counts
    have = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.repeat(starts - (np.cumsum(have) - have), have) + np.arange(have.sum())
    acc = np.full(len(first), np.uint64(k), np.uint64)
    length = np.repeat(np.minimum(counts, k), have)
    for j in range(k):
        use = j < length
        nxt = words[np.minimum(first + j, max(len(words) - 1, 0))] if len(words) else acc
        acc = np.where(use, mix((acc ^ nxt) + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))), acc)
    return acc, have


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column whose rows take the next `counts` values each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
