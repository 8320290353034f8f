"""Shared pieces: table reading, cutting lineage, and words of a batch of texts as numpy arrays."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import threading
import uuid
import weakref

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Words are runs of anything but these bytes; in a Java regex and in SQL the same class is written out.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_RE = "[^\\x20\\x09-\\x0D]+"
#: Texts are handled in slices of about so many bytes, so temporary arrays stay small whatever Spark's batches hold.
SLICE_BYTES = 1_000_000

IS_WORD = np.ones(256, bool)
IS_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: An odd multiplier: what is folded into a hash first is spread before the next comes.
FOLD = np.uint64(0x9E3779B97F4A7C15)
#: Words of up to so many bytes are hashed together, eight bytes at a time; longer ones one by one.
LONG_WORD = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own if Spark runs in
    this one process, as in tests; on a cluster that is an error, as no other machine would see its files."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="webmill-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


class _Stages(threading.local):
    """Tables made while a stage of a pipeline is set up: each thread has its own, so pipelines side by side do too."""

    def __init__(self):
        self.tables: list[tuple[SparkSession, str]] = []
        self.inside = 0


_stages = _Stages()
#: Where the tables are.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends here, and a lost executor costs nothing before it. Removed when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webmill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    if _stages.inside:
        _stages.tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


class Levels:
    """A table that grows level by level, each level a partition of its own, in the shared folder. Removed when the program ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema, self.n = spark, f"{shared_dir(spark)}/webmill-{uuid.uuid4().hex}", "", 0
        atexit.register(_remove, spark, self.path)
        if _stages.inside:
            _stages.tables.append((spark, self.path))

    def add(self, df: DataFrame, depth: int) -> DataFrame:
        """Writes df as this level and returns it as written."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/depth={depth}")
        self.schema, self.n = df.schema, self.n + 1
        return self.at(depth)

    def at(self, depth: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/depth={depth}")

    def all(self) -> DataFrame:
        """Every level, with the column depth."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("depth", IntegerType())])).parquet(self.path)


def drop(made: DataFrame) -> None:
    """Removes what table() wrote, once everything that reads it has been written itself."""
    if made in _paths:
        _remove(made.sparkSession, _paths.pop(made))


@contextlib.contextmanager
def stage():
    """Within it tables belong to a stage of a pipeline. Those of the stage before are removed now: its result has been
    written by the time that the next stage begins."""
    while _stages.tables:
        _remove(*_stages.tables.pop())
    _stages.inside += 1
    try:
        yield
    finally:
        _stages.inside -= 1


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before the program; the folder's owner cleans it
        pass


def crc32_of_id(col: str = "doc_id"):
    """crc32 of the id written in decimal, for held-out folds; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def text_arrays(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins (and the last ends). A null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1 + col.offset)[col.offset :] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """The batch in runs of whole rows with about `most` bytes of text; one long text is a run by itself."""
    _, off = text_arrays(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield batch.slice(i, j - i)
        i = j


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows: a batch of texts is held by the JVM and by Python at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def tidy() -> None:
    """Gives memory back at the end of a task: Spark keeps Python workers for later tasks, and they share a budget with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_texts(df: DataFrame, fn, schema: str) -> DataFrame:
    """df through fn, which takes slices of rows (texts in the column _s_text) and yields batches."""
    small_batches(df.sparkSession)

    def work(batches):
        for whole in batches:
            for part in slices(whole, "_s_text"):
                yield from fn(part)
        tidy()

    return df.mapInArrow(work, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def fold(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A hash of what h stands for, followed by x: each step spreads all bits, so no sums of powers can cancel out."""
    return mix(h * FOLD ^ x)


def eight_bytes(buf: np.ndarray) -> np.ndarray:
    """At each position the eight bytes that begin there, as one number; zeros follow the last."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray(len(buf) + 1, "<u8", padded.tobytes(), strides=(1,))


def runs(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, done, span, h = None, 0, 1, values
    while True:
        if width & span:
            part = h[done : len(values) - width + 1 + done]
            out = mix(part + np.uint64(span)) if out is None else fold(out, part)
            done += span
        span *= 2
        if span > width:
            return out
        h = fold(h[: -(span // 2)], h[span // 2 :])


def span_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each range values[first:last], whatever its length."""
    data, size = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize
    found = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip((first * size).tolist(), (last * size).tolist(), strict=True)]
    return np.array(found, np.uint64).view(np.int64)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and where each text's words begin in these."""
    n = len(buf)
    inside = IS_WORD[buf]
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (first[:n] | ~before))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return begin, end, np.searchsorted(begin, off)


def word_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = (end - begin).astype(np.uint64)
    out = mix(size + np.uint64(1))
    eight = eight_bytes(buf)
    live = np.flatnonzero(size <= LONG_WORD)
    step = 0
    while len(live):
        at, left = begin[live] + step, (size[live] - np.uint64(step))
        x = eight[np.minimum(at, len(buf))]
        part = left < 8
        x[part] &= (np.uint64(1) << (left[part] * np.uint64(8))) - np.uint64(1)
        out[live] = fold(out[live], x)
        step += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys, by doubling."""
    if len(keys) < width:
        return keys[:0]
    span, low = 1, keys
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def windows_by_anchor(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that have the same anchor.

    grams: a hash at each position; starts and ends: the positions at which each text's windows begin
    (a window at p takes the grams p .. p+width-1). The anchor of a window is its least gram, the leftmost
    of equal ones, so equal windows have their anchors at the same place. Returns first window, number of
    windows and anchor of each run.
    """
    if len(grams) < width:
        z = np.zeros(0, np.int64)
        return z, z, z
    bits = np.uint64(31)  # the same for every slice, so equal windows see equal keys
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    anchor = (window_min(packed, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int32)
    ok = ends > starts
    np.add.at(valid, starts[ok], 1)
    np.add.at(valid, ends[ok], -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    a = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
    text_start = np.zeros(len(anchor) + 1, bool)
    text_start[starts[ok]] = True
    new |= text_start[at]
    k = np.flatnonzero(new)
    return at[k], np.diff(np.append(k, len(at))), a[k]


def covered(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges [first, last), which are sorted by their beginning, as maximal ranges."""
    if not len(first):
        return first, last
    reach = np.maximum.accumulate(last)
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    k = np.flatnonzero(new)
    return first[k], reach[np.append(k[1:], len(first)) - 1]
