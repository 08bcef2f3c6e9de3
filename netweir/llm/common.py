"""Words, hashes, text keys and batch helpers shared by the corpus operators.

A word is a run of bytes other than space and \\x09-\\x0D, which is what bytes.split() cuts at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from netweir.session import ensure_checkpoint_dir

def n_words(text: Column) -> Column:
    """Words of a text, JVM-side; null and blank texts have none."""
    parts = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")
    return F.coalesce(F.size(F.array_remove(parts, "")), F.lit(0)).cast("long")


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_ROWS: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def written(frame: DataFrame, path: str) -> DataFrame:
    """The frame written as Parquet and read again.

    Each job costs the driver memory, whatever its size. So the rows are counted as they are written, and the
    reader is given the schema: neither takes a job of its own.
    """
    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    if "rows" in (found := seen.get):
        _ROWS[out] = found["rows"]
    return out


def row_count(frame: DataFrame) -> int:
    """Rows of a frame; no job for one that written() returned."""
    return _ROWS[frame] if frame in _ROWS else frame.count()


def staged(frame: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared checkpoint folder and read again.

    Smaller than checkpoint(), and Spark knows its size: a join broadcasts it if it is small, else not.
    """
    return written(frame, shared_folder(frame.sparkSession, "stage"))


@contextmanager
def staging(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A form of staged() for the steps of a job, which leaves nothing behind.

    Spark removes a step's shuffle files when its table is written, and the tables go at the end of the block,
    so what is still to be read then must have been written outside of it.
    """
    folder, cleanup = shared_folder(spark, "stages"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    paths = []

    def stage(frame: DataFrame) -> DataFrame:
        path = f"{folder}/{len(paths)}"
        paths.append(path)
        before = spark.conf.get(cleanup, "false")
        spark.conf.set(cleanup, "true")
        try:
            return written(frame, path)
        finally:
            spark.conf.set(cleanup, before)

    try:
        yield stage
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(frame: DataFrame, row_bytes: int, most: int = 64 << 20) -> DataFrame:
    """A written frame for the small side of a join: broadcast if its counted rows fit `most` bytes, else as it is.

    Without the broadcast both sides are shuffled, to the same result.
    """
    return F.broadcast(frame) if row_count(frame) * row_bytes <= most else frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow for rows that hold whole texts: batches are bounded to 1,000 rows and 16 MB.

    Spark's default of 10,000 rows of long texts would fill a small executor; another setting of the session
    is kept.
    """
    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


#: functions that clear what a worker keeps between tasks of one kind
CACHES: list = []


def clear_caches() -> None:
    for clear in CACHES:
        clear()


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 4 << 20, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text column holds about max_bytes in each; one longer text stays whole.

    Unless `keep`, what the worker has kept of tasks of another kind goes first.
    """
    if not keep:
        clear_caches()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes.astype(np.int64)) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def raw(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one run of bytes, and where each begins, with the end of all; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    found = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return found[starts[0]:starts[-1]], starts - starts[0]


def strings_of(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The texts of one run of UTF-8 bytes as a string column."""
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data))


class WordHashes(dict):
    """XXH64 of words, kept for the next time; forgets all beyond a bounded number of entries."""

    def __init__(self, entries: int = 100_000):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.entries:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all of them."""
    x = (x ^ (x >> _B)) * _A
    x = (x ^ (x >> _B)) * _A
    return x ^ (x >> _B)


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; a shorter text is one run, an empty one has none."""
    n = min(n, len(word_hashes))
    if not n:
        return word_hashes
    k = len(word_hashes) - n + 1
    total = np.zeros(k, np.uint64)
    for j in range(n):
        total = mix64(total * np.uint64(31) + word_hashes[j:j + k] + np.uint64(j))
    return total


MAX_BITS = 26  # of the address in a bitmap, 8 MB; where more hashes are set, more others pass


class Bitmap:
    """A set of hashes by their upper bits: it has all that were put in, and some others."""

    def __init__(self, hashes: DataFrame, n: int | None = None):
        n = row_count(hashes) if n is None else n
        self.bits = min(MAX_BITS, max(12, (64 * n).bit_length()))
        cell = F.shiftrightunsigned("hash", 64 - self.bits)
        one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - self.bits}) & 63 as int))")
        found = hashes.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(one).alias("set")).toArrow()
        self.words = np.zeros(1 << self.bits - 6, np.uint64)
        self.words[found["at"].to_numpy()] = found["set"].to_numpy().view(np.uint64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        cell = hashes >> np.uint64(64 - self.bits)
        return (self.words[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)


def one_row_each(docs: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """docs joined to `keyed`, one row for each of its keys.

    keyed has the key columns (null-safe values), `__rows`, how many rows of docs share the key, and a few
    more bytes. Keys with several rows, which are equal in all that the key stands for, keep one of them.
    """
    single, several = keyed.where("__rows = 1"), keyed.where("__rows > 1")
    _ROWS[single], _ROWS[several] = keyed.agg(F.count_if(F.col("__rows") == 1), F.count_if(F.col("__rows") > 1)).first()
    once = docs.join(small_side(single, 64), keys)
    return once.unionByName(docs.join(small_side(several, 64), keys).dropDuplicates(keys))
