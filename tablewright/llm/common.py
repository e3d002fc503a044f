"""Shared pieces of the training-data operators: storage, and numpy text kernels.

The kernels work on Arrow string buffers (UTF-8 bytes plus offsets) without
building Python strings, a few megabytes at a time: their memory is bounded by
SLICE_BYTES, or by the longest single text where that is longer.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at a time.
SLICE_BYTES = 2_000_000
#: Bytes of text whose hashes one reducer gathers, on average: bounds its memory at every input size.
BUCKET_BYTES = 128_000_000
#: Rows of a narrow table between two steps that one file holds, where their number is known.
FILE_ROWS = 50_000


# ------------------------------------------------------------------ storage

_OWN: dict[str, str] = {}
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    A folder of our own is used only where the session names none and all its
    threads are on this machine, as in tests: one for each application, deleted
    when the process ends. On a cluster a missing setting is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {context.master} share")
        app = context.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tablewright-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        there = f"file://{_OWN[app]}"
    return there.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tablewright/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def materialize(df: DataFrame, label: str, most_rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there.

    most_rows is a bound on its rows, where one is known: then no more tasks write
    than these rows need files, or the session has cores. Every file costs, and
    in a local folder without Hadoop's native library the executor's JVM forks
    three times for it (chmod).
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if most_rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-most_rows // FILE_ROWS)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def materialize_counted(df: DataFrame, label: str, most_rows: int | None = None, **counts: Column) -> tuple[DataFrame, dict]:
    """materialize, and aggregates of the rows, taken while they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(name) for name, c in counts.items()]), label, most_rows)
    return out, seen.get


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize wrote for these frames, which nothing may read any more."""
    for frame in frames:
        path = _WRITTEN.pop(frame, None)
        if path:
            _delete(frame.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder.

    Results that haven't been read or written yet depend on it: call it after.
    """
    _delete(spark, _own_dir(spark))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets_for(texts: DataFrame, text_col: str = "text") -> int:
    """Reducers for hashes of these texts: one for BUCKET_BYTES of text, and no fewer than the session's partitions."""
    size = texts.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(partitions(texts.sparkSession), -(-size // BUCKET_BYTES))


#: Keys that a join treats as hot, at most; and rows that any task can take of one key.
MOST_HOT, LEAST_HOT = 10_000, 100_000


def hot_from(total: int) -> int:
    """Rows from which on a key is hot, of so many in all: MOST_HOT keys have that many, at most."""
    return max(LEAST_HOT, -(-total // MOST_HOT))


def spread_join(rows: DataFrame, values: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", most: int | None = None) -> DataFrame:
    """rows with the columns of values, which has each key once; no task gets all rows of a hot key.

    weight is the column of values that says how many rows a key has (or more),
    total their sum, and most the largest of them, where that is known. A key is
    hot if it has LEAST_HOT rows and a MOST_HOTth of the total: there are MOST_HOT
    such keys at most, and these alone are broadcast. The others are joined by
    merge, as all are where none can be hot.
    """
    least = hot_from(total)
    if (total if most is None else most) < least:
        return rows.join(values.hint("merge"), on, how).select(*rows.columns, *[c for c in values.columns if c not in on])
    # Whole structs: so both uses of values need the same columns, and share what makes them.
    given = values.select(*on, F.struct(*[c for c in values.columns if c not in on]).alias("__given"))
    met = rows.join(F.broadcast(given.where(F.col("__given")[weight] >= least)), on, "left")
    cold = met.where("__given is null").drop("__given").join(given.where(F.col("__given")[weight] < least).hint("merge"), on, how)
    both = cold.unionByName(met.where("__given is not null"))
    return both.select(*rows.columns, "__given.*")


# ------------------------------------------------------------------ memory

def _give_back() -> None:
    """Hands memory that is free in this process to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable) -> Callable:
    """run, over batches, after which the worker keeps no memory that it freed: workers live on, idle, while the JVM works."""

    @wraps(run)
    def over(batches):
        yield from run(batches)
        _give_back()

    return over


def trimmed_group(run: Callable) -> Callable:
    """The same of a function from one group's table to another table."""

    @wraps(run)
    def over(table: pa.Table) -> pa.Table:
        out = run(table)
        _give_back()
        return out

    return over


# ------------------------------------------------------------------ rows

#: Tag of the rows without an id.
NO_ID = 0xFFFFFFFF


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """(doc, tag), by which rows are told apart and put in order.

    doc is the id, and tag a hash of the text, so that texts of one id are
    documents of their own; without an id, doc is a hash of the text and tag is
    NO_ID. Order: rows with an id first, then doc, then tag. Rows that are equal
    in id and text have the same key: they are one document.
    """
    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    doc = F.coalesce(key, F.xxhash64(text, F.lit(23)))
    tag = F.when(key.isNull(), F.lit(NO_ID)).otherwise(F.pmod(F.xxhash64(text, F.lit(29)), F.lit(NO_ID)))
    return doc, F.coalesce(tag, F.lit(0)).cast("long")  # never null, as the planner sees it too


def crc_rest(key: str, modulus: int):
    """crc32 of the decimal text of a key, modulo a number (null: -1, in no fold)."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


# ------------------------------------------------------------------ buffers

def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each (one row at least)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


# ------------------------------------------------------------------ hashing

_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        for key, base in (("up", _R), ("down", _RINV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalising bit mixer for 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RangeHash:
    """64-bit hashes of any ranges of one byte array, each in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


# ------------------------------------------------------------------ words

#: A-Z become a-z; every other byte is kept.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, lower-case letters, and all bytes of characters from U+0080.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: The same as a regular expression over lower-cased text.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Words:
    """The words of a slice of texts: byte ranges, row of each, 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[data]
        inside = IS_WORD[self.low]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before &= ~edge[:n]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets[:-1], self.start, "right") - 1
        rows = len(offsets) - 1
        self.first = np.searchsorted(self.row, np.arange(rows + 1))
        self.hash = RangeHash(self.low)(self.start, self.end) if n else np.zeros(0, np.uint64)

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of each row's shingles, in order.

    A row with fewer words, but not none, has one shingle of all its words.
    """
    h, n = words.hash, len(words.hash)
    count = words.count()
    per_row = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    first = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(first[-1], np.uint64)
    if n == 0:
        return out, first
    long = np.flatnonzero(count >= size)
    rows = np.repeat(long, per_row[long])
    begin = words.first[rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(per_row[long]) - per_row[long], per_row[long]))
    acc = np.zeros(len(begin), np.uint64)
    for k in range(size):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[begin + k])
    out[first[rows] + (begin - words.first[rows])] = acc
    for r in np.flatnonzero((count > 0) & (count < size)):
        acc = np.uint64(count[r])
        with np.errstate(over="ignore"):
            for k in range(words.first[r], words.first[r + 1]):
                acc = mix(np.array([acc * np.uint64(0x9E3779B97F4A7C15) + h[k]], np.uint64))[0]
        out[first[r]] = acc
    return out, first


def merged(intervals: np.ndarray) -> np.ndarray:
    """Union of half-open (start, end) rows as maximal disjoint ones, in order."""
    if len(intervals) == 0:
        return np.zeros((0, 2), np.int64)
    intervals = intervals[np.argsort(intervals[:, 0], kind="stable")]
    end = np.maximum.accumulate(intervals[:, 1])
    new = np.concatenate([[True], intervals[1:, 0] > end[:-1]])
    at = np.flatnonzero(new)
    return np.stack([intervals[at, 0], end[np.concatenate([at[1:] - 1, [len(end) - 1]])]], axis=1)
