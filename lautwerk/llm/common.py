"""Shared pieces of the training-data operators.

Words are found and hashed on the raw UTF-8 buffers of Arrow columns, so no
Python string is made per word. All hashes are 64 bits wide and the same on
every machine. A null text counts as an empty one.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what stands between these: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else as it is. Only the two letters whose Unicode lower case is ASCII need care."""
    plain = F.lower(text)
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(plain)


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_PATTERN))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _GOLD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_powers = np.cumprod(np.full(4096, _GOLD, U64))


def powers(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * _powers[-1]])
    return _powers


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


SPACES = byte_set((9, 13), (32, 32))
#: Bytes outside [0-9a-zA-Z] and below 0x80.
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(data: np.ndarray, off: np.ndarray, sep: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts of about size bytes at the start of a text or after a separator, so that no word is cut."""
    lo, end = 0, len(data)
    while lo < end:
        hi = min(lo + size, end)
        if hi < end:
            k = int(np.searchsorted(off, hi))
            doc = int(off[k]) if k < len(off) else end
            at, cut = hi, doc
            while at < doc:
                found = np.flatnonzero(sep[data[at : min(at + 65536, doc)]])
                if len(found):
                    cut = at + int(found[0]) + 1
                    break
                at += 65536
            hi = cut
        yield lo, hi
        lo = hi


def word_hashes(arr: pa.Array, sep: np.ndarray = SPACES, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start byte of every word, and for each text its range of words: words of text k are cut[k]:cut[k + 1]."""
    data, off = buffers(arr)
    fold, value = (_LOWER if lower else _SAME), np.where(sep, U64(0), _BYTE)
    hashes, starts = [], []
    for lo, hi in pieces(data, off, sep):
        a = fold[data[lo:hi]]
        word = ~sep[a]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = off[np.searchsorted(off, lo) : np.searchsorted(off, hi)] - lo
        first[inner] |= word[inner]
        st = np.flatnonzero(first)
        if not len(st):
            continue
        a = a[st[0] :]
        pos = np.arange(len(a)) - np.repeat(st - st[0], np.diff(np.append(st - st[0], len(a))))
        longest = int((pos * word[st[0] :]).max()) + 1
        term = value[a] * powers(longest)[np.minimum(pos, longest - 1)]
        hashes.append(mix(np.add.reduceat(term, st - st[0])))
        starts.append(st + lo)
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, s, np.searchsorted(s, off)


_STEP = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; a shorter text is one shingle, an empty one none."""
    n = len(h)
    if not n:
        return h
    if n < k:
        return mix((h * _STEP[:n]).sum(keepdims=True) + U64(n))
    out = h[: n - k + 1] * _STEP[0]
    for j in range(1, k):
        out = out + h[j : n - k + 1 + j] * _STEP[j]
    return np.unique(mix(out))


def hash_of(word: str) -> int:
    """The hash that word_hashes gives to a single word."""
    return int(word_hashes(pa.array([word]), sep=np.zeros(256, bool), lower=False)[0][0])


def row_chunks(arr: pa.Array, size: int = 4 << 20, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about size bytes of text."""
    _, off = buffers(arr)
    lo = 0
    while lo < len(arr):
        hi = int(np.searchsorted(off, off[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, len(arr))
        yield lo, hi
        lo = hi


def batch_rows(spark: SparkSession) -> None:
    """Nothing larger than a few MB of ordinary texts goes to Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


# -- lineage ---------------------------------------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a local master without one, a folder under /tmp."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/lautwerk"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the interpreter
        return


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors. Removed when Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


# -- components ------------------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (src, dst): the smallest id it is connected with.

    Alternating large-star and small-star steps on the cluster: each step hangs nodes onto a smaller neighbour, so a
    component becomes a star after a logarithmic number of rounds. Rows never exceed the number of links.
    """

    def hang(e: DataFrame, least: DataFrame) -> DataFrame:
        return e.join(least, "u")

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        j = hang(both, least).where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        return j.where("src <> dst").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        j = hang(down, least).where("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        return j.unionAll(least.select(F.col("u").alias("src"), F.col("m").alias("dst"))).where("src <> dst").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    e = materialize(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct())
    before = mark(e)
    while before[0]:
        e = materialize(small(large(e)))
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionAll(e.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
