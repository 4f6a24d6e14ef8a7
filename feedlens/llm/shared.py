"""Helpers that several operators of this subpackage use: shared tables, word and shingle hashes."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of text that the vectorised helpers take at a time; bounds a task's memory.
TILE_BYTES = 2 << 20
#: Documents that go to a Python worker at a time.
BATCH_ROWS = 500


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="feedlens-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the one that the cluster names in spark.checkpoint.dir. Where that is unset, a local session,
    as in tests, takes a folder of this machine, and any other one is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let what is written here give back its shuffle files as soon as it is written, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let at most `rows` documents go to a Python worker at a time, unless the session asks for even fewer.

    Spark's own default of 10,000 rows counts no bytes; with whole texts that is what fills an executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def first_by_hash(rows: DataFrame, order: Column, n: int) -> DataFrame:
    """The n rows with the least hash `order`.

    A cut below which some more than n rows lie comes first: without it every task would send n rows. Where
    many rows share a hash the cut may leave too few; then it is left out.
    """
    ordered, total = rows.withColumn("_order", order), rows.count()
    share = min(1.0, (1.2 * n + 100) / max(total, 1))
    below = ordered.where(F.col("_order") <= F.lit(min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))).cast("long"))
    if share < 1.0 and below.limit(n).count() < n:
        below = ordered
    return below.orderBy("_order").limit(n)


# ---------------------------------------------------------------- filters of fixed size

#: Bits of the filters below: 2 MB, whatever the number of keys.
FILTER_BITS = 24


def bit_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of 2^bits bits of 64-bit hashes, as bytes: the first column of `hashes`, made in tasks and merged by Spark."""
    def run(batches):
        import pyarrow as pa

        out = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for batch in batches:
            byte, mask = _bit_of(batch.column(0).to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(out, byte, mask)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at].astype(np.int32), pa.int32())], ["at", "bits"])

    rows = hashes.mapInArrow(run, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # one row per byte at most
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint8)
    return out


def _bit_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    bit = hashes >> np.uint64(64 - bits)
    return (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)


def in_filter(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of the bitmap."""
    byte, mask = _bit_of(hashes, len(bitmap).bit_length() + 2)
    return (bitmap[byte] & mask) > 0


def may_hold(keys: DataFrame, column: Column) -> Column:
    """Whether `column` may be among the values of the first column of `keys`, by a filter of fixed size.

    It saves the shuffle of rows that a join would not match; with far more keys than bits it saves nothing.
    """
    name = keys.columns[0]
    bitmap = keys.sparkSession.sparkContext.broadcast(bit_filter(keys.select(F.xxhash64(F.col(name).cast("long")).alias("hash"))))

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_filter(hashes.to_numpy(dtype=np.int64).view(np.uint64), bitmap.value))

    return test(F.xxhash64(column.cast("long")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is not among the first column of `gone` (null equals null).

    Only rows that the filter does not clear meet `gone` in a join.
    """
    maybe = may_hold(gone, docs["doc_id"])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("_doc"), maybe.alias("_maybe"))
    keys = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
    checked = rows.where("_maybe").join(keys, F.col("_doc").eqNullSafe(F.col("_gone")), "left_anti")
    return rows.where(~F.col("_maybe")).select("row.*").unionAll(checked.select("row.*"))


# ---------------------------------------------------------------- words and shingles, on numpy byte buffers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary or string array; nulls are empty."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets.astype(np.int64)


def tiles(offsets: np.ndarray, size: int = TILE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `size` bytes each, one document at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of a byte array."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a lower-cased byte array; many words are hashed a tile at a time."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    if len(starts) > 1 and sizes.sum() > 2 * TILE_BYTES:
        parts = tiles(np.concatenate(([0], np.cumsum(sizes))))
        return np.concatenate([hash_spans(low, starts[i:j], ends[i:j]) for i, j in parts])
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    place = at - np.repeat(starts, sizes)
    value = _BYTE[low[at]] * _powers(int(sizes.max()))[place]
    heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return mix(np.add.reduceat(value, heads) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of consecutive documents, and where each document's words start.

    A document larger than a tile is hashed piece by piece, cut at white space, so that the arrays of a task
    stay small next to the text.
    """
    hashes, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    for i, j in tiles(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j == i + 1 and hi - lo > 2 * TILE_BYTES:
            at = lo
            while at < hi:
                end = min(at + TILE_BYTES, hi)
                while end < hi and not _SPACE[data[end]]:
                    end += 1
                low = _LOWER[data[at:end]]
                hashes.append(hash_spans(low, *word_spans(low)))
                counts[i] += len(hashes[-1])
                at = end
            continue
        low = _LOWER[data[lo:hi]]
        inside = np.zeros(len(low) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[low]
        edge = np.diff(inside)
        cuts = offsets[i + 1 : j] - lo  # a word ends where its document ends
        cuts = cuts[(cuts > 0) & (cuts < len(low))]
        joined = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])
        starts = np.sort(np.concatenate((np.flatnonzero(edge == 1), joined)))
        ends = np.sort(np.concatenate((np.flatnonzero(edge == -1), joined)))
        hashes.append(hash_spans(low, starts, ends))
        counts[i:j] = np.diff(np.searchsorted(starts, offsets[i : j + 1] - lo))
    flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    return flat, np.concatenate(([0], np.cumsum(counts)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document.

    A document of fewer than `width` words has its whole word sequence as one shingle; one without words
    has none.
    """
    for i, j in tiles(offsets):
        words, first = hashed_words(data, offsets[i : j + 1])
        n = len(words) - width + 1
        rolled = np.zeros(max(n, 0), dtype=np.uint64)
        if n > 0:
            for k in range(width):
                rolled = mix(rolled + words[k : k + n] + np.uint64(k + 1))
        for d in range(j - i):
            lo, hi = int(first[d]), int(first[d + 1])
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif hi > lo:
                short = np.zeros(1, dtype=np.uint64)
                for k in range(lo, hi):
                    short = mix(short + words[k : k + 1] + np.uint64(k - lo + 1))
                yield mix(short + np.uint64(hi - lo))
            else:
                yield np.zeros(0, dtype=np.uint64)
