"""Token ids of documents in word-aligned Simple-8b blocks, written and read by Spark.

A 64-bit word holds a selector in its upper 4 bits and 1 to 60 ids of equal width in the other 60. An id of
60 bits or more does not fit: its word carries the escape selector and the place of the id in a table of
literals of the block. A block holds whole documents and notes where each document, and each run of
RUN_WORDS words, starts, so any document is decoded without the words before its run.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.llm.shared import saved, short_batches
from feedlens.llm.tokens import crc32_of, encoder, text_slices

#: Ids per word and bits per id, by selector.
CLASSES = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
#: Words of a run; the block notes the first id of each.
RUN_WORDS = 64
#: Ids from which a block ends with the document at hand.
BLOCK_IDS = 1 << 16
#: Pieces that the tokenizer's memo holds; blocks leave room for more than packing does.
MEMO_PIECES = 600_000
#: Appended to each document.
END_ID = 1

_WIDTH_16 = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1))).astype(np.uint8)
_COUNTS = np.array([n for n, _ in CLASSES] + [0, 1], dtype=np.int64)

BLOCK = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_starts", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()),
    T.StructField("run_starts", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType()), T.StructField("literals", T.BinaryType()),
])


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, at least 1."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if top <= 16:
        return _WIDTH_16[ids]
    width = np.ones(len(ids), dtype=np.uint8)
    for b in range(1, top):
        width += ids >> np.uint64(b) > 0
    return width


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, literals) of ids below 2^64; greedy, each word takes the most ids that fit."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    width = _widths(ids)
    best = np.full(n, ESCAPE, dtype=np.uint8)
    # The widest id of each window: of 1, 2, 4 ... ids, and of any other number from two of those.
    spans = {1: width}
    for k in (2, 4, 8, 16, 32):
        half = spans[k // 2]
        spans[k] = np.maximum(half[: n - k + 1], half[k // 2 : n - k // 2 + 1]) if n >= k else np.zeros(0, np.uint8)
    for selector in range(len(CLASSES) - 1, -1, -1):
        count, bits = CLASSES[selector]
        if n < count:
            break
        k = 1 << (count.bit_length() - 1)
        widest = np.maximum(spans[k][: n - count + 1], spans[k][count - k : n - k + 1])
        best[: n - count + 1][widest <= bits] = selector
    jump = _COUNTS[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += jump[at]
    first = np.array(starts, dtype=np.int64)
    selectors = best[first]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors):
        here = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            words[here] |= np.arange(len(here), dtype=np.uint64)
            continue
        count, bits = CLASSES[selector]
        for k in range(count):
            words[here] |= ids[first[here] + k] << np.uint64(k * bits)
    return words, ids[first[selectors == ESCAPE]]


def starts_of(words: np.ndarray) -> np.ndarray:
    """The number of ids before each word, and of all."""
    return np.concatenate(([0], np.cumsum(_COUNTS[(words >> np.uint64(60)).astype(np.int64)])))


def decode(words: np.ndarray, literals: np.ndarray) -> np.ndarray:
    """The ids of words; one pass for each selector that occurs."""
    first = starts_of(words)
    out = np.zeros(int(first[-1]), dtype=np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    if (selectors == 14).any():
        raise ValueError("no such selector: 14")
    for selector in np.unique(selectors):
        here = np.flatnonzero(selectors == selector)
        body = words[here] & np.uint64((1 << 60) - 1)
        if selector == ESCAPE:
            out[first[here]] = literals[body.astype(np.int64)]
            continue
        count, bits = CLASSES[selector]
        for k in range(count):
            out[first[here] + k] = (body >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
    return out


def span(words: np.ndarray, literals: np.ndarray, run_starts: np.ndarray, a: int, b: int) -> np.ndarray:
    """The ids from place a up to b, decoded from the runs that hold them and no others."""
    if a >= b:
        return np.zeros(0, np.uint64)
    first, end = int(np.searchsorted(run_starts, a, "right")) - 1, int(np.searchsorted(run_starts, b, "left"))
    before = int(run_starts[first])
    return decode(words[first * RUN_WORDS : end * RUN_WORDS], literals)[a - before : b - before]


def _blocks(path: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder = encoder(path, MEMO_PIECES)
        kinds = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("run_starts", pa.list_(pa.int32())), ("words", pa.binary()), ("literals", pa.binary())])
        block = TaskContext.get().partitionId() << 32
        docs, sizes, held, full = [], [], [], 0

        def packed():
            ids = np.concatenate(held)
            words, literals = encode(ids)
            runs = starts_of(words)[:-1:RUN_WORDS]
            row = {"block": block, "doc_ids": docs, "doc_starts": np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist(), "n_ids": len(ids), "run_starts": runs.tolist(), "words": words.tobytes(), "literals": literals.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for i, texts in text_slices(batch):
                ids, bounds = coder.encode(texts)
                for k in range(len(texts)):
                    docs.append(keys[i + k])
                    held.append(np.append(ids[bounds[k] : bounds[k + 1]], ids.dtype.type(END_ID)))
                    sizes.append(len(held[-1]))
                    full += sizes[-1]
                    if full >= BLOCK_IDS:
                        yield packed()
                        docs, sizes, held, full = [], [], [], 0
                        block += 1
        if docs:
            yield packed()

    return run


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order into blocks, as Parquet files under `path`.

    `block` ascends with doc_id. Null text is one END_ID; null ids come first; repeated rows are stored as
    often as they occur. An empty table writes no block; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    short_batches(docs.sparkSession)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_blocks(tokenizer), BLOCK).write.option("compression", "zstd").parquet(path)


def _documents(batches):
    import pyarrow as pa

    for batch in batches:
        for row in range(batch.num_rows):
            block, keys, starts, n, _, words, literals = (batch.column(c)[row].as_py() for c in range(7))
            ids = decode(np.frombuffer(words, np.uint64), np.frombuffer(literals, np.uint64))
            if len(ids) != n:
                raise ValueError(f"block {block} holds {len(ids)} ids and says {n}")
            bounds = [*starts, n]
            own = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block] * len(keys), pa.int64()), "place": pa.array(range(len(keys)), pa.int32()), "doc_id": pa.array(keys, pa.int64()),
                "n_tokens": pa.array([len(x) for x in own], pa.int64()), "ids_crc32": pa.array([crc32_of(x) for x in own], pa.int64()),
                "ids": pa.array([np.asarray(x, "<u4").tobytes() for x in own], pa.binary()),
            })


def read(spark: SparkSession, path: str) -> DataFrame:
    """block, place, doc_id, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit) of every document under `path`."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    return blocks.mapInArrow(_documents, "block long, place int, doc_id long, n_tokens long, ids_crc32 long, ids binary")


def _wanted(batches):
    import pyarrow as pa

    kinds = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for row in range(batch.num_rows):
            block, keys, starts, n, runs, words, literals, places = (batch.column(c)[row].as_py() for c in range(8))
            words, literals, runs = np.frombuffer(words, np.uint64), np.frombuffer(literals, np.uint64), np.array(runs)
            bounds = [*starts, n]
            for place in sorted(places):
                ids = span(words, literals, runs, bounds[place], bounds[place + 1])
                yield pa.RecordBatch.from_pylist([{"block": block, "place": place, "doc_id": keys[place], "n_tokens": len(ids), "ids_crc32": crc32_of(ids), "ids": np.asarray(ids, "<u4").tobytes()}], schema=kinds)


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """As read(), of the documents whose doc_id is in `wanted`: other blocks are not decoded, nor other runs of theirs.

    The ids of all blocks are searched first, by a scan of their doc_ids alone. A doc_id that was written several
    times is found as often; null ids and ids that were not written are not found.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    ids = wanted.select(F.col("doc_id").cast("long").alias("_doc")).distinct()
    held = blocks.select(F.col("block").alias("_block"), F.posexplode("doc_ids").alias("place", "doc_id"))
    places = held.join(ids, F.col("doc_id") == F.col("_doc"), "left_semi").groupBy("_block").agg(F.collect_list("place").alias("places"))
    found = blocks.join(places, F.col("block") == F.col("_block")).select(*BLOCK.names, "places")
    return found.mapInArrow(_wanted, "block long, place int, doc_id long, n_tokens long, ids_crc32 long, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document under `path`; start counts the ids of all before it.

    The ids of a task's blocks are summed first: the running sum over tasks has one row per task, that
    inside a task one row per block of that task.
    """
    from pyspark.sql import Window as W

    rows = saved(read(spark, path).drop("ids"), "simple8b-digests")
    part = F.shiftright("block", 32)
    sizes = spark.read.schema(BLOCK).parquet(path).select(part.alias("part"), "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before_part", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    within = sizes.withColumn("before", F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    starts = within.join(parts, "part").select(F.col("block").alias("_block"), (F.coalesce("before", F.lit(0)) + F.coalesce("before_part", F.lit(0))).alias("_start"))
    inside = F.sum("n_tokens").over(W.partitionBy("block").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    joined = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(starts, F.col("block") == F.col("_block"))
    return joined.select("doc_id", (F.col("_start") + F.col("_inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")
