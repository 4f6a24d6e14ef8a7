"""Sum-of-squares online packing of documents into sequences of fixed length.

A document is cut into full windows and one remainder. Remainders come in order of a hash of their document
and are placed at once: each goes to the fill level (0 is a new window) that leaves the least sum of squared
counts of partially filled windows. The counts are held in a level array. Documents are dealt to lanes by a
hash; a lane holds about LANE_BYTES of text at any size of the corpus and is packed on its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.shared import short_batches
from feedlens.llm.tokens import crc32_of, encoder, text_slices

WINDOW = 2048
END_ID = 1
#: Text bytes of a lane, a few thousand windows; those left unfilled are few next to them.
LANE_BYTES = 16 << 20
#: Pieces that the tokenizer's memo holds, unless the caller wants workers smaller; the ids are the same with any number.
MEMO_PIECES = 600_000

_PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


class Levels:
    """Windows of one lane by fill level: how many are partially filled to each level, and which."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) of a piece of 1 to `window` tokens.

        Moving a window from level h to h + size changes the sum of squares by 2 (N[h + size] - N[h] + 1),
        opening one by 2 N[size] + 1, filling one to the brim by 1 - 2 N[h]. Of equal changes the fullest
        level wins.
        """
        top = self.window - size
        n = self.count
        change = 2 * (n[size : self.window + 1] - n[: top + 1] + 1)
        change[0] = 2 * n[size] + 1 if top else 0
        if top:
            change[top] = 1 - 2 * n[top]
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        level = top - int(np.argmin(change[::-1]))
        if level:
            at = self.open[level].pop()
            n[level] -= 1
        else:
            at = self.made
            self.made += 1
        if level + size < self.window:
            n[level + size] += 1
            self.open[level + size].append(at)
        return at, level


def _cut(path: str, window: int, memo_pieces: int):
    def run(batches):
        import pyarrow as pa

        coder = encoder(path, memo_pieces)
        for batch in batches:
            keys = batch.column("doc_id")
            for i, texts in text_slices(batch):
                ids, bounds = coder.encode(texts)
                row, start, length, total, data = [], [], [], [], []
                for k in range(len(texts)):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], ids.dtype.type(END_ID))
                    for a in range(0, len(own), window):
                        piece = own[a : a + window]
                        row.append(i + k)
                        start.append(a)
                        length.append(len(piece))
                        total.append(len(own))
                        data.append(piece.tobytes())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, memo_pieces: int = MEMO_PIECES) -> DataFrame:
    """Windows of every document's ids: doc_id, start, length, doc_tokens, ids (little-endian, 2 bytes each, or 4 where the vocabulary needs them)."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer, window, memo_pieces), _PIECES)


def _placed(window: int, with_ids: bool):
    def run(batches):
        import pyarrow as pa

        lane, levels, made = None, None, 0
        for batch in batches:
            lanes, sizes = batch.column("lane").to_pylist(), batch.column("length").to_pylist()
            sequence, offset = [], []
            for own, size in zip(lanes, sizes, strict=True):
                if own != lane:
                    lane, levels = own, Levels(window)
                at, level = levels.place(size)
                sequence.append((own << 32) + at)
                offset.append(level)
            crc = [crc32_of(np.frombuffer(x, f"<u{len(x) // n}")) for x, n in zip((v.as_py() for v in batch.column("ids")), sizes, strict=True)]
            keep = ["doc_id", "start", "length", "doc_tokens", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(crc, pa.int64())], [*keep, "sequence_id", "offset", "ids_crc32"])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, lane_bytes: int = LANE_BYTES, with_ids: bool = True, memo_pieces: int = MEMO_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (unless left out), sequence_id, offset, ids_crc32.

    Null text is one END_ID; null ids are packed like any other; repeated rows are packed as often as they
    occur. An empty table gives an empty result; other columns are ignored. Sequences are numbered per lane:
    the upper 32 bits of sequence_id are the lane.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    lanes = max(1, round(size / lane_bytes))
    # The order inside a lane is fixed by the rows alone, so a task that is run again packs alike.
    dealt = pieces(docs, tokenizer, window, memo_pieces).withColumn("key", F.xxhash64("doc_id", "doc_tokens", "start"))
    dealt = dealt.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(lanes)))
    ordered = dealt.repartition("lane").sortWithinPartitions("lane", "key", "doc_id", "start", "ids")
    kinds = _PIECES if with_ids else _PIECES.removesuffix(", ids binary")
    return ordered.mapInArrow(_placed(window, with_ids), f"{kinds}, sequence_id long, offset long, ids_crc32 long")
