"""Ranked lexical search over a forward index, by Fagin's threshold algorithm.

The index holds one row a document: its terms with how often each occurs, and their number. Shards, the row groups
that a task reads, are searched each on their own. In a shard every term of an item has a list of documents sorted
by impact. Lists are read in turn, a few rows at a time and more each round; each document seen for the first time is
scored in full by a lookup of its row in the forward index. No document that was not seen can score more than the sum of the impacts
the lists have come to, the threshold; the search stops once that falls strictly below the k-th score, so that
equal scores are all seen. The k best of a task meet in two rounds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedlens.llm.shared import LOWER, UPPER, buffers, short_batches

#: Runs of letters and digits of ASCII and of anything outside it, as bytes of UTF-8.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
INDEX = "doc_id long, n long, terms array<string>, tfs array<long>"


@dataclass(frozen=True)
class Params:
    """k: documents of an item. step: rows of a list that the first round reads; each round reads twice as many. block: bytes of the items' texts that are searched at a time. shard: documents of a shard. salts: groups in which an item's documents first meet."""

    k: int = 50
    step: int = 16
    block: int = 1 << 20
    shard: int = 4096
    salts: int = 64


#: Entries of the forward index after which a shard ends, however few documents it has.
ENTRIES = 1 << 20


def terms_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return TERM.findall(raw.translate(_FOLD))


def _tf(raw: bytes, piece: int = 1 << 20) -> tuple[int, Counter]:
    """Number of terms and how often each occurs, a piece of a long text at a time."""
    out, n, at = Counter(), 0, 0
    while at < len(raw):
        end = min(at + piece, len(raw))
        while end < len(raw) and TERM.match(raw, end - 1) and TERM.match(raw, end):
            end += 1
        found = TERM.findall(raw[at:end])
        out.update(found)
        n, at = n + len(found), end
    return n, out


def index(docs: DataFrame) -> DataFrame:
    """doc_id, n, terms, tfs: the forward index of docs; null text counts as empty, other columns are ignored."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            n, ends, terms, tfs = [], [0], [], []
            for d in range(batch.num_rows):
                total, found = _tf(data[offsets[d] : offsets[d + 1]].tobytes().translate(_FOLD))
                n.append(total)
                terms.extend(found)
                tfs.extend(found.values())
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            words = pa.array(terms, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, INDEX)


def write(docs: DataFrame, path: str) -> None:
    """Write the index of docs as Parquet."""
    index(docs).write.parquet(path)


# ---------------------------------------------------------------- one shard


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a document's length in its score; products beyond 64 bits are exact."""
    wide = n.astype(object) if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63 else n
    return (50 + (50 * wide * n_docs) // max(1, n_terms)).astype(np.int64)


def shards(batches, rows: int, entries: int = ENTRIES) -> Iterator:
    """Tables of about `rows` documents, fewer where they hold many terms."""
    import pyarrow as pa

    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + len(batch.column(2).flatten())
        if n >= rows or size >= entries:
            yield pa.Table.from_batches(held)
            held, n, size = [], 0, 0
    if n:
        yield pa.Table.from_batches(held)


class Shard:
    """Postings of some documents for the terms of a block of items: by document, the forward side, and by term."""

    def __init__(self, table, vocabulary, weights: np.ndarray, n_docs: int, n_terms: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, n, terms, tfs = (table.column(c).combine_chunks() for c in range(4))
        self.ids, self.null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(terms).to_numpy()
        found = pc.index_in(terms.flatten(), value_set=vocabulary)
        held = found.is_valid().to_numpy(zero_copy_only=False)
        self.term = found.drop_null().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)[held]
        self.start = np.searchsorted(doc, np.arange(len(sizes) + 1))
        tf = tfs.flatten().filter(pa.array(held)).to_numpy()
        length = lengths(n.to_numpy(), n_docs, n_terms)
        self.score = weights[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[doc]))
        # Lists of falling impact, one after another by term.
        order = np.lexsort((-self.score, self.term))
        self.docs, self.impacts = doc[order], self.score[order]
        self.lists = np.searchsorted(self.term[order], np.arange(len(weights) + 1))

    def lookup(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Scores of documents for the terms that are wanted, from the forward side."""
        a, size = self.start[docs], self.start[docs + 1] - self.start[docs]
        at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return np.add.reduceat(np.append(np.where(wanted[self.term[at]], self.score[at], 0), 0), np.concatenate(([0], np.cumsum(size)[:-1])))

    def search(self, terms: np.ndarray, k: int, step: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, rows read) of the k best and all that equal the last of them, above 0 and not below `floor`.

        terms are distinct numbers of the vocabulary. floor is a score that k other documents reach.
        """
        a, z = self.lists[terms], self.lists[terms + 1]
        wanted = np.zeros(len(self.lists), dtype=bool)
        wanted[terms] = True
        seen = np.zeros(len(self.ids), dtype=bool)
        docs, scores, read, depth, kth = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, 0, max(floor, 1)
        while (a + depth < z).any():
            rows = np.concatenate([self.docs[i + depth : min(i + depth + step, j)] for i, j in zip(a.tolist(), z.tolist(), strict=True)])
            read, depth, step = read + len(rows), depth + step, 2 * step
            new = np.unique(rows[~seen[rows]])
            if len(new):
                seen[new] = True
                docs, scores = np.concatenate((docs, new)), np.concatenate((scores, self.lookup(new, wanted)))
                if len(scores) >= k:
                    kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                docs, scores = docs[scores >= kth], scores[scores >= kth]
            last = a + depth - 1  # a list that has come to its end adds nothing
            if int(self.impacts[last[last < z - 1]].sum()) < kth:
                break
        return docs, scores, read


class Best:
    """The k best of an item so far; of equal scores the least doc_id, none of it last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.null = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    @property
    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) >= self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids)), np.concatenate((self.null, null))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


# ---------------------------------------------------------------- search


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[object, list[str]]]]:
    """(item_id, distinct terms) of items of `size` bytes of text together, one item at least."""
    held, total = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        terms = sorted({t.decode() for t in terms_of(row.text)})
        total += sum(map(len, terms)) + 16
        held.append((row.item_id, terms))
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _weights(rows: DataFrame, vocabulary: list[str], n_docs: int) -> np.ndarray:
    """The weight of each term of a block's vocabulary, from the documents of the index that hold it."""
    words = rows.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")
    held = rows.select(F.explode("terms").alias("term")).join(F.broadcast(words), "term").groupBy("term").count()
    df = dict(held.collect())  # one row a term of the block
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in vocabulary], dtype=np.int64)


def _search_block(rows: DataFrame, items: list[tuple[object, list[str]]], n_docs: int, n_terms: int, p: Params) -> DataFrame:
    """item (a number of the block), doc_id, score: the k best of each item in each task."""
    vocabulary = sorted({t for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    weights = _weights(rows, vocabulary, n_docs)
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, weights, [np.array([number[t] for t in terms if weights[number[t]] > 0], dtype=np.int64) for _, terms in items]))

    def run(batches):
        import pyarrow as pa

        words, weights, asked = shared.value
        known = pa.array(words, pa.string())
        best = [Best(p.k) for _ in asked]
        for table in shards(batches, p.shard):
            shard = Shard(table, known, weights, n_docs, n_terms)
            for found, terms in zip(best, asked, strict=True):
                if len(terms):
                    docs, scores, _ = shard.search(terms, p.k, p.step, found.floor)
                    found.add(scores, shard.ids[docs], shard.null[docs])
        item = np.repeat(np.arange(len(best)), [len(b.scores) for b in best])
        ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, dtype=np.int64)
        null = np.concatenate([b.null for b in best]) if best else np.zeros(0, dtype=bool)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, pa.int64(), mask=null), pa.array(np.concatenate([b.scores for b in best]) if best else ids, pa.int64())], ["item", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, doc_id long, score long")


def search(spark: SparkSession, path: str, items: DataFrame, p: Params = Params()) -> DataFrame:
    """item_id, rank, doc_id, score: the p.k documents of the index with the highest score above 0 for each item.

    Equal scores go by ascending doc_id, null last; rows with one doc_id are documents of their own and may both
    be ranked. An item's terms count once each; one without terms, or with a null text, has no rows. Items with
    one item_id are ranked each, under the same id. Without documents there are no rows.

    Items are a stated set of queries: their terms go to all tasks in blocks of p.block bytes, one pass over the
    index a block.
    """
    rows = spark.read.schema(INDEX).parquet(path)
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    kind = dict(items.dtypes)["item_id"]
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _blocks(items, p.block):
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"number int, item_id {kind}")
        found = _search_block(rows, block, n_docs, n_terms, p).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(p.salts)))
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= p.k)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= p.k)
        out = out.unionAll(found.join(F.broadcast(names), found["item"] == names["number"]).select("item_id", "rank", "doc_id", "score"))
    return out
