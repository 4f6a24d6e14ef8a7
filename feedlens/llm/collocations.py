"""Collocations: phrases that occur together more often than their parts would tell.

Texts are cut at punctuation into pieces. Equal pieces of a language become one row with a multiplicity, so the
work after that is that of the distinct ones. Phrases are counted with these weights: a task combines the phrases
of a tile of pieces, Spark deals the sums out by the hash of the phrase, and duckdb adds up what lies in a bucket,
out of core. A phrase can only be frequent if all its parts are, so words come first, then pairs of frequent words
(by a hash, which can only count too much), then phrases all of whose pairs may be frequent, by their text. What
may be frequent is told by bitmaps of fixed size; what they let through by mistake is counted and falls out.

The parts of a phrase lie in other buckets. Each phrase sends a request for the count of either part of each cut
to where that part was counted, and the answers meet again at the phrase.
"""

from __future__ import annotations

import re
import shutil
import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedlens.llm.shared import LOWER, UPPER, bit_filter, buffers, hash_spans, in_filter, mix, saved, short_batches


@dataclass(frozen=True)
class Params:
    """least: occurrences of a phrase. most: words of a phrase. cover: percent of a phrase's occurrences that lie in a longer one which drops it. top: phrases of a language."""

    least: int = 30
    most: int = 4
    cover: int = 80
    top: int = 2000


#: Distinct pieces that a task holds before it sends their counts.
HELD = 100_000
#: Bytes of pieces whose phrases a task combines at a time.
TILE = 4 << 20
#: Memory of duckdb in a task; it writes what exceeds that to the task's own spill folder, which goes with the task.
MEMORY = "256MB"
#: Groups in which the phrases of a language are cut to the top before they meet.
SALTS = 256
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_CUT = re.compile(rb"[^.,;:!?\n-\r]+")


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (words with a blank between two), n, words: the distinct pieces of each language."""
    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def flush():
            keys = list(held)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1].decode() for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "piece", "n"])
            held.clear()
            return out

        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = buffers(batch.column(1))
            for d, lang in enumerate(langs):
                for m in _CUT.finditer(data[offsets[d] : offsets[d + 1]].tobytes().translate(_FOLD)):
                    if words := m[0].split():
                        held[lang, b" ".join(words)] += 1
                        if len(held) >= HELD:
                            yield flush()
        if held:
            yield flush()

    short_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    return saved(found.withColumn("words", F.octet_length("piece") - F.octet_length(F.replace("piece", F.lit(" "), F.lit(""))) + 1), "collocation-pieces")


# ---------------------------------------------------------------- phrases of a tile


def _word_hashes(words) -> np.ndarray:
    data, offsets = buffers(words)
    return hash_spans(data, offsets[:-1], offsets[1:])


def _lang_hashes(langs) -> np.ndarray:
    """As _word_hashes, also of an empty name."""
    import pyarrow.compute as pc

    return _word_hashes(pc.binary_join_element_wise("lang", langs, ""))


def ranks(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rank of each key among the distinct ones, where each of these occurs first, and its sum of weights."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], np.diff(keys[order]) != 0)) if len(keys) else np.zeros(0, dtype=bool)
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return rank, order[at], np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, dtype=np.int64)


def _cut_long(piece: str, most: int, size: int) -> Iterator[tuple[str, int]]:
    """(text, words that start in it) of the parts of a long piece; each takes along the `most` - 1 words after it."""
    at, raw = 0, piece.encode()
    while at < len(raw):
        end = raw.find(b" ", min(at + size, len(raw)))
        end = more = len(raw) if end < 0 else end
        for _ in range(most - 1):
            more = raw.find(b" ", more + 1) if more < len(raw) else more
            more = len(raw) if more < 0 else more
        yield raw[at:more].decode(), raw.count(b" ", at, end) + 1
        at = end + 1


def tiles_of(batches, most: int, size: int) -> Iterator:
    """Batches of lang, piece, n as tables of about `size` bytes of pieces, with `own`: the words that count, where that is not all."""
    import pyarrow as pa

    held, total = [], 0
    for batch in batches:
        batch = batch.append_column("own", pa.nulls(batch.num_rows, pa.int64()))
        sizes = np.diff(buffers(batch.column(1))[1])
        for i in np.flatnonzero(sizes > size).tolist():
            lang, piece, n, _ = (c[i].as_py() for c in batch.columns)
            for text, own in _cut_long(piece, most, size):
                yield pa.table([[lang], [text], [n], [own]], names=batch.schema.names)
        short = batch.filter(pa.array(sizes <= size))
        if short.num_rows:
            held.append(short)
            total += int(sizes[sizes <= size].sum())
        if total >= size:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Tile:
    """The words of some pieces: their numbers by language, weights, and the piece each lies in.

    Words of a part of a long piece that the next part has as its own weigh nothing.
    """

    def __init__(self, table):
        import pyarrow.compute as pc

        batch = table.combine_chunks().to_batches()[0]
        words = pc.split_pattern(batch.column(1), " ")
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        sizes = np.diff(ends)
        self.langs, self.words = batch.column(0).dictionary_encode(), words.flatten().dictionary_encode()
        self.lang = np.repeat(self.langs.indices.to_numpy().astype(np.int64), sizes)
        self.word = self.words.indices.to_numpy().astype(np.int64)
        self.weight = np.repeat(batch.column(2).to_numpy(), sizes)
        self.piece = np.repeat(np.arange(len(sizes)), sizes)
        own = batch.column(3).fill_null(1 << 62).to_numpy()
        self.weight[np.arange(len(self.word)) - np.repeat(ends[:-1], sizes) >= np.repeat(own, sizes)] = 0
        self.first, self.at, self.sums = ranks(self.lang * max(1, len(self.words.dictionary)) + self.word, self.weight)

    def hashes(self) -> np.ndarray:
        """Of each place, that of its word in its language."""
        own = mix(_word_hashes(self.words.dictionary)[self.word[self.at]] + _lang_hashes(self.langs.dictionary)[self.lang[self.at]])
        return own[self.first]

    def wide(self, width: int, live: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places, sums of weights) of the phrases of two words and more; live tells whether the pair at a place may count."""
        rank, kinds = self.first, len(self.at)
        for k in range(2, width + 1):
            n = max(0, len(self.word) - k + 1)
            at = np.flatnonzero((self.piece[:n] == self.piece[k - 1 : k - 1 + n]) & np.logical_and.reduce([live[j : j + n] for j in range(k - 1)]))
            own, first, sums = ranks(rank[at] * kinds + self.first[at + k - 1], self.weight[at])
            yield k, at[first], sums
            rank = np.zeros(len(self.word), dtype=np.int64)
            rank[at] = own

    def text(self, places: np.ndarray, width: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        words = [self.words.dictionary.take(pa.array(self.word[places + j])) for j in range(width)]
        return pc.binary_join_element_wise(*words, " ") if width > 1 else words[0]

    def rows(self, places: np.ndarray, sums: np.ndarray, width: int):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([self.langs.dictionary.take(pa.array(self.lang[places])), self.text(places, width), pa.array(np.full(len(places), width, dtype=np.int32)), pa.array(sums)], ["lang", "phrase", "width", "n"])


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """Of each place but the last, that of its word and the next one."""
    return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def _over_tiles(parts: DataFrame, most: int, make, schema: str) -> DataFrame:
    def run(batches):
        for table in tiles_of(batches, most, TILE):
            yield from make(Tile(table))

    return parts.select("lang", "piece", "n").mapInArrow(run, schema)


def words(parts: DataFrame) -> DataFrame:
    return _over_tiles(parts, 1, lambda t: [t.rows(t.at, t.sums, 1)], "lang string, phrase string, width int, n long")


def pairs(parts: DataFrame, frequent) -> DataFrame:
    """key, n of pairs of words that may both be frequent: by hash, so that a row is two numbers."""
    def make(tile: Tile):
        import pyarrow as pa

        hashes = tile.hashes()
        word = in_filter(hashes, frequent.value)
        for _, places, sums in tile.wide(2, word[:-1] & word[1:]):
            yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(hashes)[places].view(np.int64)), pa.array(sums)], ["key", "n"])

    return _over_tiles(parts, 2, make, "key long, n long")


def phrases(parts: DataFrame, width: int, frequent) -> DataFrame:
    """Phrases of two words and more all of whose pairs may be frequent."""
    def make(tile: Tile):
        return (tile.rows(places, sums, k) for k, places, sums in tile.wide(width, in_filter(pair_hashes(tile.hashes()), frequent.value)))

    return _over_tiles(parts, width, make, "lang string, phrase string, width int, n long")


# ---------------------------------------------------------------- counts


def counted(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys and n: sums of n of `least` and more, by duckdb in each bucket of the keys' hash."""
    schema = rows.select(*keys, "n").schema

    def run(batches):
        import duckdb
        import pyarrow as pa

        first = next(batches, None)
        if first is None:
            return
        folder = tempfile.mkdtemp()
        try:
            with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder}) as con:
                def all_batches():
                    yield first
                    yield from batches

                con.register("bucket", pa.RecordBatchReader.from_batches(first.schema, all_batches()))
                names = ", ".join(keys)
                yield from con.sql(f"select {names}, cast(sum(n) as bigint) as n from bucket group by {names} having sum(n) >= {least}").to_arrow_reader(10_000)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return rows.select(*keys, "n").repartition(*keys).mapInArrow(run, schema)


def _word_filter(found: DataFrame):
    """The bitmap of frequent words."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hashes = mix(_word_hashes(batch.column(1)) + _lang_hashes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["key"])

    return found.sparkSession.sparkContext.broadcast(bit_filter(found.select("lang", "phrase").mapInArrow(run, "key long")))


def grams(parts: DataFrame, p: Params = Params()) -> DataFrame:
    """lang, phrase, width, n: the frequent phrases of one to p.most words."""
    spark = parts.sparkSession
    keys = ["lang", "phrase", "width"]
    single = saved(counted(words(parts), keys, p.least), "collocation-words")
    if p.most == 1:
        return single
    frequent = _word_filter(single)
    double = spark.sparkContext.broadcast(bit_filter(counted(pairs(parts, frequent), ["key"], p.least).select("key")))
    return single.unionAll(saved(counted(phrases(parts, p.most, double), keys, p.least), "collocation-phrases"))


# ---------------------------------------------------------------- scores


def _part(first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice("w", first, size), " ")


def scored(found: DataFrame, p: Params = Params()) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more that no longer one covers."""
    candidates = found.where("width > 1").select("lang", "phrase", F.col("n").alias("a"), "width", F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", "width", F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k"))
    side = lambda name, part: F.struct(F.lit(name).alias("side"), part.alias("part"))
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(side("l", _part(F.lit(1), F.col("k"))), side("r", _part(F.col("k") + 1, F.col("width") - F.col("k"))))).alias("ask"))
    known = found.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias("_n"))
    asked = asked.select("lang", "phrase", "a", "k", "ask.side", "ask.part")
    answers = asked.join(known, (asked["lang"] == known["_lang"]) & (asked["part"] == known["_phrase"]))
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("_n"))).alias(name)
    both = answers.groupBy("lang", "phrase", "a", "k").agg(of("l"), of("r"))
    value = F.expr("cast((2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("cut"))
    inner = candidates.where("width > 2").select("lang", "a", "w", "width", F.explode(F.sequence(F.lit(2), F.col("width") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("width") - F.col("size") + 1)).alias("start"))
    cover = inner.groupBy(F.col("lang").alias("_lang"), _part(F.col("start"), F.col("size")).alias("_phrase")).agg(F.max("a").alias("longer"))
    rows = best.join(cover, (best["lang"] == cover["_lang"]) & (best["phrase"] == cover["_phrase"]), "left")
    stays = F.expr(f"longer is null or 100 * cast(longer as decimal(20, 0)) < {p.cover} * cast(a as decimal(20, 0))")
    return rows.where(stays).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def top(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """The first p.top of each language with their rank; a language's phrases are cut in groups before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= p.top)
    return salted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= p.top).drop("salt")


def mine(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's p.top best collocations of 2 to p.most words.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line ends, words at blanks and tabs. a counts a phrase's
    occurrences within pieces, l and r those of the two parts of the cut with the lowest score (ties: the shorter
    first part), n all words of the language. The score is 2000000 a / (l + r), rounded down; a phrase goes if
    a longer candidate holds it in at least p.cover percent of its occurrences. A null lang counts as `und`, a
    null text as empty. Repeated rows count each; no rows give no rows; other columns are ignored.
    """
    parts = pieces(docs)
    total = parts.groupBy(F.col("lang").alias("_lang")).agg(F.sum(F.col("n") * F.col("words")).alias("n"))
    rows = top(scored(grams(parts, p), p), p)
    return rows.join(total, rows["lang"] == total["_lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
