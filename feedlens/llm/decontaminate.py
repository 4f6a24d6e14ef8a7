"""Benchmark decontamination on templates: catches benchmark items with other numbers, names or units.

Texts become tokens; numbers (1,200 or 3.5 are one), units after numbers (also glued, as in 5kg) and runs of names become
typed placeholders. Windows of template
tokens of the benchmark are hash-joined with those of the documents. Matches with the same shift between item
and document form an occurrence; it counts only if its slots are consistent: equal values of the item stand
for equal values of the document, and different ones for different ones. A document is contaminated by an
item of which it holds a large enough share of the windows.

Capitals make names, so a copy in other case has other templates. Windows therefore come in two views: with
names as placeholders, and plain, with names as lower-cased literals. Occurrences are judged in each view;
a plain one with other numbers must agree with the numbers of its template windows as well.

An item with too few words for either view ("What is 12 * 35?") has windows in a third one, in which all tokens
are literals: as it stands it is found, with other numbers it is not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedlens.llm.shared import bit_filter, buffers, hash_spans, in_filter, mix, saved, short_batches, tiles, without


@dataclass(frozen=True)
class Params:
    window: int = 8  #: template tokens of a window; shorter items are one window
    literals: int = 3  #: tokens of a window that must not be placeholders; tokens of an item that may be found as it stands
    coverage: float = 0.5  #: share of an item's windows from which a document is contaminated
    salts: int = 8  #: copies of the benchmark's windows in the join; a window that many documents hold is spread over them


#: Units of measure and money that become placeholders after a number.
UNITS = """
mm cm m km mi mile miles inch inches ft feet foot yard yards mg g kg t gram grams kilogram kilograms ton tons lb lbs oz pound pounds ounce ounces
ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
percent degree degrees dollar dollars cent cents euro euros usd eur gbp mph kmh w kw kwh v volt volts hz khz mhz ghz byte bytes kb mb gb tb
""".split()

NUMBER, UNIT, NAME = 1, 2, 3
#: Views of a window, as bits; a window without names is the same in both. Template windows count a run of names as one token.
TEMPLATE, PLAIN, EXACT = 1, 2, 4

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_DIGIT = np.zeros(256, dtype=np.int32)
_DIGIT[48:58] = 1
_STOP = np.zeros(256, dtype=np.int32)
_STOP[[10, 33, 46, 58, 63]] = 1
_MARK = np.zeros(256, dtype=bool)
_MARK[[44, 46, 47]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _folded_pairs() -> np.ndarray:
    """Case folding of UTF-8 characters of two bytes, where the folded one has two bytes as well."""
    out = np.arange(1 << 16, dtype=np.uint16)
    for c in map(chr, range(0x80, 0x800)):
        if len(folded := c.casefold().encode()) == 2:
            out[int.from_bytes(c.encode(), "big")] = int.from_bytes(folded, "big")
    return out


_PAIRS = _folded_pairs()


def _lower(raw: np.ndarray) -> np.ndarray:
    low = _LOWER[raw]
    at = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] <= 0xDF))
    if len(at):
        pair = _PAIRS[(raw[at].astype(np.uint16) << np.uint16(8)) | raw[at + 1]]
        low[at], low[at + 1] = pair >> np.uint16(8), pair & np.uint16(255)
    return low


def _unit_hashes() -> np.ndarray:
    text = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
    ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return np.sort(hash_spans(text, ends - [len(u) for u in UNITS], ends))


_UNIT_HASHES = _unit_hashes()


@dataclass
class Words:
    """Tokens of consecutive documents: numbers with their separators are one token, a glued unit is one of its own."""

    value: np.ndarray  #: hash of the lower-cased text
    kind: np.ndarray
    doc: np.ndarray
    run: np.ndarray  #: number of the template token; a run of names is one

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(value, kind, document, first word) of each template token.

        The value of a run of names is its last one: a run may open with the first word of a sentence that no
        stop divides from the one before.
        """
        heads = np.flatnonzero(np.diff(self.run, prepend=-1))
        last = np.append(heads[1:], len(self.run)) - 1 if len(heads) else heads
        return self.value[last], self.kind[heads], self.doc[heads], heads


def _capital(raw: np.ndarray, low: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a capital letter, of one or two bytes, stands at each place."""
    second = np.minimum(start + 1, len(raw) - 1)
    return (raw[start] != low[start]) | ((raw[start] >= 0xC2) & (raw[start] <= 0xDF) & (raw[second] != low[second]))


def _counts(marks: np.ndarray) -> np.ndarray:
    """How many marks lie before each place, and in all; half as wide as numpy's own, as a long text has one at every byte."""
    out = np.zeros(len(marks) + 1, dtype=np.int32)
    np.cumsum(marks, dtype=np.int32, out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    lo = int(offsets[0])
    raw = data[lo : int(offsets[-1])]
    low = _lower(raw)
    inside = np.zeros(len(low) + 2, dtype=np.int8)
    inside[1:-1] = _TOKEN[low]
    edge = np.diff(inside)
    cuts = np.unique(offsets[1:-1] - lo)
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    start = np.sort(np.concatenate((np.flatnonzero(edge == 1), cuts)))
    end = np.sort(np.concatenate((np.flatnonzero(edge == -1), cuts)))
    if not len(start):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.uint8), start, start)
    del inside, edge
    digits = _counts(_DIGIT[low])
    # 5kg: digits first, then a unit.
    count = digits[end] - digits[start]
    glued = np.flatnonzero((count > 0) & (count < end - start))
    glued = glued[digits[start[glued] + count[glued]] - digits[start[glued]] == count[glued]]
    if len(glued):
        middle = start[glued] + count[glued]
        middle = middle[_is_unit(hash_spans(low, middle, end[glued]))]
        start, end = np.sort(np.concatenate((start, middle))), np.sort(np.concatenate((end, middle)))
    doc = np.searchsorted(offsets - lo, start, side="right") - 1
    # 1,200 and 3.5 and 1/2: digits on both sides of one mark.
    mark = np.minimum(end[:-1], len(low) - 1)
    joins = (start[1:] == end[:-1] + 1) & _MARK[low[mark]] & (_DIGIT[low[end[:-1] - 1]] > 0) & (_DIGIT[low[start[1:]]] > 0) & (doc[1:] == doc[:-1])
    heads = np.flatnonzero(np.concatenate(([True], ~joins)))
    start, end, doc = start[heads], end[np.append(heads[1:], len(end)) - 1], doc[heads]
    n = len(start)
    kind, value = np.zeros(n, dtype=np.uint8), hash_spans(low, start, end)
    stops = _counts(_STOP[low])
    follows = np.zeros(n, dtype=bool)  # a token before it in its sentence
    follows[1:] = (stops[start[1:]] == stops[end[:-1]]) & (doc[1:] == doc[:-1])
    kind[_capital(raw, low, start) & follows] = NAME
    kind[digits[end] > digits[start]] = NUMBER
    after = np.zeros(n, dtype=bool)
    after[1:] = follows[1:] & (kind[:-1] == NUMBER)
    kind[_is_unit(value) & after & (kind != NUMBER)] = UNIT
    same = np.zeros(n, dtype=bool)  # a name next to a name: one byte, a space or a hyphen, lies between
    same[1:] = follows[1:] & (kind[1:] == NAME) & (kind[:-1] == NAME) & (start[1:] == end[:-1] + 1)
    return Words(value, kind, doc, np.cumsum(~same) - 1)


def _is_unit(hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(_UNIT_HASHES, hashes), len(_UNIT_HASHES) - 1)
    return _UNIT_HASHES[at] == hashes


def _hashes(token: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    rolled = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        rolled = mix(rolled + token[at + k] + np.uint64(k + 1))
    return mix(rolled + np.uint64(size))


def _windows(value: np.ndarray, kind: np.ndarray, doc: np.ndarray, size: int, view: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each window of `size` tokens of a view that lies in one document and has enough literals.

    In the plain view names are literals, in the exact one all tokens are.
    """
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    slot = (kind > 0) if view == TEMPLATE else (kind == NUMBER) | (kind == UNIT) if view == PLAIN else np.zeros(len(kind), dtype=bool)
    literals = np.concatenate(([0], np.cumsum(~slot)))
    at = np.flatnonzero((doc[:n] == doc[size - 1 :]) & (literals[size:] - literals[:n] >= min(p.literals, size)))
    return at, _hashes(np.where(slot, kind.astype(np.uint64), value), at, size)


def _rows(p: Params, key: str, passes: np.ndarray | None, wanted: set[tuple[int, int]] | None = None):
    """Windows of each text: key, run (template token it starts in), at (word it starts at), size, hash, views, values (of numbers and units), names (values of them, if placeholders).

    Windows of several views at one place with the same hash, such as those without names, are one row. passes and
    wanted, a bitmap of hashes and pairs of view and size, tell which windows a text has; without them it is an item.
    """
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            keys = batch.column(key)
            for i, j in tiles(offsets):
                w = words(data, offsets[i : j + 1])
                runs = w.runs()
                first_word = np.searchsorted(w.doc, np.arange(j - i))
                first_run = np.searchsorted(runs[2], np.arange(j - i))
                out = {"row": [], "run": [], "at": [], "size": [], "hash": [], "views": [], "values": [], "names": []}
                seen: dict[tuple, int] = {}
                found = np.zeros(j - i, dtype=bool)
                for view, (value, kind, doc) in ((TEMPLATE, runs[:3]), (PLAIN, (w.value, w.kind, w.doc)), (EXACT, (w.value, w.kind, w.doc))):
                    count = np.bincount(doc, minlength=j - i)
                    # A text of fewer tokens than a window is one window.
                    for size in range(1, p.window + 1):
                        if wanted is not None and (view, size) not in wanted:
                            continue
                        at, hashed = _windows(value, kind, doc, size, view, p)
                        if passes is not None:
                            keep = in_filter(hashed, passes)
                        else:
                            keep = np.minimum(count[doc[at]], p.window) == size
                            if view == EXACT:  # only of items without another view
                                keep &= ~found[doc[at]] & (size >= p.literals)
                            else:
                                found[doc[at[keep]]] = True
                        for a, h in zip(at[keep].tolist(), hashed[keep].tolist(), strict=True):
                            word = int(runs[3][a]) if view == TEMPLATE else a
                            if (word, size, h) in seen:
                                out["views"][seen[word, size, h]] |= view
                                continue
                            seen[word, size, h] = len(out["row"])
                            out["row"].append(i + int(doc[a]))
                            out["run"].append(int(w.run[word]) - int(first_run[doc[a]]))
                            out["at"].append(word - int(first_word[doc[a]]))
                            out["size"].append(size)
                            out["hash"].append(h)
                            out["views"].append(view)
                            own, kinds = value[a : a + size].view(np.int64), kind[a : a + size]
                            out["values"].append(own[(kinds == NUMBER) | (kinds == UNIT)].tolist())
                            out["names"].append(own[kinds == NAME].tolist() if view == TEMPLATE else [])
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(out["row"], pa.int64())), pa.array(out["run"], pa.int64()), pa.array(out["at"], pa.int64()), pa.array(out["size"], pa.int32()),
                    pa.array(np.array(out["hash"], dtype=np.uint64).view(np.int64), pa.int64()), pa.array(out["views"], pa.int32()), pa.array(out["values"], pa.list_(pa.int64())), pa.array(out["names"], pa.list_(pa.int64())),
                ], [key, "run", "at", "size", "hash", "views", "values", "names"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """Contaminated pairs' evidence: doc_id, item_id, matched, windows, coverage, changed (slots with other values)."""
    clean = lambda df, key: df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short_batches(docs.sparkSession)
    items = saved(clean(benchmark, "item_id").mapInArrow(_rows(p, "item_id", None), "item_id long, run long, at long, size int, hash long, views int, values array<long>, names array<long>"), "templates-items")
    passes = bit_filter(items.select("hash"))  # documents' windows pass it before the join
    wanted = {(v, r["size"]) for r in items.select("views", "size").distinct().collect() for v in (TEMPLATE, PLAIN, EXACT) if r["views"] & v}  # at most three for each size
    found = clean(docs, "doc_id").mapInArrow(_rows(p, "doc_id", passes, wanted), "doc_id long, run long, at long, size int, hash long, views int, values array<long>, names array<long>")
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(p.salts)))
    spread = items.select(F.col("item_id"), F.col("run").alias("item_run"), F.col("at").alias("item_at"), F.col("size").alias("_size"), F.col("hash").alias("_hash"), F.col("views").alias("item_views"), F.col("values").alias("item_values"), F.col("names").alias("item_names"), F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))).alias("_salt"))
    joined = found.join(spread, (F.col("hash") == F.col("_hash")) & (F.col("salt") == F.col("_salt")) & (F.col("size") == F.col("_size")))
    both, zipped = F.col("views").bitwiseAND(F.col("item_views")), lambda x: F.arrays_zip(F.col(f"item_{x}").alias("a"), F.col(x).alias("b"))
    in_view = lambda v, x: F.when(both.bitwiseAND(F.lit(v)) > 0, x)
    numbers = zipped("values")
    joined = joined.select(
        "doc_id", "item_id", (F.col("run") - F.col("item_run")).alias("shift"), numbers.alias("numbers"), in_view(TEMPLATE, F.col("item_at")).alias("template_at"), in_view(PLAIN, F.col("item_at")).alias("plain_at"), in_view(EXACT, F.col("item_at")).alias("exact_at"),
        in_view(TEMPLATE, F.concat(numbers, zipped("names"))).alias("template_slots"), in_view(PLAIN, numbers).alias("plain_slots"),
    )
    # An occurrence has two rows for each window of an item at most, so a group is bounded by the item's length.
    pairs = lambda x: F.array_distinct(F.flatten(F.collect_set(x)))
    occurrence = joined.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set("template_at").alias("templates"), F.collect_set("plain_at").alias("plain"), F.collect_set("exact_at").alias("exact"), pairs("template_slots").alias("template_pairs"), pairs("plain_slots").alias("plain_pairs"), pairs("numbers").alias("pairs"),
    )
    side = lambda x, k: F.size(F.array_distinct(F.transform(x, lambda y: y[k])))
    one_to_one = lambda x: (F.size(x) == side(x, "a")) & (F.size(x) == side(x, "b"))
    changed = lambda x: F.exists(x, lambda y: y["a"] != y["b"])
    of_view = lambda v, places, x: F.struct(F.lit(v).alias("view"), F.col(places).alias("places"), changed(x).alias("changed"))
    hits = F.array(
        F.when(one_to_one("template_pairs"), of_view(TEMPLATE, "templates", "template_pairs")),
        F.when(~changed("plain_pairs") | one_to_one("pairs"), of_view(PLAIN, "plain", "plain_pairs")),
        F.when(F.size("exact") > 0, F.struct(F.lit(EXACT).alias("view"), F.col("exact").alias("places"), F.lit(False).alias("changed"))),
    )
    consistent = occurrence.select("doc_id", "item_id", F.explode(F.array_compact(hits)).alias("hit"))
    # An item may occur many times in a document; counts of places are merged as sets of the item's windows.
    places = consistent.select("doc_id", "item_id", "hit.view", F.explode("hit.places").alias("place"), "hit.changed")
    # The share of template windows that match as templates, or of all windows that match in either view.
    as_template = F.col("views").bitwiseAND(F.lit(TEMPLATE)) > 0
    totals = items.groupBy(F.col("item_id").alias("_item")).agg(F.countDistinct("at").alias("_all"), F.countDistinct(F.when(as_template, F.col("at"))).alias("_templates"))
    held = places.groupBy("doc_id", "item_id").agg(F.countDistinct("place").alias("_any"), F.countDistinct(F.when(F.col("view") == TEMPLATE, F.col("place"))).alias("_matched"), F.max("changed").alias("changed"))
    out = held.join(totals, F.col("item_id").eqNullSafe(F.col("_item")))
    shares = F.greatest(*[F.when(F.col(n) > 0, F.struct((F.col(m) / F.col(n)).alias("coverage"), F.col(m).alias("matched"), F.col(n).alias("windows"))) for m, n in (("_matched", "_templates"), ("_any", "_all"))])
    out = out.withColumn("best", shares).select("doc_id", "item_id", "best.matched", "best.windows", "best.coverage", "changed")
    return out.where(F.col("coverage") >= p.coverage).select("doc_id", "item_id", "matched", "windows", "coverage", "changed")


def judge(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, item_id, coverage, changed, n_items.

    item_id is the item with the largest coverage, of equal ones the least. Null and empty texts are clean;
    items of fewer tokens than p.literals match nothing; rows that share a doc_id, null too, are judged together. An empty
    table or an empty benchmark contaminates nothing; other columns are ignored.
    """
    best = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("coverage"), F.asc_nulls_last("item_id")))
    found = matches(docs, benchmark, p).withColumn("n_items", F.count(F.lit(1)).over(W.partitionBy("doc_id"))).withColumn("place", best).where("place = 1")
    found = found.select(F.col("doc_id").alias("_doc"), "item_id", "coverage", "changed", "n_items", F.lit(True).alias("hit"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return out.select("doc_id", F.coalesce("hit", F.lit(False)).alias("contaminated"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("changed", F.lit(False)).alias("changed"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs, with all their columns, that no benchmark item contaminates."""
    return without(docs, saved(matches(docs, benchmark, p).select("doc_id").distinct(), "templates-bad"))
