"""Repeated byte windows, by a depth-limited radix sort of suffixes.

A suffix is sorted by its first `threshold` bytes only, one digit a pass, and leaves the sort as soon as it is
alone in its group; groups that are equal through all digits are the repeated windows. Equality is all that is
asked, so digits are taken in the order that settles most suffixes first, not from left to right:

1. the gram of `gram` bytes with the least hash in the window. Windows of equal bytes have the same one at the
   same place, and neighbours mostly share it: a run of them, a bundle, travels as one row with the digest of its
   hull, all bytes of the bundle. Bundles of equal hulls are repeated as a whole; a gram of one hull is settled.
2. what bundles of grams with several hulls are cut into: cells of `cell` neighbours at fixed places from the
   gram, by the bytes that all of a cell share and the digest of their hull.
3. single windows of cells that are still mixed, through all `threshold` bytes.

Pieces that share a digit meet in one sorted partition, and a pass over it keeps a few rows at a time; of equal ones
that a task has many of, few are sent there. Of equal hulls
only one goes on to the next digit, in the place of all: the others are settled, and it is there for those that share
a part of it. The texts are read twice: the second time each gives the bytes of its bundles that go on, which are a
small table; later digits are taken from that. What a pass sends follows from the pieces that it is for, whatever
the size of the input. Hulls are told apart by 64 bits of BLAKE2b among those of one digit, windows by 128 bits
of it, texts by 128 bits of SHA-256.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.shared import _BYTE, buffers, freed_shuffles, may_hold, mix, saved, short_batches, tiles


@dataclass(frozen=True)
class Params:
    """threshold: bytes of a window. gram: bytes of the first digit, a power of two up to the threshold. cell: windows of a cell, up to threshold."""

    threshold: int = 200
    gram: int = 64
    cell: int = 16


#: Bytes of text that are sorted at a time.
BLOCK = 1 << 19
#: Low bits of a hash that give way to its place in a block; a block and the window after it fit in.
_PLACE = np.uint64((1 << 21) - 1)
#: An odd multiplier, three more than a multiple of four, for each doubling of a gram.
_STEPS = [np.uint64(0x9E3779B97F4A7C17 + 4 * 0x1234567 * k) for k in range(16)]


def bundles(raw: np.ndarray, cuts: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of the least gram of each run of windows, with the run's first and last start.

    Windows lie between two of the sorted cuts; the first of equal hashes in a window counts.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < p.threshold:
        return none.view(np.uint64), none, none, none
    h, size = _BYTE[raw], 1
    for step in _STEPS[: p.gram.bit_length() - 1]:
        h, size = h[:-size] * step + h[size:], 2 * size
    h = mix(h)
    least, width, k = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), p.threshold - p.gram + 1, 1
    while 2 * k <= width:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    if k < width:
        least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
    place = (least & _PLACE).astype(np.int64)
    crossing = np.zeros(len(place) + 1, dtype=np.int64)
    np.add.at(crossing, np.clip(cuts - p.threshold + 1, 0, len(place)), 1)
    np.add.at(crossing, np.clip(cuts, 0, len(place)), -1)
    starts = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
    if not len(starts):
        return none.view(np.uint64), none, none, none
    place = place[starts]
    new = np.flatnonzero((place[1:] != place[:-1]) | (np.diff(starts) != 1)) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new - 1, [len(starts) - 1]))
    # Least hashes crowd together at zero.
    return mix(h[place[first]]), place[first], starts[first], starts[last]


def blocks(data: np.ndarray, offsets: np.ndarray, threshold: int, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, where documents start in them, number of the first) of about `size` bytes; a long document goes in pieces that overlap by a window.

    Places are counted from the start of the bytes; a piece's own start may be negative.
    """
    for i, j in tiles(offsets, size):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j > i + 1 or hi - lo <= size:
            yield data[lo:hi], offsets[i:j] - lo, i
            continue
        for at in range(lo, hi, size):
            yield data[at : min(at + size + threshold - 1, hi)], np.array([lo - at]), i


def _digests(raw: bytes, starts, ends, size: int = 8) -> np.ndarray:
    """A row of `size` bytes, as 64-bit numbers, for each of some pieces of raw."""
    found = b"".join(hashlib.blake2b(raw[a:z], digest_size=size).digest() for a, z in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(found, dtype=np.int64).reshape(-1, size // 8).T


#: A piece: two digits that tell equal pieces, the text's id, and start, windows and another number of 16 bits in one.
_PIECE = "key long, hull long, t1 long, t2 long, at long"


def _packed(start: np.ndarray, windows: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 32) | (windows.astype(np.int64) << 16) | other.astype(np.int64)


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 32, (at >> 16) & 0xFFFF, at & 0xFFFF


def _frame(columns, schema: str):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def text_id(data: bytes | memoryview) -> bytes:
    """What a text is known by: the first 16 bytes of its SHA-256."""
    return hashlib.sha256(data).digest()[:16]


def hulls(batches, p: Params):
    """The bundles of one binary column of texts as pieces; the other number is the gram's place in the bundle."""
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        own = functools.cache(lambda d, data=data, offsets=offsets: text_id(data[offsets[d] : offsets[d + 1]].tobytes()))
        for raw, heads, i in blocks(data, offsets, p.threshold):
            key, gram, first, last = bundles(raw, heads[heads > 0], p)
            if not len(key):
                continue
            doc = np.searchsorted(heads, first, side="right") - 1
            t1, t2 = np.frombuffer(b"".join(own(d + i) for d in doc.tolist()), dtype=np.int64).reshape(-1, 2).T
            (hull,) = _digests(raw.tobytes(), first, last + p.threshold)
            yield _frame([key.view(np.int64), hull, t1, t2, _packed(first - heads[doc], last - first + 1, gram - first)], _PIECE)


def _cells(raw: bytes, start: int, windows: int, gram: int, p: Params) -> tuple[np.ndarray, ...]:
    """Of the cells of a bundle: where the bytes that a whole cell shares begin, first and last window, all from the bundle's start.

    The shared bytes lie within each window of a cell, also of one that the bundle's ends cut short.
    """
    c = np.arange((gram - windows + 1) // p.cell, gram // p.cell + 1)
    return gram - c * p.cell, gram - np.minimum(gram, c * p.cell + p.cell - 1), gram - np.maximum(gram - windows + 1, c * p.cell)


def cells(batches, p: Params):
    """The cells of bundles as pieces; the other number is a cell's place in its bundle."""
    for batch in filter(len, batches):
        out = []
        start, windows, gram = _unpacked(_numbers(batch.column(2)))
        for k, raw in enumerate(batch.column(3).to_pylist()):
            shared, a, z = _cells(raw, start[k], windows[k], gram[k], p)
            (key,), (hull,) = _digests(raw, shared, shared + p.threshold - p.cell + 1), _digests(raw, a, z + p.threshold)
            out.append((key, hull, _packed(start[k] + a, z - a + 1, a)))
        n = [len(x[0]) for x in out]
        key, hull, at = (np.concatenate([x[i] for x in out]) for i in range(3))
        yield _frame([key, hull, *(np.repeat(_numbers(batch.column(i)), n) for i in (0, 1)), at], _PIECE)


def windows(batches, p: Params):
    """Each window of the cells in the fifth column, as pieces."""
    for batch in filter(len, batches):
        out = []
        for raw, wanted in zip(batch.column(3).to_pylist(), batch.column(4), strict=True):
            start, n, place = _unpacked(_numbers(wanted.values))
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(place, n) + k
            out.append((*_digests(raw, at, at + p.threshold, 16), _packed(np.repeat(start, n) + k, np.ones(len(k)), np.zeros(len(k)))))
        n = [len(x[0]) for x in out]
        key, hull, at = (np.concatenate([x[i] for x in out]) for i in range(3))
        yield _frame([key, hull, *(np.repeat(_numbers(batch.column(i)), n) for i in (0, 1)), at], _PIECE)


#: Pieces that are looked at at a time, and how many copies of one among them are sent as they are.
_ROWS, _COPIES = 1 << 16, 4


def _joined(batches) -> Iterator[np.ndarray]:
    """The columns of some batches at a time."""
    rows, n = [], 0
    for batch in batches:
        rows.append(np.stack([_numbers(c) for c in batch.columns]))
        n += batch.num_rows
        if n >= _ROWS:
            yield np.concatenate(rows, axis=1)
            rows, n = [], 0
    if n:
        yield np.concatenate(rows, axis=1)


def _sent(batches, once: bool):
    """Pieces as they are sent: of more than _COPIES equal ones, one by its key, and all their places, known to occur again, by other keys.

    So a passage that is everywhere does not meet in one task. Known places have a negative `at`.
    """
    for rows in _joined(batches):
        rows = rows[:, np.lexsort(rows[::-1])]
        change = np.concatenate((np.ones((5, 1), dtype=bool), rows[:, 1:] != rows[:, :-1]), axis=1)
        new_place = change.any(axis=0)
        if once:
            rows, change, new_place = rows[:, new_place], change[:, new_place], new_place[new_place]
        new_hull = change[0] | change[1]
        n = np.diff(np.append(np.flatnonzero(new_hull), len(new_hull)))
        many = np.repeat(n > _COPIES, n)
        known = rows[:, many & new_place]
        known[0] = mix((known[2] ^ known[4]).view(np.uint64)).view(np.int64)
        known[1], known[4] = 0, ~known[4]
        yield _frame(np.concatenate((rows[:, ~many | new_hull], known), axis=1), _PIECE)


_SETTLED = "t1 long, t2 long, at long, more boolean"


def _settle(batches, once: bool):
    """Of sorted pieces: those whose hull occurs again, and with `more` one of each hull whose key has several.

    Of the rows before, it keeps three at most, however many share a key: the first of the key while all have one
    hull (`alone`), the last but one, and the last, which waits for what follows. once: rows of one place are one piece.
    """
    rows, seen, alone = np.zeros((5, 0), dtype=np.int64), 0, True
    for new in itertools.chain(_joined(batches), [None]):
        if new is not None:
            known = new[4] < 0
            if known.any():
                yield _frame([*new[2:4, known], ~new[4, known], np.zeros(known.sum(), dtype=bool)], _SETTLED)
            rows = np.concatenate((rows, new[:, ~known]), axis=1)
        n, end = rows.shape[1], rows.shape[1] - (new is not None)
        if not n:
            continue
        change = rows[:, 1:] != rows[:, :-1]
        new_key = np.concatenate(([True], change[0]))
        new_hull = np.concatenate(([True], change[0] | change[1]))
        new_place = np.concatenate(([True], change.any(axis=0)))
        if once and not new_place.all():
            seen = int(new_place[:seen].sum())
            rows, new_key, new_hull = rows[:, new_place], new_key[new_place], new_hull[new_place]
            new_place, n = np.ones(rows.shape[1], dtype=bool), rows.shape[1]
            end = n - (new is not None)
        again = ~new_hull
        again[:-1] |= ~new_hull[1:]
        # Rows of one place follow each other; one of them is enough.
        again = np.flatnonzero(again[seen:end] & new_place[seen:end]) + seen
        first = np.flatnonzero(new_hull[:end])
        second = np.flatnonzero(~new_key[first])
        before = first[second - 1]
        before = before[new_key[before] & ((before > 0) | alone)]
        more = np.concatenate((before, first[second][first[second] >= seen]))
        for at, kind in ((again, False), (more, True)):
            if len(at):
                yield _frame([*rows[2:, at], np.full(len(at), kind)], _SETTLED)
        if n == 1:
            seen = 0
            continue
        a = int(np.flatnonzero(new_key[: n - 1])[-1])
        alone = new_hull[a : n - 1].sum() == 1 and (a > 0 or alone)
        keep = [a, n - 2, n - 1] if alone and a < n - 2 else [n - 2, n - 1]
        rows, seen = rows[:, keep], len(keep) - 1


def settled(table: DataFrame, pieces, name: str, once: bool = False) -> DataFrame:
    """t1, t2, at, more, as _settle has them, of the pieces that a function makes of batches of the table; they meet by their key."""
    by_key = table.mapInArrow(lambda batches: _sent(pieces(batches), once), _PIECE).repartition("key").sortWithinPartitions("key", "hull", "t1", "t2", "at")
    return saved(by_key.mapInArrow(lambda batches: _settle(batches, once), _SETTLED), name)


def _texts(texts: DataFrame) -> DataFrame:
    """t1, t2, data of one binary column of texts; of equal texts of a task, one."""
    def run(batches):
        known = set()
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            ids = [text_id(data[a:z].tobytes()) for a, z in itertools.pairwise(offsets.tolist())]
            some = [d for d, x in enumerate(ids) if x not in known and not known.add(x)]
            if some:
                t1, t2 = np.frombuffer(b"".join(ids[d] for d in some), dtype=np.int64).reshape(-1, 2).T
                yield _frame([t1, t2, batch.column(0).take(np.array(some))], _TEXT)

    return texts.mapInArrow(run, _TEXT)


_TEXT = "t1 long, t2 long, data binary"
_MIXED = "t1 long, t2 long, at long, data binary"


def _bytes_of(wanted: DataFrame, p: Params) -> DataFrame:
    """t1, t2, at, data: the bytes of the pieces `ats` of a text in `data`."""
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for d, ats in enumerate(batch.column(3)):
                at = _numbers(ats.values)
                start, n, _ = _unpacked(at)
                a, z = start + offsets[d], start + offsets[d] + n + p.threshold - 1
                yield _frame([*(np.full(len(at), batch.column(i)[d].as_py()) for i in (0, 1)), at, [data[i:j].tobytes() for i, j in zip(a.tolist(), z.tolist(), strict=True)]], _MIXED)

    return wanted.mapInArrow(run, _MIXED)


def spans(texts: DataFrame, p: Params = Params()) -> DataFrame:
    """t1, t2, at of one binary column of texts: repeated windows start at the places of the text t1, t2 that `at` has packed."""
    whole = settled(texts, functools.partial(hulls, p=p), "suffix-hulls")
    wanted = whole.where("more").groupBy("t1", "t2").agg(F.collect_list("at").alias("ats"))
    mixed = saved(_bytes_of(_texts(texts).join(wanted, ["t1", "t2"]), p), "suffix-mixed")
    cut = settled(mixed, functools.partial(cells, p=p), "suffix-cells", once=True)
    hull = F.shiftright("at", 32) - F.col("at").bitwiseAND(0xFFFF)
    wanted = cut.where("more").groupBy("t1", "t2", hull.alias("start")).agg(F.collect_list("at").alias("ats"))
    mixed = mixed.withColumn("start", F.shiftright("at", 32)).join(wanted, ["t1", "t2", "start"]).select("t1", "t2", "at", "data", "ats")
    single = settled(mixed, functools.partial(windows, p=p), "suffix-windows", once=True)
    return whole.unionAll(cut).unionAll(single).where("not more").drop("more")


def merged(starts: np.ndarray, counts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that windows cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + counts - 1 + threshold)[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))]


def _long(sha: Column, at: int) -> Column:
    """Eight bytes of a digest in hexadecimal digits, as numpy reads them."""
    swapped = F.concat(*[F.substring(sha, at + 14 - 2 * k, 2) for k in range(8)])
    return F.conv(swapped, 16, -10).cast("long")


def removed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end) and kept (the bytes that stay).

    A byte goes if a window of p.threshold bytes that covers it also starts anywhere else, in the same text or in
    another; windows lie within a text and are judged on the input. Texts are UTF-8 bytes, null counts as empty;
    one shorter than a window loses nothing. Rows with one doc_id, or none, are rows of their own; equal texts of
    a window or more are removed whole, all of them. No rows give no rows, other columns are ignored.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    with freed_shuffles(docs.sparkSession):
        found = saved(spans(rows.select("data"), p).groupBy("t1", "t2").agg(F.collect_set("at").alias("ats")), "suffix-spans")
    rows = rows.withColumn("sha", F.sha2("data", 256))
    rows = rows.withColumns({"u1": _long(F.col("sha"), 1), "u2": _long(F.col("sha"), 17)})
    rows = rows.withColumn("maybe", may_hold(found.select("t1"), F.col("u1")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    size = F.octet_length("data").cast("long").alias("n_bytes")
    clean = rows.where("not maybe").select("doc_id", size, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), none.alias("spans"), F.col("data").alias("kept"))
    other = rows.where("maybe").join(found, (F.col("u1") == F.col("t1")) & (F.col("u2") == F.col("t2")), "left").select("doc_id", "data", "ats")
    return clean.unionAll(other.mapInArrow(lambda batches: _cut(batches, p.threshold), clean.schema))


def _cut(batches, threshold: int):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = [[] for _ in range(6)]
        data, offsets = buffers(batch.column(1))
        for d in range(batch.num_rows):
            raw = data[offsets[d] : offsets[d + 1]]
            ats = batch.column(2)[d].values
            a, z = merged(*_unpacked(_numbers(ats))[:2], threshold) if ats is not None else (np.zeros(0, dtype=np.int64),) * 2
            kept = b"".join(raw[i:j].tobytes() for i, j in zip([0, *z.tolist()], [*a.tolist(), len(raw)], strict=True))
            for values, x in zip(out, (len(raw), int((z - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in zip(a.tolist(), z.tolist(), strict=True)], kept), strict=True):
                values.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(out, types, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
