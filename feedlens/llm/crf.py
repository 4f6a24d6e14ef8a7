"""Toxicity by a linear-chain conditional random field over tokens.

Only documents carry labels, so tokens are labelled first: a token of a toxic training document is toxic if
its word or one of its prefixes occurs far more often in toxic documents than in clean ones; every token of
a clean document is clean. The field is fitted to those.
Forward-backward marginals give toxic spans with their offsets, and their sums give a document's score
through a logistic curve that is fitted to training documents the field has not seen.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.shared import TILE_BYTES, buffers, first_by_hash, short_batches, tiles


@dataclass(frozen=True)
class Params:
    sample_docs: int = 6000  #: labelled documents that the fit takes at most, in order of a hash of doc_id
    sample_bytes: int = 10 << 20  #: bytes of text that they have at most
    sample_least: int = 30  #: documents of either label that it has where the table does
    calibration: float = 0.35  #: share of them that only the logistic curve sees
    bits: int = 20  #: hashed features: 2^bits weights
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)  #: prefix lengths in bytes that are features
    support: int = 4  #: toxic documents that a feature needs to label a token
    log_odds: float = 3.0  #: and its log odds of toxic to clean occurrences per token
    epochs: int = 10
    rate: float = 0.3
    clean_chains: int = 20_000  #: chains without a toxic token that the fit takes of its sample, in random order, at least
    clean_ratio: int = 8  #: or as many for each chain with one
    span: float = 0.5  #: marginal from which a token belongs to a span


@dataclass
class Model:
    weights: np.ndarray  #: by hashed feature, toxic against clean
    bias: float
    into: float  #: clean to toxic, against staying clean
    stay: float  #: toxic to toxic, against staying clean
    leave: float  #: toxic to clean, against staying clean
    curve: np.ndarray  #: weights of document features


# ---------------------------------------------------------------- tokens and their features

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_STOP = np.zeros(256, dtype=np.int32)
_STOP[[10, 33, 46, 63]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@dataclass
class Tokens:
    start: np.ndarray  #: byte offsets in the tile
    end: np.ndarray
    doc: np.ndarray
    chain: np.ndarray  #: number of the chain of each token
    features: list[np.ndarray]  #: hashed features, one array for each kind; 0 is none


def tokenize(data: np.ndarray, offsets: np.ndarray, p: Params) -> Tokens:
    """Tokens of consecutive documents: runs of letters and digits, lower-cased; bytes over 127 count as letters."""
    lo = int(offsets[0])
    raw = data[lo : int(offsets[-1])]
    low = _LOWER[raw]
    accent = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    low[accent] += 0x20  # Latin-1 capitals in UTF-8
    inside = np.zeros(len(low) + 2, dtype=np.int8)
    inside[1:-1] = _TOKEN[low]
    edge = np.diff(inside)
    cuts = np.unique(offsets[1:-1] - lo)
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    start = np.sort(np.concatenate((np.flatnonzero(edge == 1), cuts)))
    end = np.sort(np.concatenate((np.flatnonzero(edge == -1), cuts)))
    n = len(start)
    doc = np.searchsorted(offsets - lo, start, side="right") - 1
    if not n:
        return Tokens(start, end, doc, doc, [])
    stops = np.concatenate(([0], np.cumsum(_STOP[low])))
    broken = np.ones(n, dtype=bool)
    broken[1:] = (stops[start[1:]] > stops[end[:-1]]) | (doc[1:] != doc[:-1])
    size = end - start
    padded = np.concatenate((low, np.zeros(8, dtype=np.uint8)))
    head = np.zeros(n, dtype=np.uint64)
    tail = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        head |= np.where(k < size, padded[start + k], 0).astype(np.uint64) << np.uint64(8 * k)
        tail |= np.where(k < size, padded[np.maximum(end - 1 - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    shift = np.uint64(64 - p.bits)
    word = _mix((head ^ (tail * _GOLD)) + size.astype(np.uint64) * _GOLD)
    features = [np.maximum((word * _GOLD) >> shift, np.uint64(1)).astype(np.int32)]
    for k in p.prefixes:
        part = head & np.uint64((1 << 8 * k) - 1)
        hashed = (_mix(part + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * _GOLD) >> shift
        features.append(np.where(size > k, np.maximum(hashed, np.uint64(1)), np.uint64(0)).astype(np.int32))
    return Tokens(start, end, doc, np.cumsum(broken) - 1, features)


def _joined(parts: list[tuple[Tokens, int]]) -> Tokens:
    """Tokens of consecutive groups of documents, each with its first document's number, in small types."""
    chains = np.cumsum([0, *(int(t.chain[-1]) + 1 if len(t.chain) else 0 for t, _ in parts)])
    small = lambda arrays: np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, dtype=np.int32) for x in arrays)])
    kinds = [t.features for t, _ in parts if t.features]
    return Tokens(small(t.start for t, _ in parts), small(t.end for t, _ in parts), small(t.doc + d for t, d in parts), small(t.chain + c for (t, _), c in zip(parts, chains, strict=False)), [small(f) for f in zip(*kinds, strict=True)])


# ---------------------------------------------------------------- the field


def _chains(chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token and length of each chain, longest chain first, and how many chains reach each place."""
    first = np.flatnonzero(np.concatenate(([True], chain[1:] != chain[:-1])))
    length = np.diff(np.append(first, len(chain)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    reach = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
    return first, length, reach


def _cross(x: np.ndarray, m: Model, forward: bool) -> np.ndarray:
    """A message in log odds after one transition."""
    a, b = (m.into, m.leave) if forward else (m.leave, m.into)
    return np.logaddexp(a, m.stay + x) - np.logaddexp(0.0, b + x)


#: Tokens up to which chains are walked side by side, place by place; longer ones are walked one by one.
SIDE = 128


def _walk(e: list[float], m: Model) -> tuple[list[float], list[float]]:
    """Forward and backward messages of one chain."""
    def cross(x: float, a: float, b: float) -> float:
        over, under = m.stay + x, b + x
        top = max(a, over) + log1p(exp(-abs(a - over)))
        return top - (max(0.0, under) + log1p(exp(-abs(under))))

    exp, log1p = math.exp, math.log1p
    ahead, back = e[:1], [0.0]
    for k in range(1, len(e)):
        ahead.append(e[k] + cross(ahead[-1], m.into, m.leave))
    for k in range(len(e) - 1, 0, -1):
        back.append(cross(e[k] + back[-1], m.leave, m.into))
    return ahead, back[::-1]


def emissions(t: Tokens, m: Model) -> np.ndarray:
    out = np.full(len(t.start), m.bias)
    for f in t.features:
        out += m.weights[f]
    return out


def marginals(t: Tokens, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance of toxic for each token by forward-backward, and the forward and backward messages in log odds."""
    e = emissions(t, m)
    ahead, back = e.copy(), np.zeros(len(e))
    first, length, reach = _chains(t.chain)
    for a, n in zip(first[length > SIDE], length[length > SIDE], strict=True):
        ahead[a : a + n], back[a : a + n] = _walk(e[a : a + n].tolist(), m)
    first, reach = first[length <= SIDE], reach[:SIDE] - np.count_nonzero(length > SIDE)
    for k in range(1, len(reach)):
        at = first[: reach[k]] + k
        ahead[at] = e[at] + _cross(ahead[at - 1], m, True)
    for k in range(len(reach) - 2, -1, -1):
        at = first[: reach[k + 1]] + k
        back[at] = _cross(e[at + 1] + back[at + 1], m, False)
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(ahead + back))), ahead, back


def _first_labels(t: Tokens, toxic: np.ndarray, n_docs: int, p: Params) -> np.ndarray:
    """Token labels: 1 in toxic documents where a feature is far more frequent than in clean ones."""
    size = 1 << p.bits
    of = toxic[t.doc]
    label = np.zeros(len(t.start), dtype=bool)
    total = [max(1, int((~of).sum())), max(1, int(of.sum()))]
    for f in t.features:
        here = f > 0
        clean, bad = (np.bincount(f[here & (of == y)], minlength=size) for y in (False, True))
        pair = np.unique(f[here & of].astype(np.int64) * n_docs + t.doc[here & of])
        docs = np.bincount((pair // n_docs).astype(np.int64), minlength=size)
        odds = np.log((bad + 0.5) / total[1]) - np.log((clean + 0.5) / total[0])
        label |= here & ((odds >= p.log_odds) & (docs >= p.support))[f]
    return label & of


def _fit_field(t: Tokens, label: np.ndarray, p: Params, seed: int = 7) -> Model:
    """AdaGrad on the chains' likelihood; the gradient is marginals less labels, for transitions pairwise."""
    m = Model(np.zeros(1 << p.bits, dtype=np.float64), -3.0, -1.0, 0.5, 0.0, np.zeros(0))
    first, length, _ = _chains(t.chain)
    chain_toxic = np.add.reduceat(label, np.sort(first)) > 0
    chains = len(first)
    rng = np.random.default_rng(seed)
    starts = np.sort(first)
    ends = np.append(starts[1:], len(t.start))
    # All chains with a toxic token, and a bounded number of the others of this sample.
    bad = np.flatnonzero(chain_toxic)
    good = np.flatnonzero(~chain_toxic)
    good = rng.permutation(good)[: max(p.clean_chains, p.clean_ratio * len(bad))]
    use = np.concatenate((bad, good))
    squares, others = np.full(1 << p.bits, 1e-3), np.full(4, 1e-3)
    batch = max(64, min(512, chains // 50 + 1))
    for _ in range(p.epochs):
        use = rng.permutation(use)
        for a in range(0, len(use), batch):
            some = np.sort(use[a : a + batch])
            at = np.concatenate([np.arange(starts[c], ends[c]) for c in some])
            part = Tokens(t.start[at], t.end[at], t.doc[at], t.chain[at], [f[at] for f in t.features])
            y = label[at].astype(np.float64)
            q, ahead, back = marginals(part, m)
            away = q - y
            touched, place = np.unique(np.concatenate(part.features), return_inverse=True)
            grad = np.bincount(place, weights=np.tile(away, len(part.features)), minlength=len(touched))
            grad = np.where(touched > 0, grad / len(some) + 1e-5 * m.weights[touched], 0)
            squares[touched] += grad**2
            m.weights[touched] -= p.rate * grad / np.sqrt(squares[touched])
            # Transitions: expected less observed counts of each pair of labels.
            same = np.flatnonzero(part.chain[1:] == part.chain[:-1])
            e = emissions(part, m)
            x, z = ahead[same], (e + back)[same + 1]
            scores = np.stack([np.zeros(len(same)), m.into + z, m.leave + x, m.stay + x + z])
            scores = np.exp(scores - scores.max(axis=0))
            scores /= scores.sum(axis=0)
            u, v = y[same], y[same + 1]
            step = np.array([away.sum(), (scores[1] - (1 - u) * v).sum(), (scores[2] - u * (1 - v)).sum(), (scores[3] - u * v).sum()]) / len(some)
            others += step**2
            step = p.rate * step / np.sqrt(others)
            m.bias, m.into, m.leave, m.stay = m.bias - step[0], m.into - step[1], m.leave - step[2], m.stay - step[3]
    return m


class Sums:
    """What a document's score needs of its tokens' marginals; a document may come in several parts."""

    def __init__(self, n_docs: int):
        self.total, self.tokens, self.most, self.sure = (np.zeros(n_docs) for _ in range(4))

    def add(self, q: np.ndarray, doc: np.ndarray) -> None:
        n = len(self.total)
        self.total += np.bincount(doc, weights=q, minlength=n)
        self.tokens += np.bincount(doc, minlength=n)
        np.maximum.at(self.most, doc, q)
        self.sure += np.bincount(doc, weights=q > 0.5, minlength=n)

    def features(self) -> np.ndarray:
        """Rows of constant, log density, the most, log number of toxic tokens."""
        density = np.log((self.total + 0.05) / (self.tokens + 20.0))
        return np.stack([np.ones(len(density)), density, self.most, np.log1p(self.sure)], axis=1)


def doc_features(q: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    sums = Sums(n_docs)
    sums.add(q, doc)
    return sums.features()


def parts(data: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
    """Offsets of consecutive documents; a document larger than two tiles comes part by part.

    Parts end at a sentence's end, or at white space where no sentence ends over a whole tile.
    """
    if len(own) > 2 or own[-1] - own[0] <= 2 * TILE_BYTES:
        yield own
        return
    at, last = int(own[0]), int(own[-1])
    while at < last:
        end = min(at + TILE_BYTES, last)
        if end < last:
            window = data[end : min(end + TILE_BYTES, last)]
            stops = np.flatnonzero(_STOP[window])
            stops = stops if len(stops) else np.flatnonzero(~_TOKEN[window])
            end = end + int(stops[0]) + 1 if len(stops) else end + len(window)
        yield np.array([at, end])
        at = end


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (q - y) + ridge * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[bytes], toxic: np.ndarray, p: Params = Params()) -> Model | None:
    """A model of labelled documents; None unless both labels occur."""
    toxic = np.asarray(toxic, dtype=bool)
    if toxic.all() or not toxic.any():
        return None
    # Copies stand together, so that the curve sees no text that the field was fitted to.
    _, order = np.unique(np.array([hash_bytes(x) for x in texts], dtype=np.uint64), return_inverse=True)
    rank = np.argsort(np.argsort(_mix(order.astype(np.uint64) * _GOLD + np.uint64(11)), kind="stable"), kind="stable")
    held = rank < p.calibration * len(texts) if len(texts) >= 40 else np.ones(len(texts), dtype=bool)
    seen = ~held if len(texts) >= 40 else held
    if not (toxic[seen].any() and not toxic[seen].all() and toxic[held].any() and not toxic[held].all()):
        held = seen = np.ones(len(texts), dtype=bool)

    def tokens(mask: np.ndarray) -> Tokens:
        own = [x for x, use in zip(texts, mask, strict=True) if use]
        return _joined([(tokenize(np.frombuffer(b"".join(own[a : a + 100]) or b" ", dtype=np.uint8), np.cumsum([0, *map(len, own[a : a + 100])]), p), a) for a in range(0, len(own), 100)])

    t = tokens(seen)
    if not len(t.start):
        return None
    model = _fit_field(t, _first_labels(t, toxic[seen], int(seen.sum()), p), p)
    h = tokens(held)
    if not len(h.start):
        return None
    q = marginals(h, model)[0]
    model.curve = _fit_curve(doc_features(q, h.doc, int(held.sum())), toxic[held].astype(np.float64))
    return model


def hash_bytes(x: bytes) -> int:
    import zlib

    return zlib.crc32(x) | len(x) << 32


# ---------------------------------------------------------------- Spark


def training_rows(docs: DataFrame, labels: DataFrame, p: Params) -> tuple[list[bytes], np.ndarray]:
    """A bounded sample of labelled rows outside the held-out fifth: whole texts and labels.

    Documents come in order of a hash of doc_id; one that would take the sample over its bytes is skipped. Where a label
    so has fewer than `sample_least`, its own first ones, of half of the bytes at most, take the place of the last others.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.where(F.crc32(F.col("_doc").cast("string").cast("binary")) % 5 != 0)
    order = F.xxhash64("_doc", F.lit("crf"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = rows.select("_doc", F.octet_length("text").cast("long").alias("size")).groupBy("_doc").agg(F.sum("size").alias("size")).join(marks, "_doc").select("_doc", "size", "toxic")
    kept = _drawn(sizes, order, p)
    if not kept:
        return [], np.zeros(0, dtype=bool)
    chosen = docs.sparkSession.createDataFrame(kept, "_doc long")
    some = rows.join(F.broadcast(chosen), "_doc").join(marks, "_doc").orderBy(order, "text").limit(p.sample_docs).select(F.col("text").cast("binary").alias("text"), "toxic").collect()
    return [bytes(r["text"]) for r in some], np.array([r["toxic"] == 1 for r in some], dtype=bool)


def _drawn(sizes: DataFrame, order: Column, p: Params) -> list[tuple[int]]:
    """Keys of the sample from rows (_doc, size, toxic)."""
    first = lambda rows, n: first_by_hash(rows, order, n).select("_doc", "size", "toxic").collect()

    def fitting(rows: list, most: int) -> list:
        out, held = [], 0
        for r in rows:
            if held + r["size"] <= most:
                out.append(r)
                held += r["size"]
        return out

    every = first(sizes, p.sample_docs)
    kept, least = fitting(every, p.sample_bytes), min(p.sample_least, p.sample_docs // 2)
    for label in (0, 1):
        if sum(int(r["toxic"] == 1) == label for r in kept) < least:  # rare in the table
            own = fitting(first(sizes.where((F.col("toxic") == 1).cast("int") == label), least), p.sample_bytes // 2)
            known = {r["_doc"] for r in own}
            kept = fitting([*own, *[r for r in every if r["_doc"] not in known]][: p.sample_docs], p.sample_bytes)
    return [(r["_doc"],) for r in kept]


def trained(docs: DataFrame, labels: DataFrame, p: Params) -> Model | None:
    """A model of the labelled sample; None, with a warning, where there are no labels of both kinds.

    Labels of both kinds whose sample gives no model are an error: scores of 0 would let everything pass.
    """
    texts, toxic = training_rows(docs, labels, p)
    model = fit(texts, toxic, p)
    if model is None:
        kinds = labels.join(docs.select(F.col("doc_id").alias("_doc")), F.col("doc_id") == F.col("_doc"), "left_semi").where("toxic is not null").where(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 != 0).select(F.col("toxic").cast("int")).distinct().count()
        if kinds > 1:
            raise ValueError(f"the labelled sample of {len(texts)} documents gives no model; raise sample_docs or sample_bytes")
        warnings.warn("no labels of both kinds: every toxicity score is 0", stacklevel=3)
    else:
        model.weights = model.weights.astype(np.float32)
    return model


def _score(model: Model | None, p: Params):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in tiles(offsets):
                n = j - i
                scores, counts, before = np.zeros(n), np.zeros(n, dtype=np.int64), 0
                sums, found = Sums(n), [(np.zeros(0), np.zeros(0), np.zeros(0))]
                for own in parts(data, offsets[i : j + 1]) if model is not None else ():
                    t = tokenize(data, own, p)
                    q = marginals(t, model)[0] if len(t.start) else np.zeros(0)
                    sums.add(q, t.doc)
                    hit = np.flatnonzero(q >= p.span)
                    # Offsets count characters of the document.
                    chars = np.concatenate(([0], np.cumsum((data[own[0] : own[-1]] & 0xC0) != 0x80)))
                    if len(hit):
                        fresh = np.concatenate(([True], (np.diff(hit) > 1) | (t.chain[hit[1:]] != t.chain[hit[:-1]])))
                        heads = np.flatnonzero(fresh)
                        last = np.append(heads[1:], len(hit)) - 1
                        doc = t.doc[hit[heads]]
                        base = chars[own[doc] - own[0]] - before
                        found.append((chars[t.start[hit[heads]]] - base, chars[t.end[hit[last]]] - base, np.add.reduceat(q[hit], heads) / (last - heads + 1)))
                        counts += np.bincount(doc, minlength=n)
                    before += int(chars[-1])
                if model is not None:
                    scores = 1 / (1 + np.exp(-np.clip(sums.features() @ model.curve, -700, 700)))
                starts, ends, means = (np.concatenate(x) for x in zip(*found, strict=True))
                spans = pa.StructArray.from_arrays([pa.array(starts.astype(np.int32), pa.int32()), pa.array(ends.astype(np.int32), pa.int32()), pa.array(means, pa.float64())], ["start", "end", "marginal"])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), spans)], ["doc_id", "score", "spans"])

    return run


def score(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, spans (start, end, marginal; in characters).

    Null text counts as empty; texts without tokens get the score of no toxic token among none. A null
    doc_id has no label and is not held out. Without labels of both kinds every score is 0, with a warning. Repeated rows
    are scored alike. An empty table gives an empty result; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    model = trained(docs, labels, p)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(_score(model, p), "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def clean(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below 0.5; whole batches pass through the tasks.

    Without labels of both kinds all rows stay, with a warning.
    """
    short_batches(docs.sparkSession)
    model = trained(docs, labels, p)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = batch.column(at)
            if not (pa.types.is_string(text.type) or pa.types.is_large_string(text.type)):
                text = text.cast(pa.string())
            data, offsets = buffers(text)
            keep = np.ones(batch.num_rows, dtype=bool)
            for i, j in tiles(offsets):
                sums = Sums(j - i)
                for own in parts(data, offsets[i : j + 1]):
                    t = tokenize(data, own, p)
                    sums.add(marginals(t, model)[0] if len(t.start) else np.zeros(0), t.doc)
                keep[i:j] = sums.features() @ model.curve < 0
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
