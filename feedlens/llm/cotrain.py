"""Document quality by co-training a text-content and a page-metadata classifier.

The text view sees words, pairs of words, byte classes and how far a text repeats itself; the page view sees
source, language and declared length, and nothing of the text. Each view holds a table of evidence, the log
of how much likelier a feature is in good documents, and a logistic regression on the evidence of a
document's features. In every round both views score all documents, and each hands its most confident ones
to the other view, whose evidence is then counted anew over labelled and all confident documents. At the end
both views are calibrated on labelled documents that neither was fitted to, and a score combines both.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.shared import TILE_BYTES, buffers, first_by_hash, hashed_words, mix, saved, short_batches, tiles


@dataclass(frozen=True)
class Params:
    sample_docs: int = 8000  #: labelled documents that the fits take at most, in order of a hash of doc_id
    calibration: float = 0.3  #: share of them that only the calibration sees
    rounds: int = 3
    share: float = 0.1  #: share of all documents that a view is confident of in a round
    pseudo_weight: float = 0.3  #: weight of a pseudo-label next to a label, where the giver is right about all it is confident of
    smooth: float = 2.0  #: documents that a feature is taken to have been seen in, in the classes' own proportion
    ridge: float = 0.1


# ---------------------------------------------------------------- views

#: Byte classes of the text view: each ASCII mark of its own; lower case, upper case, digits, line ends, white space, others, bytes over 127.
_CLASS = np.zeros(256, dtype=np.int64)
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[10, 13]], _CLASS[[9, 11, 12, 32]] = 5, 6
for _i, _b in enumerate(_MARKS):
    _CLASS[_b] = 7 + _i
_CLASSES = 7 + len(_MARKS)
BINS = 16  #: bins of each byte class's share and of each figure
#: Features of the text view: so many buckets of words, as many of pairs, then the bins of SHAPE figures.
GRAMS = 1 << 15
SHAPE = _CLASSES + 5
TEXT = 2 * GRAMS + SHAPE * BINS
#: Features of the page view: buckets of sources, languages, powers of two of the length, and sources with languages.
_PAGE = np.array([0, 256, 320, 352, 1376])
PAGE = int(_PAGE[-1])
ACTIVE = len(_PAGE) - 1


def _distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and values (40 bits) of distinct pairs, in order, and how often each occurs."""
    key, times = np.unique((doc.astype(np.uint64) << np.uint64(40)) | value, return_counts=True)
    return (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1), times


def text_view(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of words and pairs of each document, how many each has, and the bins of its figures."""
    n = len(offsets) - 1
    words, first = hashed_words(data, offsets)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    d1, w, times = _distinct(doc, words >> np.uint64(24))
    joined = doc[:-1] == doc[1:]
    pair = mix(words[:-1] * np.uint64(3) + words[1:])[joined]
    d2, v, _ = _distinct(doc[:-1][joined], pair >> np.uint64(24))
    docs = np.concatenate((d1, d2))
    bucket = np.concatenate((w % np.uint64(GRAMS), np.uint64(GRAMS) + v % np.uint64(GRAMS)))
    docs, bucket, _ = _distinct(docs, bucket)
    shares = np.zeros(n * _CLASSES, dtype=np.int64)
    for lo in range(int(offsets[0]), int(offsets[-1]), TILE_BYTES):
        hi = min(lo + TILE_BYTES, int(offsets[-1]))
        own = np.repeat(np.arange(n) * _CLASSES, np.diff(np.clip(offsets, lo, hi)))
        shares += np.bincount(own + _CLASS[data[lo:hi]], minlength=n * _CLASSES)
    size = np.maximum(np.diff(offsets), 1)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, d1, times)
    some, pairs = np.maximum(count, 1), np.maximum(count - 1, 1)
    figures = np.stack([np.bincount(d1, minlength=n) / some, most / some, np.bincount(d2, minlength=n) / pairs, np.minimum(size / some, 30) / 30, np.minimum(np.log2(1 + count) / 16, 1)], axis=1)
    figures = np.concatenate((np.sqrt(shares.reshape(n, _CLASSES) / size[:, None]), figures), axis=1)
    shape = 2 * GRAMS + np.arange(SHAPE) * BINS + np.minimum(figures * BINS, BINS - 1).astype(np.int64)
    return bucket.astype(np.int32), np.bincount(docs, minlength=n), shape.astype(np.int32)


def page_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """The active features of what is known about a page: source, language, declared length, source with language."""
    name = lambda x, k: zlib.crc32(str(x).encode()) % k
    size = [0 if x is None else max(0, int(x)).bit_length() % 32 for x in n_chars]
    rows = [(name(s, 256), name(t, 64), z, name((s, t), 1024)) for s, t, z in zip(source, lang, size, strict=True)]
    return (np.array(rows, dtype=np.int64).reshape(-1, ACTIVE) + _PAGE[:-1]).astype(np.int32)


def _lists(sizes: np.ndarray, values: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values.reshape(-1), pa.int32()))


def _views(batches):
    import pyarrow as pa

    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j in tiles(offsets):
            n = j - i
            part = batch.slice(i, n)
            grams, sizes, shape = text_view(data, offsets[i : j + 1])
            page = page_view(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(sizes, grams), _lists(np.full(n, SHAPE), shape), _lists(np.full(n, ACTIVE), page)], ["doc_id", "grams", "shape", "page"])


def views(docs: DataFrame) -> DataFrame:
    """doc_id, grams and shape (features of the text) and page (features of the metadata) of every row."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(_views, "doc_id long, grams array<int>, shape array<int>, page array<int>")


# ---------------------------------------------------------------- evidence


@dataclass
class Counts:
    """Documents of each class, bad and good, and of them those with each feature."""

    docs: np.ndarray  # (2,)
    seen: np.ndarray  # (2, features)

    def plus(self, other: Counts, weight: np.ndarray) -> Counts:
        return Counts(self.docs + weight * other.docs, self.seen + weight[:, None] * other.seen)

    def evidence(self, at: np.ndarray, own: np.ndarray | None, smooth: float) -> np.ndarray:
        """Evidence of features `at`; with `own`, the class of the document that each is of, without that document."""
        out = []
        for side in (0, 1):
            mine = 0.0 if own is None else (own == side).astype(np.float64)
            docs = np.maximum(self.docs[side] - mine, 1e-9)
            total = np.maximum(self.docs.sum() - (0.0 if own is None else 1.0), 1e-9)
            out.append(np.log((np.maximum(self.seen[side][at] - mine, 0.0) + smooth * docs / total) / docs))
        return out[1] - out[0]


def _columns(batch):
    grams = batch.column("grams")
    sizes = np.diff(np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1])
    n = batch.num_rows
    flat = lambda c, k: batch.column(c).flatten().to_numpy().reshape(n, k)
    return grams.flatten().to_numpy(), sizes, flat("shape", SHAPE), flat("page", ACTIVE)


def text_inputs(grams, sizes, shape, counts: Counts, own, smooth: float) -> np.ndarray:
    """What the text view's regression sees: mean evidence of words and of pairs, evidence of each figure's bin."""
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    e = counts.evidence(grams, None if own is None else own[doc], smooth)
    out = np.ones((n, 3 + SHAPE))
    for k, side in enumerate((grams < GRAMS, grams >= GRAMS)):
        out[:, k] = np.bincount(doc[side], weights=e[side], minlength=n) / np.maximum(np.bincount(doc[side], minlength=n), 1)
    out[:, 2:-1] = counts.evidence(shape, None if own is None else own[:, None], smooth)
    return out


def page_inputs(page, counts: Counts, own, smooth: float) -> np.ndarray:
    out = np.ones((len(page), ACTIVE + 1))
    out[:, :-1] = counts.evidence(page, None if own is None else own[:, None], smooth)
    return out


@dataclass
class Views:
    """Both classifiers: counts and weights of each."""

    text: Counts
    page: Counts
    smooth: float
    text_w: np.ndarray | None = None
    page_w: np.ndarray | None = None

    def inputs(self, batch, own=None) -> tuple[np.ndarray, np.ndarray]:
        grams, sizes, shape, page = _columns(batch)
        return text_inputs(grams, sizes, shape, self.text, own, self.smooth), page_inputs(page, self.page, own, self.smooth)

    def logits(self, batch) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.inputs(batch)
        return a @ self.text_w, b @ self.page_w


def tally(table: DataFrame, pick: Callable) -> tuple[Counts, Counts]:
    """Counts of both views over all rows of the table; pick(batch) gives each row's class to the text and to the page view, -1 for none.

    Tasks add up their own rows, Spark adds up the tasks; the driver sees one row per feature and class.
    """
    def run(batches):
        import pyarrow as pa

        text, page = np.zeros((2, TEXT + 1), dtype=np.int64), np.zeros((2, PAGE + 1), dtype=np.int64)  # the last is for the documents
        for batch in batches:
            grams, sizes, shape, active = _columns(batch)
            of_text, of_page = pick(batch)
            doc_side = np.repeat(of_text, sizes)
            for side in (0, 1):
                mine = of_text == side
                text[side] += np.bincount(np.concatenate((grams[doc_side == side], shape[mine].reshape(-1))), minlength=TEXT + 1)
                page[side] += np.bincount(active[of_page == side].reshape(-1), minlength=PAGE + 1)
                text[side, -1] += mine.sum()
                page[side, -1] += (of_page == side).sum()
        flat = np.concatenate((text.reshape(-1), page.reshape(-1)))
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.int64())], ["at", "n"])

    rows = table.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(2 * (TEXT + PAGE + 2))
    flat[rows["at"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    cut = 2 * (TEXT + 1)
    return tuple(Counts(x[:, -1], x[:, :-1]) for x in (flat[:cut].reshape(2, -1), flat[cut:].reshape(2, -1)))


# ---------------------------------------------------------------- fits


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = _sigmoid(x @ w)
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (weight * (q - y)) + ridge * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-5:
            break
    return w


def sample_inputs(sample: DataFrame, v: Views) -> tuple[np.ndarray, ...]:
    """Both views' inputs of the labelled sample, in its order: of a fitted document without its own counts. Then class and fitted."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fitted, y = batch.column("fitted").to_numpy(zero_copy_only=False), batch.column("quality").to_numpy()
            a, b = v.inputs(batch, np.where(fitted, y, -1))
            c, d = v.inputs(batch)
            both = np.concatenate((np.where(fitted[:, None], a, c), np.where(fitted[:, None], b, d)), axis=1)
            width = pa.array(np.arange(len(both) + 1) * both.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("turn"), pa.ListArray.from_arrays(width, pa.array(both.reshape(-1))), batch.column("quality"), batch.column("fitted")], ["turn", "x", "quality", "fitted"])

    got = sample.mapInArrow(run, "turn int, x array<double>, quality int, fitted boolean").toPandas().sort_values("turn")  # sample_docs rows of fixed width
    x = np.stack(got["x"].to_list())
    return x[:, : 3 + SHAPE], x[:, 3 + SHAPE :], got["quality"].to_numpy(dtype=np.float64), got["fitted"].to_numpy(dtype=bool)


def _thresholds(table: DataFrame, v: Views, low: float, high: float) -> list[tuple[float, float]]:
    """For each view the logits below and above which the given shares of all documents lie, from counts of all in narrow bins."""
    def run(batches):
        import pyarrow as pa

        out = np.zeros((2, 6001), dtype=np.int64)
        for batch in batches:
            for k, z in enumerate(v.logits(batch)):
                out[k] += np.bincount(np.rint(np.clip(z, -30, 30) * 100).astype(np.int64) + 3000, minlength=6001)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out.reshape(-1)[at])], ["at", "n"])

    rows = table.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    bins = np.zeros(2 * 6001, dtype=np.int64)
    bins[rows["at"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return [cuts(n, low, high) for n in bins.reshape(2, -1)]


def cuts(bins: np.ndarray, low: float, high: float) -> tuple[float, float]:
    """Upper edge of the lowest bins that hold the share `low`, lower edge of the highest with the share `high`; never beyond 0."""
    n = np.cumsum(bins)
    at = (np.arange(6001) - 3000) / 100
    return min(float(at[np.searchsorted(n, low * n[-1])]), 0.0), max(float(at[np.searchsorted(n, (1 - high) * n[-1])]), 0.0)


def sides(z: np.ndarray, cut: tuple[float, float]) -> np.ndarray:
    """Class that a view is confident of, -1 for none."""
    z = np.rint(np.clip(z, -30, 30) * 100) / 100
    return np.where(z >= cut[1], 1, np.where(z <= cut[0], 0, -1))


def trust(given: np.ndarray, y: np.ndarray, good: float) -> np.ndarray:
    """For each class how far a view is right about labelled documents that it is confident of: 0 as chance, 1 always."""
    out = np.zeros(2)
    for side, base in ((0, 1 - good), (1, good)):
        mine = y[given == side]
        if len(mine) and base < 1:
            right = ((mine == side).sum() + base) / (len(mine) + 1)
            out[side] = max(0.0, (right - base) / (1 - base))
    return out


def score(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of docs: doc_id, text_score, meta_score, score, kept; scores from 0 to 1, higher is better.

    `labels` has (doc_id, quality 0/1). Null text counts as empty, null metadata as one more value. A null
    doc_id has no label. Without labels of both kinds every score is 0.5 and every row is kept. With fewer
    than 60 labelled documents, or one class only on either side, the calibration sees those of the fit.
    Repeated rows are scored alike. An empty table gives an empty result; other columns are ignored.
    """
    table = saved(views(docs), "cotrain-views")
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    order = F.xxhash64("doc_id", F.lit("cotrain"))
    known = table.select("doc_id").join(marks, F.col("doc_id") == F.col("_doc")).select("doc_id", "quality").dropDuplicates(["doc_id"])
    # Numbers and labels of the sample are small; the features follow by a join on at most sample_docs ids.
    chosen = first_by_hash(known, order, p.sample_docs).toPandas()
    y = chosen["quality"].to_numpy(dtype=np.int64)
    if not len(y) or y.min() == y.max():
        none = F.lit(0.5)
        return table.select("doc_id", none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("kept"))
    held = np.arange(len(y)) < p.calibration * len(y)
    alone = len(y) < 60 or y[held].min() == y[held].max() or y[~held].min() == y[~held].max()
    spark = docs.sparkSession
    picked = [(int(d), int(q), i, bool(alone or not h)) for i, (d, q, h) in enumerate(zip(chosen["doc_id"], y, held, strict=True))]
    picked = spark.createDataFrame(picked, "_doc long, quality int, turn int, fitted boolean")
    # Of several texts of a doc_id that with the least features stands for it.
    sample = table.join(F.broadcast(picked), F.col("doc_id") == F.col("_doc")).groupBy("turn", "quality", "fitted").agg(F.min(F.struct("grams", "shape", "page")).alias("f")).select("turn", "quality", "fitted", "f.*")
    sample = saved(sample, "cotrain-sample")

    def of_labels(batch):
        side = np.where(batch.column("fitted").to_numpy(zero_copy_only=False), batch.column("quality").to_numpy(), -1)
        return side, side

    text, page = tally(sample, of_labels)

    def fitted(of_text: Counts, of_page: Counts):
        v = Views(of_text, of_page, p.smooth)
        a, b, t, seen = sample_inputs(sample, v)
        one = np.ones(seen.sum())
        v.text_w, v.page_w = logistic(a[seen], t[seen], one, p.ridge), logistic(b[seen], t[seen], one, p.ridge)
        rest = np.ones(len(t), dtype=bool) if alone else ~seen
        return v, a[rest] @ v.text_w, b[rest] @ v.page_w, t[rest]

    good = float(page.docs[1] / page.docs.sum())
    v, a, b, t = fitted(text, page)
    for _ in range(p.rounds):
        of_text, of_page = _thresholds(table, v, p.share * (1 - good), p.share * good)

        def exchanged(batch, v=v, of_text=of_text, of_page=of_page):
            za, zb = v.logits(batch)
            return sides(zb, of_page), sides(za, of_text)

        to_text, to_page = tally(table, exchanged)
        v, a, b, t = fitted(text.plus(to_text, p.pseudo_weight * trust(sides(b, of_page), t, good)), page.plus(to_page, p.pseudo_weight * trust(sides(a, of_text), t, good)))
    # Calibrated views: slope and offset for each; then both calibrated logits together.
    one = np.ones(len(t))
    curve_a, curve_b = (logistic(np.stack([one, z], axis=1), t, one, 0.1) for z in (a, b))
    both = logistic(np.stack([one, curve_a[0] + curve_a[1] * a, curve_b[0] + curve_b[1] * b], axis=1), t, one, 0.1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            za, zb = v.logits(batch)
            za, zb = curve_a[0] + curve_a[1] * za, curve_b[0] + curve_b[1] * zb
            total = _sigmoid(both[0] + both[1] * za + both[2] * zb)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_sigmoid(za)), pa.array(_sigmoid(zb)), pa.array(total), pa.array(total >= 0.5)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return table.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")
