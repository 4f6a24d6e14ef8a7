"""Toxicity and quality: the field against enumeration, held-out accuracy, odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import cotrain, crf
from odd import ODD


def _auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n = int(y.sum())
    return (rank[y].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_marginals_equal_enumeration():
    p = crf.Params(bits=10)
    data = b"aa bb cc dd ee. ff gg\nhh"
    t = crf.tokenize(np.frombuffer(data, np.uint8), np.array([0, 15, 15, len(data)]), p)
    assert [data[a:b] for a, b in zip(t.start, t.end, strict=True)] == data.replace(b".", b"").split()
    rng = np.random.default_rng(0)
    m = crf.Model(rng.normal(size=1 << 10), 0.3, -0.7, 1.1, 0.2, np.zeros(0))
    q = crf.marginals(t, m)[0]
    e = crf.emissions(t, m)
    step = {(0, 0): 0.0, (0, 1): m.into, (1, 0): m.leave, (1, 1): m.stay}
    for c in np.unique(t.chain):
        at = np.flatnonzero(t.chain == c)
        total, hit = 0.0, np.zeros(len(at))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(e[i] * v for i, v in zip(at, y, strict=True)) + sum(step[x] for x in itertools.pairwise(y)))
            total += w
            hit += w * np.array(y)
        assert np.allclose(hit / total, q[at])


def test_long_chains_give_the_same_marginals(monkeypatch):
    p = crf.Params(bits=10)
    data = b" ".join(b"w%d" % (i * i % 37) for i in range(300)) + b". a b c"
    t = crf.tokenize(np.frombuffer(data, np.uint8), np.array([0, len(data)]), p)
    assert np.bincount(t.chain).tolist() == [300, 3]
    m = crf.Model(np.random.default_rng(0).normal(size=1 << 10), 0.3, -0.7, 1.1, 0.2, np.zeros(0))
    one = crf.marginals(t, m)
    monkeypatch.setattr(crf, "SIDE", 1000)
    assert all(np.allclose(a, b) for a, b in zip(one, crf.marginals(t, m), strict=True))


def test_parts_of_a_long_text():
    data = np.frombuffer(b"one two. three " * 400_000 + b"x" * 5_000_000, np.uint8)
    found = list(crf.parts(data, np.array([0, len(data)])))
    assert found[0][0] == 0 and found[-1][1] == len(data) and all(a[1] == b[0] for a, b in itertools.pairwise(found))
    assert all(data[a[1] - 1] == ord(".") for a in found[:2])


def test_a_very_long_labelled_text_does_not_empty_the_sample(spark, corpus):
    docs, labels = corpus
    big = "wort1 wort2 wort3. " * 1_300_000  # 24 MB
    ids = [r.doc_id for r in docs.where("crc32(cast(doc_id as string)) % 5 <> 0").orderBy(F.xxhash64(F.col("doc_id"), F.lit("crf"))).limit(2).collect()]
    for odd in ids:
        swapped = docs.withColumn("text", F.when(F.col("doc_id") == odd, F.lit(big)).otherwise(F.col("text")))
        got = [r for r in crf.score(swapped, labels.select("doc_id", "toxic")).select("doc_id", "score", "held_out").collect() if r.held_out]
        assert _auc(np.array([r.score for r in got]), np.array([r.doc_id % 5 == 0 for r in got])) > 0.99
    with pytest.raises(ValueError, match="no model"):
        crf.clean(docs, labels.select("doc_id", "toxic"), crf.Params(sample_bytes=10))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    words = [f"wort{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = list(rng.choice(words, rng.integers(20, 60)))
        bad = i % 5 == 0
        if bad:
            for k in rng.integers(0, len(text), 4):
                text[k] = str(rng.choice(["Grobian", "schuftig", "schuftiger,", "Üble"]))
        junk = i % 7 == 0
        rows.append((i, " ".join(x + ("$$$" if junk else "") for x in text) + " é.", "de", f"s{i % 4}", 100))
        labels.append((i, 0 if junk else 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, corpus):
    docs, labels = corpus
    got = crf.score(docs, labels.select("doc_id", "toxic")).collect()
    assert len(got) == 900 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    y = np.array([r.doc_id % 5 == 0 for r in held])
    assert 100 < len(held) < 260 and _auc(np.array([r.score for r in held]), y) > 0.99
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {texts[r.doc_id][s.start : s.end] for r in got for s in r.spans}
    assert {"Grobian", "schuftig", "Üble"} <= {w for x in found for w in x.replace("$", "").replace(",", "").split()}
    assert {r.doc_id for r in crf.clean(docs, labels.select("doc_id", "toxic")).collect()} == {r.doc_id for r in got if not r.predicted}


def test_one_toxic_row_of_many(spark):
    """Whichever row it is: the sample has it, and the fit does not fail; its own words are found again."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("plain words"), F.hex(F.col("id") % 97), F.hex(F.col("id") % 89)).alias("text"))
    outside = rows.where("crc32(cast(doc_id as string)) % 5 <> 0").select("doc_id")
    ids = [r.doc_id for r in outside.orderBy(F.xxhash64("doc_id", F.lit("crf"))).collect()]
    for one in (ids[0], ids[7_000], ids[12_000], ids[-1]):
        docs = rows.withColumn("text", F.when(F.col("doc_id") == one, F.lit("Grobian schuftig " * 5)).otherwise(F.col("text")))
        texts, toxic = crf.training_rows(docs, rows.select("doc_id", (F.col("doc_id") == one).cast("int").alias("toxic")), crf.Params())
        assert toxic.sum() == 1 and 6000 <= len(texts) <= 6060
        assert crf.clean(docs, rows.select("doc_id", (F.col("doc_id") == one).cast("int").alias("toxic"))).where("text like 'plain%'").count() == 19_999


def test_toxicity_odd_rows(documents, odd, corpus):
    labels = corpus[1].select("doc_id", "toxic")
    got = crf.score(odd, labels).collect()
    assert len(got) == len(ODD) and {r.held_out for r in got if r.doc_id is None} == {False}
    assert crf.score(documents([]), labels).count() == 0 and crf.score(odd, labels.limit(0)).where("score <> 0").count() == 0
    assert crf.clean(odd, labels.limit(0)).count() == len(ODD) and crf.clean(odd, labels).columns == odd.columns


def test_training_sample_is_bounded_and_skips_held_out(corpus):
    import zlib

    docs, labels = corpus
    texts, y = crf.training_rows(docs, labels, crf.Params(sample_docs=50))
    assert len(texts) == 50 == len(y)
    by = {r.text.encode(): r.doc_id for r in docs.collect()}
    assert all(zlib.crc32(str(by[t]).encode()) % 5 for t in texts)
    assert sum(map(len, crf.training_rows(docs, labels, crf.Params(sample_bytes=5000))[0])) <= 5000


def test_quality_held_out(corpus):
    docs, labels = corpus
    seen = labels.where("doc_id % 3 <> 0").select("doc_id", "quality")
    got = [r for r in cotrain.score(docs, seen).collect() if r.doc_id % 3 == 0]
    assert _auc(np.array([r.score for r in got]), np.array([r.doc_id % 7 != 0 for r in got])) > 0.99
    assert sum(r.kept == (r.doc_id % 7 != 0) for r in got) / len(got) > 0.97
    assert all(0 <= x <= 1 for r in got for x in (r.text_score, r.meta_score, r.score))


def test_text_view_of_a_batch_equals_each_text_alone():
    texts = [b"", b"One two  one", b"x", b"a b " * 900_000, "\u00e9 $$$\n".encode() * 5]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    grams, sizes, shape = cotrain.text_view(data, ends)
    assert sizes.tolist() == [0, 4, 1, 4, 4] and len(grams) == sizes.sum()
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i, t in enumerate(texts):
        g, n, f = cotrain.text_view(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert g.tolist() == grams[at[i] : at[i + 1]].tolist() and f.tolist() == shape[i : i + 1].tolist()
    dollars = next(k for k, c in enumerate(range(cotrain._CLASSES)) if c == cotrain._CLASS[ord("$")])
    assert shape[4, dollars] == 2 * cotrain.GRAMS + dollars * cotrain.BINS + int((3 / 7) ** 0.5 * cotrain.BINS)


def _brute_cotraining(rows, labels, order, p):
    """The same classifiers by plain loops over dictionaries; only the features and the regression are shared."""
    from collections import Counter
    from math import exp, log

    feats = {}
    for r in rows:
        raw = (r.text or "").encode()
        g, _, f = cotrain.text_view(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        feats[r.doc_id] = (g.tolist(), f[0].tolist(), cotrain.page_view([r.lang], [r.source], [r.n_chars])[0].tolist())
    known = [d for d in order if d in labels][: p.sample_docs]
    held, seen = known[: int(np.ceil(p.calibration * len(known)))], known[int(np.ceil(p.calibration * len(known))) :]

    class Table:
        def __init__(self):
            self.docs, self.seen = [0.0, 0.0], [Counter(), Counter()]

        def add(self, features, side, w=1.0):
            self.docs[side] += w
            for x in features:
                self.seen[side][x] += w

        def evidence(self, x, own=-1):
            n = [self.docs[s] - (own == s) for s in (0, 1)]
            share = [(max(self.seen[s][x] - (own == s), 0) + p.smooth * n[s] / sum(n)) / n[s] for s in (0, 1)]
            return log(share[1]) - log(share[0])

    def inputs(d, text, page, own=-1):
        g, f, m = feats[d]
        a = []
        for part in ([x for x in g if x < cotrain.GRAMS], [x for x in g if x >= cotrain.GRAMS]):
            a.append(sum(text.evidence(x, own) for x in part) / max(len(part), 1))
        return np.array([*a, *(text.evidence(x, own) for x in f), 1.0]), np.array([*(page.evidence(x, own) for x in m), 1.0])

    def fit(given):
        text, page = Table(), Table()
        for d in seen:
            text.add(feats[d][0] + feats[d][1], labels[d])
            page.add(feats[d][2], labels[d])
        for view, d, side, w in given:
            (text if view == 0 else page).add(feats[d][0] + feats[d][1] if view == 0 else feats[d][2], side, w)
        x = [inputs(d, text, page, labels[d]) for d in seen]
        t = np.array([labels[d] for d in seen], dtype=float)
        w = [cotrain.logistic(np.array([r[k] for r in x]), t, np.ones(len(t)), p.ridge) for k in (0, 1)]
        return {d: [float(v @ w[k]) for k, v in enumerate(inputs(d, text, page))] for d in feats}

    good = sum(labels[d] for d in seen) / len(seen)
    z = fit([])
    for _ in range(p.rounds):
        given = []
        for giver in (0, 1):
            short = {d: round(min(max(v[giver], -30), 30), 2) for d, v in z.items()}
            ranked = sorted(short.values())
            n = len(ranked)
            low = min(next(v for i, v in enumerate(ranked) if i + 1 >= p.share * (1 - good) * n), 0)
            high = max(next(v for i, v in enumerate(ranked) if i + 1 >= (1 - p.share * good) * n), 0)
            for side, base, mine in ((0, 1 - good, {d for d, v in short.items() if v <= low and v < high}), (1, good, {d for d, v in short.items() if v >= high})):
                tested = [labels[d] for d in held if d in mine]
                right = (sum(y == side for y in tested) + base) / (len(tested) + 1)
                trust = max(0.0, (right - base) / (1 - base)) if tested else 0.0
                given += [(1 - giver, d, side, p.pseudo_weight * trust) for d in mine]
        z = fit(given)
    t, one = np.array([labels[d] for d in held], dtype=float), np.ones(len(held))
    curves = [cotrain.logistic(np.stack([one, [z[d][k] for d in held]], axis=1), t, one, 0.1) for k in (0, 1)]
    cal = {d: [c[0] + c[1] * v for c, v in zip(curves, zs, strict=True)] for d, zs in z.items()}
    both = cotrain.logistic(np.array([[1, *cal[d]] for d in held]), t, one, 0.1)
    sig = lambda x: 1 / (1 + exp(-x))
    return {d: (sig(a), sig(b), sig(both[0] + both[1] * a + both[2] * b)) for d, (a, b) in cal.items()}


def test_cotraining_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], {}
    for i in range(240):
        y = int(rng.random() < 0.7)
        text = [f"w{(k + 5 * y * (rng.random() < 0.6)) % 23}" for k in rng.integers(0, 18, 12)]
        rows.append((i, " ".join(text) if i % 40 else None, "de" if i % 3 else None, f"s{int(rng.integers(0, 3)) + 2 * y}", int(rng.integers(1, 99))))
        if i % 2:
            labels[i] = y
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id", F.lit("cotrain"))).collect()]
    p = cotrain.Params(sample_docs=100, rounds=2, share=0.3)
    want = _brute_cotraining(docs.collect(), labels, order, p)
    got = cotrain.score(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), p).collect()
    assert len(got) == 240
    for r in got:
        assert np.allclose((r.text_score, r.meta_score, r.score), want[r.doc_id], atol=1e-6), (r, want[r.doc_id])


def test_exchange_teaches_words_that_no_label_covers(spark):
    """Words c and d occur in unlabelled documents only; the page view knows those documents' sources, the text view learns the words."""
    rng = np.random.default_rng(6)
    words = lambda k, n: " ".join(f"{k}{x}" for x in rng.integers(0, 30, n))
    rows, labels = [], []
    for i in range(1500):
        good = i % 2
        known = i < 300
        rows.append((i, words(("ab" if known else "dc")[good], 12), "de", ("h" if good else "g") if i < 1300 else "unseen", 40))
        if known:
            labels.append((i, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = spark.createDataFrame(labels, "doc_id long, quality int")
    auc = {}
    for rounds in (0, 2):
        got = [r for r in cotrain.score(docs, seen, cotrain.Params(rounds=rounds)).collect() if r.doc_id >= 1300]
        auc[rounds] = _auc(np.array([r.text_score for r in got]), np.array([r.doc_id % 2 == 1 for r in got]))
    assert auc[2] > 0.95 and auc[2] > auc[0] + 0.2, auc


def test_quality_odd_rows(documents, odd, corpus):
    labels = corpus[1].select("doc_id", "quality")
    assert cotrain.score(odd, labels).count() == len(ODD)
    assert cotrain.score(documents([]), labels).count() == 0
    assert {(r.score, r.kept) for r in cotrain.score(odd, labels.limit(0)).collect()} == {(0.5, True)}
