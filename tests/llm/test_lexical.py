"""Ranked search against brute force."""

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from feedlens.llm import lexical as X
from feedlens.llm.shared import scratch
from odd import ODD


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(rows, items, k=50):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def search(spark):
    def run(docs, items, p=X.Params()):
        path = scratch(spark, f"test-{uuid.uuid4().hex}")
        X.write(docs, path)
        table = spark.createDataFrame([(i, t, "x", 5) for i, t in items], "item_id long, text string, number string, score long")
        return sorted((tuple(r) for r in X.search(spark, path, table, p).collect()), key=str)

    return run


def test_odd_rows(search, documents, odd):
    items = [(1, "one two"), (2, None), (3, ""), (4, "A b c!"), (5, "漢字 ς ² endoftext"), (6, "nowhere"), (None, "one"), (1, "é" * 3000)]
    assert search(odd, items) == brute(ODD, items)
    assert search(documents([]), items) == [] and search(odd, []) == []
    assert search(documents([(1, None), (2, " .")]), items) == []


@pytest.mark.parametrize("p", [X.Params(k=3, step=1, shard=7), X.Params(k=10, step=2, shard=40, block=30, salts=2), X.Params(k=200)])
def test_random_texts(search, documents, p):
    rng = np.random.default_rng(p.k)
    words = np.array([f"w{i}" for i in range(40)] + ["Ünï", "X9"])
    weights = 1 / np.arange(1, 43)
    pick = lambda n: " ".join(rng.choice(words, n, p=weights / weights.sum()))
    rows = [(i, pick(int(rng.integers(0, 30)))) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(3, rows[3][1]), (None, rows[3][1]), (7, "w1-w1_w2")]
    items = [(i, pick(int(rng.integers(1, 9)))) for i in range(12)] + [(50, rows[3][1])]
    assert search(documents(rows), items, p) == brute(rows, items, p.k)


def test_search_stops_early_and_keeps_ties():
    n = 4000
    tf = np.ones(n, dtype=np.int64)
    tf[[5, 900, 901, 3999]] = [9, 7, 7, 7]
    table = pa.table({"doc_id": pa.array(range(n)), "n": pa.array([10] * n), "terms": pa.array([["a", "b"]] * n), "tfs": pa.array([[int(t), int(t)] for t in tf])})
    shard = X.Shard(table, pa.array(["a", "b", "c"]), np.array([700, 300, 9]), n, 10 * n)
    docs, scores, read = shard.search(np.array([0, 1]), 2, 4)
    assert sorted(docs.tolist()) == [5, 900, 901, 3999] and len(set(scores.tolist())) == 2 and read == 24  # the threshold first equals the second score, then falls below
    assert shard.search(np.array([0, 1]), 2, 4, floor=int(scores.max()))[0].tolist() == [5]
    docs, _, read = shard.search(np.array([0, 1]), 5, 4)
    assert len(docs) == n and read == 2 * n  # all the others are equal


def test_long_text_in_pieces():
    rng = np.random.default_rng(3)
    raw = " ".join(rng.choice(["abc", "dé", "0", "x--y"], 5000)).encode()
    found = X.TERM.findall(raw)
    assert X._tf(raw, 64) == (len(found), Counter(found)) and X._tf(b"", 64) == (0, Counter())


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**8])
    assert X.lengths(n, 10**11, 10**13).tolist() == [50 + 50 * 10**11 // 10**13, 50 + 50 * 10**19 // 10**13]
