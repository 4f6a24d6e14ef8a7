"""Collocations against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from feedlens.llm import collocations as C
from odd import ODD


def brute(rows, p):
    """(lang, rank, phrase, a, l, r, n, score) from lists of words."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, p.most + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in f.items():
        known = {w: a for w, a in found.items() if len(w) > 1 and a >= p.least}
        gone = {w[i : i + m] for w, a in known.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * a >= p.cover * found[w[i : i + m]]}
        rows = []
        for w, a in known.items():
            if w not in gone:
                score, k = min((2000000 * a // (found[w[:k]] + found[w[k:]]), k) for k in range(1, len(w)))
                rows.append((-score, -a, " ".join(w).encode(), found[w[:k]], found[w[k:]]))
        out += [(lang, i + 1, phrase.decode(), -a, l, r, n[lang], -score) for i, (score, a, phrase, l, r) in enumerate(sorted(rows)[: p.top])]
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, phrase string, n long")


def got(docs, p):
    return sorted(tuple(r) for r in C.mine(docs, p).collect())


def test_odd_rows(table, odd):
    p = C.Params(least=3)
    rows = [("en", t) for _, t in ODD]
    assert got(table(rows), p) == brute(rows, p) and got(odd, p) == brute(rows, p)
    assert got(table([]), p) == [] and got(table([(None, None), ("", "")]), p) == []
    rows = [(None, "a b"), ("und", "A b"), ("", "a  b\tc"), ("", "a b c. a b c"), ("x\ty", "a b; a b; a b")]
    assert got(table(rows), C.Params(least=2)) == brute(rows, C.Params(least=2))


@pytest.mark.parametrize("p", [C.Params(least=4), C.Params(least=2, most=3, cover=50, top=5), C.Params(least=3, most=2), C.Params(least=2, most=5, cover=100)])
def test_random_texts(table, p):
    rng = np.random.default_rng(p.least + p.most)
    words = ["a", "b", "c", "dé", "E", "f-g", "\x00h", "漢", "über"]
    rows = []
    for i in range(120):
        parts = [str(rng.choice(words, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) + str(rng.choice([" ", " ", " ", "  ", "\t", ". ", "\r\n", "!", "\x0b"])) for _ in range(rng.integers(0, 40))]
        rows.append(([None, "en", "de"][i % 3], "".join(parts)))
    rows += rows[5:9] * 3
    assert got(table(rows), p) == brute(rows, p)


def test_long_piece_is_cut_without_loss():
    rng = np.random.default_rng(2)
    words = [str(w) for w in rng.choice(["aa", "b", "ccc", "dé"], 5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([" ".join(words), "b aa"]), pa.array([3, 2])], ["lang", "piece", "n"])
    whole, cut = Counter(), Counter()
    for size, counts in ((1 << 20, whole), (100, cut)):
        for table in C.tiles_of([batch], 4, size):
            tile = C.Tile(table)
            for found in (tile.rows(tile.at, tile.sums, 1), *(tile.rows(at, sums, k) for k, at, sums in tile.wide(4, np.ones(len(tile.word), dtype=bool)))):
                for r in found.to_pylist():
                    counts[r["phrase"]] += r["n"]
    assert +cut == +whole and whole["b aa"] == 3 * sum(words[i : i + 2] == ["b", "aa"] for i in range(4999)) + 2


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**16 + 1
    found = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, 3 * big)], "lang string, phrase string, width int, n long")
    assert [tuple(r) for r in C.scored(found).collect()] == [("en", "a b", big, big + 1, 3 * big, 2000000 * big // (4 * big + 1))]


def test_top_of_many(spark):
    rows = spark.range(5000).selectExpr("'en' as lang", "concat('p ', id) as phrase", "1L as a", "1L as l", "1L as r", "id % 7 as score")
    out = [(r.rank, r.phrase) for r in C.top(rows, C.Params(top=900)).orderBy("rank").collect()]
    want = sorted(((-(i % 7), f"p {i}") for i in range(5000)))[:900]
    assert out == [(i + 1, phrase) for i, (_, phrase) in enumerate(want)]
