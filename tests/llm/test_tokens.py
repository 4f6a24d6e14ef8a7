"""Token ids, Simple-8b files and packing against the tokenizers library and exact round trips."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedlens.llm import packing, simple8b
from feedlens.llm.shared import scratch
from feedlens.llm.tokens import Encoder, tokenizer
from odd import ODD

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PARTS = ["a", "B", " ", "  ", "\n", "\r", "\t", "'s", "12", "é", "ß", "\xa0", "　", "!", "###", ",", ".", "<|endoftext|>", "\x1c", "́", "漢字", "Σ", "İ", "²", "Word", "ﬁ", "H̱", "_", "Ġ", "\x85", " "]


def plain(name):
    t = Tokenizer.from_file(tokenizer(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_those_of_whole_texts(name):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(15))) for _ in range(3000)] + [t for _, t in ODD]
    coder, want = Encoder(tokenizer(name)), plain(name)
    for a in range(0, len(texts), 700):
        ids, bounds = coder.encode(texts[a : a + 700])
        for k, t in enumerate(texts[a : a + 700]):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == want(t), repr(t)


def test_memo_generations(monkeypatch):
    import feedlens.llm.tokens as T

    monkeypatch.setattr(T, "MEMO_PIECES", 5)
    coder, want = Encoder(tokenizer(FILES[0])), plain(FILES[0])
    for k in range(30):
        text = " ".join(f"w{j}" for j in range(k % 7, k % 7 + 6))
        assert coder.encode([text])[0].tolist() == want(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(ids):
    words, literals = simple8b.encode(np.array(ids, dtype=np.uint64))
    assert simple8b.decode(words, literals).tolist() == ids
    first = simple8b.starts_of(words)
    # Any run decodes on its own.
    for w in range(0, len(words), 7):
        assert simple8b.decode(words[w : w + 7], literals).tolist() == ids[first[w] : first[min(w + 7, len(words))]]
    assert len(literals) == sum(i >= 2**60 for i in ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70_000), st.integers(2**59, 2**64 - 1)), max_size=2000), st.data())
def test_simple8b_spans_of_runs(ids, data):
    words, literals = simple8b.encode(np.array(ids, dtype=np.uint64))
    runs = simple8b.starts_of(words)[:-1 : simple8b.RUN_WORDS]
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert simple8b.span(words, literals, runs, a, b).tolist() == ids[a:b]


def test_simple8b_lookup(spark, documents):
    """Documents found by id, a repeated and an empty one among them, are those that a read of all gives."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"word{rng.randrange(999)}" for _ in range(rng.randrange(1, 400)))) for i in range(600)] + [(77, "a second text"), (900, None), (901, ""), (None, "no id")]
    path = scratch(spark, "test-lookup")
    simple8b.write(documents(rows), tokenizer(FILES[1]), path)
    wanted = spark.createDataFrame([(0,), (77,), (599,), (900,), (901,), (77,), (12345,), (None,)], "doc_id long")
    got = sorted(map(tuple, simple8b.lookup(spark, path, wanted).collect()))
    want = sorted(tuple(r) for r in simple8b.read(spark, path).collect() if r.doc_id in (0, 77, 599, 900, 901))
    assert got == want and len(got) == 6
    assert simple8b.read(spark, path).select("block").distinct().count() > 1
    assert simple8b.lookup(spark, path, wanted.limit(0)).count() == 0


def test_simple8b_files(spark, documents, odd):
    path, want = scratch(spark, "t"), plain(FILES[1])
    simple8b.write(odd, tokenizer(FILES[1]), path)
    got = simple8b.digests(spark, path).orderBy("start").collect()
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    start = 0
    for r, (_, t) in zip(got, rows, strict=True):
        ids = want(t) + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = scratch(spark, "t")
    simple8b.write(documents([]), tokenizer(FILES[1]), empty)
    assert simple8b.digests(spark, empty).count() == 0


def check_packing(rows, docs, window):
    want = plain(FILES[0])
    ids = sorted(tuple(want(t) + [1]) for _, t in docs)
    cover, places = {}, {}
    for r in rows:
        cover.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u2").tolist()))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 2 * r.length and 1 <= r.length <= window
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= window
    return ids, cover, len(places)


def test_packing(documents, odd):
    rows = packing.pack(odd, tokenizer(FILES[0]), window=64).collect()
    ids, cover, _ = check_packing(rows, ODD, 64)
    assert sum(r.length for r in rows) == sum(map(len, ids))
    assert all(sum(len(x) for _, x in pieces) % total == 0 for (_, total), pieces in cover.items())
    d = {r.start: r for r in packing.pack(odd, tokenizer(FILES[0]), window=64, with_ids=False).where("doc_id = 6").collect()}
    whole = plain(FILES[0])("é" * 3000) + [1]
    assert all(r.ids_crc32 == zlib.crc32(np.array(whole[s : s + r.length], "<u4").tobytes()) for s, r in d.items())
    assert packing.pack(documents([]), tokenizer(FILES[0])).count() == 0


def test_packing_fills_windows(documents):
    rng = random.Random(1)
    docs = [(i, "word " * rng.randrange(1, 900)) for i in range(1500)]
    rows = packing.pack(documents(docs), tokenizer(FILES[0])).select("sequence_id", "length", "doc_id", "offset", "start", "doc_tokens", "ids").collect()
    _, _, n = check_packing(rows, docs, 2048)
    assert sum(r.length for r in rows) / (2048 * n) > 0.96


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=80))
def test_levels_take_the_least_sum_of_squares(sizes):
    window, levels, fill = 12, packing.Levels(12), {}
    for s in sizes:
        n = [sum(f == h for f in fill.values()) for h in range(window)]
        cost = {}
        for h in range(window - s + 1):
            if h == 0 or n[h]:
                m = list(n)
                if h:
                    m[h] -= 1
                if h + s < window:
                    m[h + s] += 1
                cost[h] = sum(x * x for x in m)
        at, offset = levels.place(s)
        assert cost[offset] == min(cost.values()) and offset == max(h for h in cost if cost[h] == cost[offset])
        assert fill.get(at, 0) == offset
        fill[at] = offset + s
        if fill[at] == window:
            fill[at] = window
