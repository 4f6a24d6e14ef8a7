"""Repeated windows against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from feedlens.llm import suffixes as S
from odd import ODD


def brute(rows, t):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by marking the bytes of every repeated window."""
    texts = [(i, (x or "").encode()) for i, x in rows]
    seen = Counter(b[s : s + t] for _, b in texts for s in range(len(b) - t + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - t + 1):
            if seen[b[s : s + t]] > 1:
                gone[s : s + t] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), len(b) - len(kept), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs, p=S.Params()):
    return sorted((tuple(r) for r in S.removed(docs, p).drop("spans", "kept").collect()), key=str)


def test_odd_rows(spark, documents, odd):
    assert got(odd) == brute(ODD, 200)
    assert got(documents([])) == []
    near = [(1, "x" * 199), (2, "y" * 200), (3, "z" * 201), (4, "é" * 100 + "q"), (5, "é" * 100 + "w"), (6, "w" + "é" * 99 + "w"), (6, None), (6, "")]
    assert got(documents(near)) == brute(near, 200)


@pytest.mark.parametrize("p", [S.Params(20, 8, 4), S.Params(12, 4, 12), S.Params(16, 16, 1), S.Params(9, 1, 3), S.Params(33, 16, 16)])
def test_random_texts(documents, p):
    rng = np.random.default_rng(p.threshold)
    pool = ["".join(rng.choice(list("abé"), n)) for n in (3, 7, 15, 40, 90, 200)]
    rows = []
    for i in range(150):
        parts = [pool[k][rng.integers(0, 5) :] if rng.random() < 0.5 else "".join(rng.choice(list("abcdefgh "), rng.integers(1, 60))) for k in rng.integers(0, len(pool), rng.integers(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(500, "ab" * 100), (501, "a" * 300), (502, rows[7][1]), (7, rows[7][1]), (None, rows[8][1])]
    assert got(documents(rows), p) == brute(rows, p.threshold)


def test_overlap_with_itself(documents):
    rows = [(1, "abc" * 100), (2, "0123456789" * 30 + "x")]
    assert got(documents(rows)) == brute(rows, 200)


def test_long_text_in_pieces(documents, monkeypatch):
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdefghijklmnop "), 30_000))
    rows = [(1, long), (2, long[10_000:10_900] + "tail"), (3, long[4_000:4_300]), (4, long[4_050:4_249])]
    monkeypatch.setattr(S.blocks, "__defaults__", (4096,))
    data = np.frombuffer(b"".join(t.encode() for _, t in rows), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for _, t in rows])))
    parts = list(S.blocks(data, offsets, 200))
    assert len(parts) > 7 and sum(max(0, len(raw) - 199) for raw, _, i in parts if i == 0) == 30_000 - 199
    assert got(documents(rows)) == brute(rows, 200)


def test_megabytes_in_one_text(documents):
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefghijklmnop "), 3 << 20))
    rows = [(1, long), (2, long[600_000:600_500]), (3, long[524_100:524_400])]
    out = {r.doc_id: r for r in S.removed(documents(rows)).collect()}
    assert [tuple(x) for x in out[1].spans] == [(524_100, 524_400), (600_000, 600_500)] and out[1].n_removed == 800 and bytes(out[1].kept).decode() == long[:524_100] + long[524_400:600_000] + long[600_500:]
    assert out[2].n_removed == 500 and out[3].n_removed == 300 and bytes(out[3].kept) == b""


def test_what_goes_on_follows_from_the_repeats(documents, monkeypatch):
    """Full bitmaps, as of a large input, let every window through."""
    monkeypatch.setattr(S, "BITS", 3, raising=False)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefghijklmnop "), 3_000)) for _ in range(40)]
    rows = [*enumerate(texts), (90, "start " + texts[0][500:900] + " end"), (91, texts[1])]
    sent = {}
    save = S.saved
    monkeypatch.setattr(S, "saved", lambda df, name: (out := save(df, name), sent.__setitem__(name, out.count()))[0])
    assert got(documents(rows)) == brute(rows, 200)
    assert sent["suffix-windows"] < 200 and sum(sent.values()) < 500, sent


@pytest.mark.parametrize("once", [False, True])
def test_sorted_pieces_in_small_batches(once, monkeypatch):
    """A pass over sorted rows, cut anywhere, against groups."""
    monkeypatch.setattr(S, "_ROWS", 1)
    rng = np.random.default_rng(11)
    for trial in range(60):
        rows = sorted(map(tuple, rng.integers(0, (3 + trial % 4, 1 + trial % 3, 2, 2, 2), (int(rng.integers(1, 60)), 5)).tolist()))
        cut = np.sort(rng.integers(0, len(rows), 1 + trial % 9))
        parts = [p for p in np.split(np.array(rows).T, cut, axis=1) if p.shape[1]]
        found = [tuple(r.values()) for batch in S._settle([S._frame(list(p), S._PIECE) for p in parts], once) for r in batch.to_pylist()]
        pieces = sorted(set(rows)) if once else rows
        count = Counter(r[:2] for r in pieces)
        assert sorted(r[:3] for r in found if not r[3]) == sorted(r[2:] for r in set(pieces) if count[r[:2]] > 1)
        mixed = [h for h in count if sum(k[0] == h[0] for k in count) > 1]
        first = {r[:2]: r[2:] for r in reversed(pieces)}
        assert sorted(r[:3] for r in found if r[3]) == sorted(first[h] for h in mixed)


@pytest.mark.parametrize("once", [False, True])
def test_many_copies_do_not_meet(once):
    """Of many equal pieces few are sent by their key; what is known of them is the same."""
    rng = np.random.default_rng(12)
    rows = [(7, 1, t, 2, 3 << 32) for t in range(5_000)] + [(7, 2, 9, 9, 9), (8, 1, 1, 1, 1), (8, 1, 1, 1, 1)] + rng.integers(0, 30, (2_000, 5)).tolist()
    frames = [S._frame(list(np.array(part, dtype=np.int64).T), S._PIECE) for part in (rows[:3_000], rows[3_000:])]
    sent = np.stack([c for x in S._sent(frames, once) for c in [np.stack([v.to_numpy() for v in x.columns])]]).transpose(1, 0, 2).reshape(5, -1)
    assert (sent[0] == 7).sum() < 200 and max(Counter(sent[0].tolist()).values()) < 300
    settle = lambda r: {tuple(x.values()) for b in S._settle([S._frame(list(r[:, np.lexsort(r[::-1])]), S._PIECE)], once) for x in b.to_pylist()}
    plain = settle(np.array(rows, dtype=np.int64).T)
    assert {x for x in settle(sent) if not x[3]} == {x for x in plain if not x[3]}
    assert sum(x[3] for x in settle(sent)) == sum(x[3] for x in plain)


def test_bundles_hold_every_window_once():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    cuts = np.sort(rng.choice(5000, 20, replace=False))
    _, place, first, last = S.bundles(raw, cuts, S.Params(20, 8, 4))
    starts = np.concatenate([np.arange(a, z + 1) for a, z in zip(first, last, strict=True)])
    whole = [s for s in range(5000 - 19) if not any(s < c < s + 20 for c in cuts)]
    assert starts.tolist() == whole and all(a <= q <= a + 12 and q >= z for q, a, z in zip(place, first, last, strict=True))
