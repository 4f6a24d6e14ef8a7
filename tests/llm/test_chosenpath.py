"""The near-duplicate join against brute force on full sets."""

import random
import re

import pytest

from feedlens.llm import chosenpath
from feedlens.llm.graph import components
from odd import ODD

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}, {i: len(s) for i, s in sets}


def cloud(seed=3):
    """Chains of near copies, exact copies, shared passages, and documents on both sides of the threshold."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows, now = [], list(base)
    for _ in range(60):  # a chain: each differs from the last by a little, from the first by a lot
        now[rng.randrange(len(now))] = word()
        rows.append(list(now))
    rows += [base[:k] + [word() for _ in range(120 - k)] for k in range(60, 120)]  # a cloud
    rows += [list(base)] * 15
    rows += [passage + [word() for _ in range(rng.randrange(5, 80))] for _ in range(60)]
    rows += [[word() for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    rng.shuffle(rows)
    return [(i * 7 % 1009, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("p", [chosenpath.Params(), chosenpath.Params(leaf=8, group=4, depth=3), chosenpath.Params(leaf=4, group=2, depth=1), chosenpath.Params(shingles=600)], ids=["production", "deep", "pivots", "heavy"])
def test_components_equal_brute_force(documents, p):
    rows = cloud()
    want, sizes = brute(rows)
    got = {r.doc_id: r for r in chosenpath.link(documents(rows), p).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == n and got[i].kept == (want[i] == i) for i, n in sizes.items())
    assert sorted(r.doc_id for r in chosenpath.deduplicate(documents(rows), p).collect()) == sorted(set(want.values()))


def test_threshold_is_exact(documents):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    for differ, linked in ((8, True), (9, False)):  # 92 common of 108 are 85.2 %, 91 of 109 are 83.5 %
        rows = [(1, " ".join(words)), (2, " ".join([f"x{i}" for i in range(differ)] + words[differ:]))]
        assert (brute(rows)[0][2] == 1) == linked
        assert {r.doc_id: r.component_id for r in chosenpath.link(documents(rows)).collect()} == brute(rows)[0]


def test_stage_takes_near_copies_from_80_percent(spark, documents):
    import corpus_pipeline

    rows = cloud(seed=11)
    words = [f"v{i}" for i in range(104)]  # 100 shingles
    rows += [(2000 + d, " ".join([f"x{d}.{i}" for i in range(d)] + words[d:])) for d in (0, 10, 12)]  # 90 of 110 are 81.8 %, 88 of 112 are 78.6 %
    want = brute(rows, 80)[0]
    assert (want[2010], want[2012]) == (2000, 2012) and brute(rows)[0][2010] == 2010
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(rows), "").collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("p", [chosenpath.Params(), chosenpath.Params(leaf=4, group=2, depth=1), chosenpath.Params(shingles=300)], ids=["production", "pivots", "heavy"])
def test_a_doc_id_with_several_texts_keeps_all_its_links(documents, p):
    rng = random.Random(9)
    a, b = ([f"{x}{i}" for i in range(120)] for x in "ab")
    near = lambda w: " ".join(w[:-2] + ["z", "y"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(b)), (8, near(a)), (5, ""), (9, " ".join(f"c{rng.random()}" for _ in range(50))), (5, " ".join(a))]
    got = chosenpath.link(documents(rows), p).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == {5: 5, 7: 5, 8: 5, 9: 9}
    assert sorted(r.n_shingles for r in got if r.doc_id == 5) == [0, 116, 116, 116]
    assert sorted(r.doc_id for r in chosenpath.deduplicate(documents(rows), p).collect()) == [5, 9]


def test_recall_at_the_last_level(spark):
    """Isolated pairs at the threshold, all nodes kept down to the last level: a miss in 1,000 on average."""
    rng, p = random.Random(5), chosenpath.Params(leaf=1)
    rows = []
    for k in range(1000):
        a = [rng.randrange(1 << 31) for _ in range(p.tokens)]
        rows += [(2 * k, a), (2 * k + 1, [x if rng.random() < p.percent / 100 else rng.randrange(1 << 31) for x in a])]
    _, large = chosenpath.leaves(spark.createDataFrame(rows, "doc_id long, tokens array<int>"), p)
    met = {r.doc_id // 2 for r in large.select("doc_id").distinct().collect()}
    assert 1000 - len(met) <= 6


def test_odd_rows(documents, odd):
    got = chosenpath.link(odd).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id in (1, 2, 3, 5, 6, 7)} == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 5: (1, 5, True), 6: (1, 6, True), 7: (6, 7, True)}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = chosenpath.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert chosenpath.link(documents([])).count() == 0 and chosenpath.deduplicate(documents([])).count() == 0


def test_very_long_texts(documents):
    """Texts of several tiles have the sets, and the links, of brute force."""
    rng = random.Random(8)
    base = [f"Word{rng.randrange(300_000)}" for _ in range(500_000)]
    change = lambda step: [f"n{i}" if i % step == 0 else w for i, w in enumerate(base)]
    rows = [(4, " ".join(base)), (3, "\n".join(change(70))), (2, " ".join(change(50))), (9, "x" * 5_000_000), (8, "x" * 5_000_000)]
    assert all(len(text) > 4 << 20 for _, text in rows)
    want, sizes = brute(rows)
    got = {r.doc_id: r for r in chosenpath.link(documents(rows)).collect()}
    assert want == {4: 3, 3: 3, 2: 2, 9: 8, 8: 8}
    assert {i: r.component_id for i, r in got.items()} == want and {i: r.n_shingles for i, r in got.items()} == sizes


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000), (2000, 2001), (2001, 2000)]
    random.Random(2).shuffle(edges)
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1200)} | {2001: 2000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
