"""Exact dedup and sharding against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from odd import ODD
from feedlens.llm import exact, shards


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


ROWS = [(i, t) for i, t in enumerate(["A b", "a B", None, "", "x", "É", "é", "a b", "y" * 50_000, "Y" * 50_000])]


def test_exact_groups(documents):
    want = defaultdict(list)
    for i, t in ROWS:
        want[lower(t)].append(i)
    got = {r.doc_id: r for r in exact.assign(documents(ROWS)).collect()}
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        g, r = want[lower(t)], got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256(lower(t).encode()).hexdigest())
    assert sorted(r.doc_id for r in exact.deduplicate(documents(ROWS)).collect()) == sorted(max(g) for g in want.values())


def test_equal_digests_are_told_apart_by_their_texts(documents):
    first = lambda text: F.substring(text, 1, 1).cast("binary")
    rows = [(1, "ab"), (2, "ac"), (3, "AB"), (4, "b"), (5, "ac")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.assign(documents(rows), digest=first).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (5, 2), 5: (5, 2), 4: (4, 1)}


def test_exact_odd_rows(documents, odd):
    got = exact.assign(odd).collect()
    assert len(got) == len(ODD)
    # Of repeated rows exactly one stays; null and empty text are one group; a lone null id stays.
    assert Counter(r.doc_id for r in got if r.kept) == {2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 1, 8: 1, 9: 1}
    kept = exact.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == 9
    assert exact.assign(documents([])).count() == 0 and exact.deduplicate(documents([])).count() == 0


def test_exact_hot_group(documents):
    rows = [(i, "Hot" if i % 3 else f"t{i}") for i in range(600)]
    got = exact.assign(documents(rows)).where("group_size > 1").agg(F.max("group_size"), F.min("keep_id"), F.count_if("kept")).first()
    assert tuple(got) == (400, 599, 1)


def test_shards(documents, odd):
    docs = documents([(i, "x" * (i % 50)) for i in range(4000)])
    rows = shards.shard(docs, buckets=16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.size == r.doc_id % 50 + 8 and r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 50)) and r.law == "key"
        assert r.grown_shard in (r.shard, 24)  # one more shard takes rows only into itself
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(abs(len(s) - 4000 / 24) < 6 * math.sqrt(4000 / 24) for s in by.values())
    assert 90 < sum(r.grown_shard == 24 for r in rows) < 250
    # The id alone decides.
    again = {r.doc_id: r.shard for r in shards.shard(documents([(i, None) for i in range(4000)])).collect()}
    assert all(again[r.doc_id] == r.shard for r in rows)
    got = shards.shard(odd).collect()
    assert len(got) == len(ODD) and all(r.shard is not None for r in got)
    assert shards.shard(documents([])).count() == 0


def test_repeated_rows_are_dealt_to_all_buckets(documents):
    """A row that makes up most of the input: each copy has a slot of its own, and no bucket holds many of them."""
    docs = documents([(7, "x")] * 3000 + [(i, "y") for i in range(100, 1100)])
    rows = shards.shard(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1 and sum(r.doc_id == 7 for r in rows) == 3000
    slots = sorted(r.slot for r in rows if r.doc_id == 7)
    assert len(set(slots)) == 3000 and slots != list(range(slots[0], slots[0] + 3000))  # not one run of one bucket


def test_weights_move_rows_only_within_changed_subtrees(spark):
    a = shards.Tree(((((0, 1.0), (1, 1.0)), ((2, 1.0), (3, 1.0))), (((4, 2.0),),)))
    b = shards.Tree(((((0, 1.0), (1, 1.0)), ((2, 3.0), (3, 1.0))), (((4, 2.0),),)))
    rows = spark.range(20_000).select(shards.place(F.col("id"), a).alias("a"), shards.place(F.col("id"), b).alias("b"))
    moved = {(r.a, r.b) for r in rows.where("a <> b").distinct().collect()}
    # Into the region whose weight grew, inside it into the rack whose weight grew, inside that into the shard.
    assert moved <= {(4, b) for b in range(4)} | {(a, b) for a in (0, 1) for b in (2, 3)} | {(3, 2)} and (3, 2) in moved
    share = {r.a: r["count"] / 20_000 for r in rows.groupBy("a").count().collect()}
    assert all(abs(share[k] - w) < 0.02 for k, w in {0: 1 / 6, 1: 1 / 6, 2: 1 / 6, 3: 1 / 6, 4: 1 / 3}.items())


def test_shards_equal_brute_force(documents):
    """The same draws, made one key at a time with another hash library."""
    import xxhash

    def draw(key, path, weight):
        seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        bits = xxhash.xxh64_intdigest(path.encode(), seed) >> 11
        return -math.log((bits + 0.5) / (1 << 53)) / weight

    def weight(part):
        return part[1] if isinstance(part[0], int) else sum(map(weight, part))

    def down(part, path, key):
        if isinstance(part[0], int):
            return part[0]
        i = 0 if len(part) == 1 else min(range(len(part)), key=lambda k: (draw(key, f"{path}/{k}", weight(part[k])), k))
        return down(part[i], f"{path}/{i}", key)

    tree = shards.even_tree()
    rows = shards.shard(documents([(i * 977 - 5000, "x") for i in range(500)] + [(None, "y")])).collect()
    assert len(rows) == 501
    for r in rows:
        assert (r.shard, r.grown_shard) == (down(tree.regions, "", r.doc_id), down(tree.grown().regions, "", r.doc_id))
