"""WARC salvage, URL templates and decontamination against planted cases."""

import gzip
import hashlib
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from feedlens.llm import decontaminate, urltree, warc
from feedlens.llm.shared import saved, scratch
from odd import ODD


def record(name: str, body: bytes, kind="response", **more) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Block-Digest", "sha1:" + hashlib.sha1(body).hexdigest()), ("Content-Length", str(len(body))), *more.items()]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def read(data):
    return [(r["status"], r["offset"], r["bytes"], r.get("record_id")) for r in warc.salvage(data)]


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress], ids=["plain", "gzip"])
def test_salvage(pack):
    a, b, c = (pack(record(n, n.encode() * 50)) for n in "abc")
    assert read(a + b + c) == [("ok", 0, len(a), "<a>"), ("ok", len(a), len(b), "<b>"), ("ok", len(a) + len(b), len(c), "<c>")]
    junk = b"\x00junk" * 9
    assert read(a + junk + c) == [("ok", 0, len(a), "<a>"), ("gap", len(a), len(junk), None), ("ok", len(a) + len(junk), len(c), "<c>")]
    torn = bytearray(b)
    torn[len(b) // 2] ^= 0x55
    got = read(a + bytes(torn) + c)
    assert [x[3] for x in got if x[0] == "ok"] == ["<a>", "<c>"] and [x[:3] for x in got if x[0] == "gap"] == [("gap", len(a), len(b))]
    # A truncated record: later records are found inside what it claims.
    cut = b[: len(b) // 2]
    got = read(a + cut + c)
    assert [x[3] for x in got if x[0] == "ok"] == ["<a>", "<c>"] and sum(x[2] for x in got) == len(a + cut + c)
    cut = read(a + c[:-3])  # a member without its end may still hold its whole record
    assert [x[0] for x in cut if x[2]] == ["ok", "gap"] and sum(x[2] for x in cut) == len(a + c[:-3])
    assert read(b"") == []


def test_salvage_covers_every_byte():
    rng = random.Random(4)
    whole = b"".join(record(str(i), bytes(rng.randrange(256) for _ in range(rng.randrange(80)))) for i in range(20))
    for _ in range(150):
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(data))
            data[at : at + rng.randrange(30)] = bytes(rng.randrange(256) for _ in range(rng.randrange(30)))
        at = 0
        for r in warc.salvage(bytes(data)):
            assert r["offset"] == at and r["bytes"] > 0 and (r["status"] == "ok" or r["reason"])
            at += r["bytes"]
        assert at == len(data)


def test_salvage_of_foreign_forms():
    import base64

    body = b"x" * 90
    base32 = record("b32", body).replace(b"sha1:" + hashlib.sha1(body).hexdigest().encode(), b"sha1:" + base64.b32encode(hashlib.sha1(body).digest()))
    assert [x[0] for x in read(base32)] == ["ok"] and [x[0] for x in read(base32.replace(b"x" * 90, b"y" * 90))] == ["gap"]
    bare = b"WARC/1.0\nWARC-Type: response\nWARC-Record-ID: <lf>\nContent-Length: 3\n\nabc\n\n"
    assert read(bare + record("a", b"1")) == [("ok", 0, len(bare), "<lf>"), ("ok", len(bare), len(record("a", b"1")), "<a>")]
    assert [x[0] for x in read(record("md5", body).replace(b"sha1:", b"md5:"))] == ["ok"]


def test_salvage_of_members_with_several_records():
    rng = random.Random(6)
    many = gzip.compress(b"".join(record(str(i), bytes(rng.randrange(256) for _ in range(40_000))) for i in range(5)))
    last = gzip.compress(record("z", b"end"))
    got = read(many + last)
    assert [x[3] for x in got] == ["<0>", "<1>", "<2>", "<3>", "<4>", "<z>"] and sum(x[2] for x in got) == len(many + last)
    torn = many[:-30_000] + last
    got = read(torn)
    assert [x[3] for x in got if x[0] == "ok"] == ["<0>", "<1>", "<2>", "<3>", "<z>"] and sum(x[2] for x in got) == len(torn)


def test_salvage_takes_linear_time():
    import time

    def seconds(n):
        data = record("a", b"1234").replace(b"1234", b"9999") * n
        began = time.perf_counter()
        assert [x[0] for x in read(data)] == ["gap"]
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 16 * max(seconds(2_000), 0.02)


def _seconds(data: bytes) -> float:
    began = time.process_time()
    rows = list(warc.salvage(data))
    assert sum(r["bytes"] for r in rows) == len(data) and all(r["status"] == "gap" for r in rows)
    return time.process_time() - began


@pytest.mark.parametrize("make", [
    lambda n: b"WARC/1.0\r\n" * n, lambda n: b"WARC/1.0\r\nA: b\r\n" * n, lambda n: b"WARC/1.1\nContent-Length: 99999999999999\n\n" * n, lambda n: b"WARC/1.1\nContent-Length: %s\n\n" % (b"9" * 5000) * (n // 20),
    lambda n: b"\x1f\x8b\x08" * n, lambda n: b"\x1f\x8b\x08\x08abcdefg" * n, lambda n: (b"\x1f\x8b\x08\0\0\0\0\0\0\3" + b"\1\xff\xff\0\0" + bytes(20)) * (n // 2),
], ids=["versions", "headers", "lengths", "digits", "magic", "names", "blocks"])
def test_damage_takes_linear_time(make):
    """Twice the damage takes twice the time; 400 KB of it a few seconds at most."""
    _seconds(make(2000))
    small, large = min(_seconds(make(8_000)) for _ in range(2)), min(_seconds(make(32_000)) for _ in range(2))
    assert large < 10 * small + 0.3 and large < 8


def test_nested_blocks_end_in_a_gap(monkeypatch):
    """Records that hold all that follows, each with a wrong digest."""
    monkeypatch.setattr(warc, "MOST", 1 << 16)
    head = b"WARC/1.1\r\nContent-Length: %07d\r\nWARC-Block-Digest: sha1:" + b"0" * 40 + b"\r\n\r\n"
    size = len(head % 0)
    data = b"".join(head % (size * (3000 - i - 1)) for i in range(3000)) + b"\r\n\r\n"
    assert _seconds(data) < 5


def test_a_bomb_is_not_inflated():
    packed = gzip.compress(bytes(300 << 20), 9)
    record = warc_record(b"fine")
    data = gzip.compress(record) + packed + gzip.compress(record + bytes(200 << 20)) + gzip.compress(record)
    tracemalloc.start()
    rows = list(warc.salvage(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["status"], bytes(r["payload"]) if r["status"] == "ok" else r["reason"]) for r in rows if r["bytes"]] == [("ok", b"fine"), ("gap", "no version line"), ("gap", "no version line"), ("ok", b"fine")]
    assert sum(r["status"] == "ok" for r in rows) == 3 and peak < 20 << 20
    big = gzip.compress(b"".join(warc_record(bytes([65 + i]) * 3000) for i in range(9)))
    rows = list(warc.salvage(big, most=10_000))
    assert [r["status"] for r in rows] == ["ok"] * 3 + ["gap"] and "more than 10000" in rows[-1]["reason"]


def warc_record(payload: bytes) -> bytes:
    return b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length : %d\r\nWARC-Block-Digest: sha1:%s\r\n\r\n%s\r\n\r\n" % (len(payload), hashlib.sha1(payload).hexdigest().encode(), payload)


def test_damaged_archives_give_a_log_of_gaps(spark, tmp_path):
    good, bad = gzip.compress(record("a", b"x")), gzip.compress(record("b", b"y"))[:-9]
    (tmp_path / "one.warc.gz").write_bytes(good + bad + good)
    (tmp_path / "two.warc").write_bytes(record("c", b"z") + b"junk")
    rows = warc.read(spark, str(tmp_path))
    assert rows.where("status = 'ok'").count() >= 3
    log = {(r.archive.rsplit("/", 1)[1], r.offset, r.bytes) for r in warc.gaps(rows).collect()}
    assert log == {("one.warc.gz", len(good), len(bad)), ("two.warc", len(record("c", b"z")), 4)}


def test_warc_files(spark):
    long = "ü" * 600
    rows = [(1, "http://a/", long), (5, "http://b/ x", long), (3, None, long), (4, "u", "small"), (2, "u", "small"), (6, "u", None), (None, "u", "x\r\n\r\nWARC/1.1\r\n"), (7, "u", ""), (5, "http://b/ x", long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    path = scratch(spark, "t")
    warc.write(pages, path, records_per_file=2)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and {r.status for r in got} == {"ok"}
    by = {}
    for r in got:
        by.setdefault(r.record_id, []).append(r)
    name = lambda i: f"<urn:page:{i}>"
    for i, kind, to in ((1, "revisit", 5), (3, "revisit", 5), (4, "response", None), (2, "response", None)):
        assert [(r.record_type, r.refers_to) for r in by[name(i)]] == [(kind, name(to) if to else None)]
    assert {r.payload_digest for i in (1, 3, 5) for r in by[name(i)]} == {hashlib.sha1(long.encode()).hexdigest()}
    assert {r.payload_bytes for i in (1, 3, 5) for r in by[name(i)]} == {1200} and bytes(by["<urn:page:null>"][0].payload).endswith(b"WARC/1.1\r\n")
    empty = scratch(spark, "t")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


# ---------------------------------------------------------------- URLs


def test_hosts_paths_and_rules(spark):
    cases = {
        None: ("", ""), "": ("", ""), "no scheme/x": ("", ""), "http://A.Com": ("a.com", ""), "x://H/p/q?a#b": ("h", "/p/q"), "x://h?q=/x": ("h", ""), "x://h#f/x": ("h", ""), "a://b://c/d": ("b:", "//c/d"), "://h/é#": ("h", "/é"),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urltree.host_of(F.col("u")).alias("h"), urltree.path_of(F.col("u")).alias("p"))
    assert {r.u: (r.h, r.p) for r in rows.collect()} == cases
    rules = {
        ("x.com", "/en/1"): ("com/en/", "block"), ("example.com", "/en/71"): ("example.com/en/7", "allow"), ("a.example.com", "/en/7"): ("example.com/en/7", "allow"), ("badexample.com", "/en/7"): ("com/en/", "block"),
        ("com", "/en/"): ("com/en/", "block"), ("x.com", "/en"): (None, None), ("example.net", "/de/8"): ("example.net/de/8", "block"), ("example.net", "/de/7"): ("net/de/", "allow"), ("x.org", "/es/"): ("org/es/", "block"), ("", ""): (None, None),
    }
    text, action = urltree.rule_of(F.col("h"), F.col("p"), urltree.RULES)
    got = spark.createDataFrame(list(rules), "h string, p string").select("h", "p", text.alias("t"), action.alias("a"))
    assert {(r.h, r.p): (r.t, r.a) for r in got.collect()} == rules


def test_templates_and_purity(spark):
    rows = [(i, f"http://shop.test/item/{i}/view") for i in range(40)] + [(100 + i, f"http://shop.test/spam/{i}") for i in range(40)] + [(200 + i, f"http://shop.test/{p}") for i, p in enumerate(["about", "help"] * 10)]
    rows += [(300, None), (301, "plain"), (None, "http://shop.test/item/3/view")]
    labels = [(i, 0) for i in range(0, 40, 2)] + [(100 + i, 1) for i in range(0, 40, 2)] + [(200 + i, 0) for i in range(20)] + [(100, 0)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, bad string")
    got = {r.page_id: r for r in urltree.judge(pages, spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert len(got) == len(rows)
    assert {got[i].template for i in range(40)} == {"/item/*/view"} and {got[100 + i].template for i in range(40)} == {"/spam/*"} and got[200].template == "/about"
    assert {got[i].verdict for i in [*range(40), *range(200, 220), 300, 301, None]} == {"allow"} and {got[100 + i].verdict for i in range(40)} == {"block"}
    assert urltree.judge(pages.limit(0), spark.createDataFrame(labels, "page_id long, bad int")).count() == 0
    assert {r.verdict for r in urltree.judge(pages, spark.createDataFrame([], "page_id long, bad int")).collect()} == {"allow"}


def test_unlabelled_templates_follow_their_host_and_deep_paths_branch(spark):
    rows = [(i, f"http://bad.test/spam/{'abcd'[i % 4]}.html") for i in range(40)] + [(100, "http://bad.test/spam2/x.html"), (101, "http://good.test/new"), (102, "http://none.test/x")]
    rows += [(200 + i, f"http://good.test/a/b/c/d/{kind}/{i}") for k, kind in enumerate(("ok", "spam")) for i in range(k * 20, k * 20 + 20)]
    labels = [(i, 1) for i in range(40)] + [(200 + i, int(i >= 20)) for i in range(0, 40, 2)]
    got = {r.page_id: r for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert len(got) == len(rows) and (got[100].verdict, got[101].verdict, got[102].verdict) == ("block", "allow", "allow")
    assert {got[200 + i].template for i in range(40)} == {"/a/b/c/d/ok/*", "/a/b/c/d/spam/*"}
    assert {got[200 + i].verdict for i in range(20)} == {"allow"} and {got[220 + i].verdict for i in range(20)} == {"block"}


def test_deep_paths_cost_no_round(spark, monkeypatch):
    """A path of two thousand segments, and forks below a wildcard."""
    tables = []
    monkeypatch.setattr(urltree, "saved", lambda df, name: (tables.append(name), saved(df, name))[1])
    deep = "/" + "/".join(f"s{i}" for i in range(2000))
    rows = [(0, "h", deep, None), (1, "h", deep + "/", None), (2, "h", "", None), (3, "h", "/", None)] + [(10 + i, "h", f"/u{i}/x/p{i % 3}" if i % 2 else f"/u{i}/x", None) for i in range(24)]
    rows += [(100 + i, "h", f"/u{i}/y/q{i}", None) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, host string, path string, bad int")
    got = {r.page_id: r.template for r in urltree.templates(pages).collect()}
    assert got[0] == "/*/" + deep.split("/", 2)[2] and got[1] == got[0] + "/" and got[2] == got[3] == "/*" and got[11] == "/*/x/p1" and got[10] == "/*/x" and got[108] == "/*/y/*"
    assert len(got) == len(rows) and sum(n.startswith("url-children") for n in tables) == 3


def test_frequent_children_keep_their_names(spark):
    rows = [(i, f"http://h.test/p/{i}") for i in range(60)] + [(100 + i, "http://h.test/p/top") for i in range(300)]
    got = urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).collect()
    assert {r.template for r in got if r.page_id < 60} == {"/p/*"} and {r.template for r in got if r.page_id >= 100} == {"/p/top"} and len(got) == 360


def _branches(spark, siblings, p=urltree.Params()):
    """siblings (template, labelled, bad) to {template: (branch, bad_share)}"""
    rows = [("h.test", t, int(i < bad) if i < labelled else None) for t, labelled, bad in siblings for i in range(max(labelled, 1))]
    return {r.template: (r.branch, r.bad_share) for r in urltree.judged_templates(spark.createDataFrame(rows, "host string, template string, bad int"), p).collect()}


def test_similar_siblings_merge(spark):
    siblings = [("/a/x", 40, 36), ("/a/y", 40, 38), ("/a/ok", 40, 2), ("/a/fine", 40, 4), ("/a/new", 0, 0), ("/b/one", 1, 1), ("/b/two", 1, 0), ("/c", 0, 0)]
    got = _branches(spark, siblings)
    assert len(got) == len(siblings)
    assert got["/a/x"] == got["/a/y"] and got["/a/ok"] == got["/a/fine"] and got["/a/x"][0] != got["/a/ok"][0]
    host = (36 + 38 + 2 + 4 + 1 + 1) / (162 + 4)
    of_a, of_b = (80 + 4 * host) / 164, (1 + 4 * host) / 6
    want = {"/a/x": (74 + 4 * of_a) / 84, "/a/ok": (6 + 4 * of_a) / 84, "/a/new": of_a, "/b/one": (1 + 4 * of_b) / 6, "/b/two": (1 + 4 * of_b) / 6, "/c": host}
    assert all(abs(got[t][1] - v) < 1e-12 for t, v in want.items())
    # Small steps from one end to the other do not join the ends.
    chain = _branches(spark, [(f"/a/{i}", 60, 3 * i) for i in range(21)])
    assert chain["/a/0"][0] != chain["/a/20"][0] and len({b for b, _ in chain.values()}) > 2


# ---------------------------------------------------------------- benchmark leaks

ITEM = "If Maria buys 12 apples and Peter sells 7 pears for 3 euros each how many euros does Maria owe to Peter after 12 days"
CHANGED = ITEM.replace("12", "40").replace("Maria", "Olga").replace("7", "9").replace("euros", "dollars")
MIXED = ITEM.replace("12 apples", "40 apples").replace("Maria", "Olga")  # 12 stays elsewhere


def leaks(spark, documents, rows, items=((1, ITEM),), **p):
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    return {r.doc_id: r for r in decontaminate.judge(documents(rows), bench, decontaminate.Params(**p)).collect()}


def test_leaks(spark, documents):
    fill = "and then there was nothing else to say about the long road home " * 3
    rows = [(1, fill + ITEM + ". " + fill), (2, fill + CHANGED + ". " + fill), (3, fill), (4, None), (5, " ".join(ITEM.split()[:9])), (6, (fill + ITEM + ". ") * 3), (7, ITEM.upper().lower())]
    got = leaks(spark, documents, rows)
    assert {i: r.contaminated for i, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: got[7].contaminated}
    assert got[1].coverage > 0.9 and (got[1].changed, got[1].item_id, got[1].n_items) == (False, 1, 1) and got[2].changed and got[2].coverage >= 0.5
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontaminate.decontaminate(documents(rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated} and kept.columns == documents(rows).columns


def test_leaks_in_very_long_texts(spark, documents):
    fill = "and then there was nothing else to say about the long road home " * 80_000
    at = (2 << 20) - 40  # the item lies across the border of two tiles
    rows = [(1, f"{fill[:at]} {ITEM}. {fill}"), (2, f"{fill} {CHANGED}."), (3, fill), (4, "x" * 5_000_000), (5, f"{'x' * 5_000_000} {ITEM}")]
    got = leaks(spark, documents, rows)
    assert {i: r.contaminated for i, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert got[1].coverage == 1.0 and not got[1].changed and got[2].changed


def test_leaks_in_other_case(spark, documents):
    accents = ITEM.replace("owe", "céder à Łódź")
    rows = [(1, ITEM), (2, ITEM.lower()), (3, ITEM.upper()), (4, ITEM.title()), (5, CHANGED), (6, ITEM.replace("12", "40").upper()), (7, accents.upper()), (8, "NOTHING OF IT IS HERE BUT CAPITALS " * 4)]
    got = leaks(spark, documents, rows)
    assert {i: r.contaminated for i, r in got.items()} == {1: True, 2: True, 3: True, 4: True, 5: True, 6: True, 7: True, 8: False}
    assert {got[i].coverage for i in (1, 2, 3, 4)} == {1.0} and not any(got[i].changed for i in (1, 2, 3, 4)) and got[5].changed and got[6].changed
    got = leaks(spark, documents, rows, [(1, ITEM.upper()), (2, accents)])
    assert [got[i].contaminated for i in (1, 2, 3, 4)] == [True] * 4 and (got[7].item_id, got[7].coverage) == (2, 1.0)


def test_slots_of_several_tokens(spark, documents):
    swap = lambda a, b, text=ITEM: text.replace(a, b)
    good = [swap("12", "1,200"), swap("12", "12.5"), swap("12", "1/2"), swap("Maria", "Mary Ann"), swap("Maria", "Mary-Ann van Dyke".replace("van", "Van")), swap("3", "$3"), swap("Maria", "Łucja"), swap("Peter", "Ωmega Žižek"), swap("Maria", "Mary Ann", CHANGED.replace("Olga", "Maria"))]
    got = leaks(spark, documents, list(enumerate(good)))
    assert [got[i].contaminated for i in range(len(good))] == [True] * len(good)
    metric = "A bag of rice weighs 5kg and a smaller bag weighs 750 g so how many kg do both bags weigh together"
    got = leaks(spark, documents, [(1, metric.replace("5kg", "40 lb")), (2, metric.replace("5kg", "1.25kg"))], [(1, metric)])
    assert got[1].contaminated and got[2].contaminated
    bad = [ITEM.replace("12 apples", "1,200 apples"), ITEM.replace("does Maria", "does Mary Ann"), CHANGED.replace("does Olga", "does Mary Ann")]
    got = leaks(spark, documents, list(enumerate(bad)))
    assert not any(got[i].changed and got[i].coverage > 0.75 for i in range(len(bad)))


def test_templates_equal_brute_force(spark, documents):
    """Items with slots: a document holds an item if its template's windows match with slots that map one to one."""
    rng = random.Random(12)
    names, plain = ["Anna", "Bert", "Carla", "Dora", "Egon"], [f"{a}{b}{c}" for a in "bdf" for b in "aeo" for c in "lmn"]
    make = lambda: [rng.choice(plain) if rng.random() < 0.7 else ("N", rng.randrange(3)) if rng.random() < 0.5 else ("P", rng.randrange(2)) for _ in range(20)]
    shapes = [["see", *make()] for _ in range(6)]

    def fill(shape, numbers, people):
        return " ".join(x if isinstance(x, str) else numbers[x[1]] if x[0] == "N" else people[x[1]] for x in shape)

    items = [(i, fill(s, ["3", "41", "77"], ["Anna", "Bert"])) for i, s in enumerate(shapes)]
    rows, want = [], {}
    for d in range(60):
        shape = shapes[d % 6]
        numbers, people = [rng.choice(["5", "6", "1,000", "2.5"]) for _ in range(3)], [rng.choice(["Carla", "Dora", "Egon Fritz"]) for _ in range(2)]
        rows.append((d, fill(shape, numbers, people) + " ."))
        # Brute force on windows of eight: those with three literals match; slots of all of them must map one to one.
        used = {x for a in range(len(shape) - 7) if sum(isinstance(x, str) for x in shape[a : a + 8]) >= 3 for x in shape[a : a + 8] if not isinstance(x, str)}
        values = [numbers[k] if t == "N" else people[k] for t, k in used]
        runs = any(not isinstance(a, str) and not isinstance(b, str) and a[0] == b[0] == "P" for a, b in zip(shape, shape[1:], strict=False))
        if not runs:
            want[d] = len(set(values)) == len(values)
    got = leaks(spark, documents, rows, items)
    assert {d: got[d].contaminated and got[d].changed for d in want} == want and len(set(want.values())) == 2


def test_slots_must_be_consistent(spark, documents):
    got = leaks(spark, documents, [(1, CHANGED), (2, MIXED)])
    assert got[1].contaminated and not got[2].contaminated


def test_matches_equal_brute_force(spark, documents):
    """Literal texts: coverage is the share of an item's windows that occur in the document."""
    rng = random.Random(8)
    word = lambda: f"w{'abcdefghij'[rng.randrange(10)]}{'abcdefghij'[rng.randrange(10)]}{'abcdefghij'[rng.randrange(10)]}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(15)]
    rows = []
    for d in range(60):
        text = [word() for _ in range(rng.randrange(30))]
        if d % 2:
            own = items[d % 15][1].split()
            a = rng.randrange(len(own))
            text += own[a : a + rng.randrange(1, 30)] + [word()]
        rows.append((d, " ".join(text)))
    windows = lambda w, k: {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
    got = leaks(spark, documents, rows, items)
    for d, text in rows:
        w, best = text.split(), []
        for i, item in items:
            own = item.split()
            k = min(8, len(own))
            places = [tuple(own[a : a + k]) for a in range(len(own) - k + 1)]
            share = sum(x in windows(w, k) for x in places) / len(places)
            if share >= 0.5:
                best.append((-share, i))
        assert got[d].contaminated == bool(best) and got[d].n_items == len(best)
        if best:
            assert (got[d].item_id, got[d].coverage) == (min(best)[1], -min(best)[0])


def test_leaks_odd_rows(spark, documents, odd):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "one two three four"), (1, ITEM)], "item_id long, text string")
    got = decontaminate.judge(odd, bench).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if r.contaminated} == {5}
    assert decontaminate.judge(documents([]), bench).count() == 0 and decontaminate.judge(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(odd, bench).count() == len(ODD) - 1


def test_short_items_are_found_as_they_stand(spark, documents):
    items = {1: "What is 12 * 35?", 2: "Compute 12 + 35.", 3: "12", 4: "Is 7 8 9 10 11 12 13 14 15 16?", 5: "Add 3 and 4"}
    texts = {
        10: "First: what is 12 * 35? Then go on.", 11: "what is 12 * 36?", 12: "please compute 12 + 35. Thanks", 13: "compute 35 + 12", 14: "12", 15: "is 7 8 9 10 11 12 13 14 15 16", 16: "is 7 8 9 10 11 12 13 14 15 17 18 19",
        17: "is 7 8 9", 18: "add 3 and 4 and 5", 19: "WHAT IS 12 35",
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.changed) for r in decontaminate.judge(documents(list(texts.items())), bench).collect() if r.contaminated}
    assert got == {10: (1, False), 12: (2, False), 15: (4, False), 16: (4, False), 18: (5, False), 19: (1, False)}
