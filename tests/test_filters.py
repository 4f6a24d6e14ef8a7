"""Many literals in one filter."""

import random
import re

from pyspark.sql import functions as F

from feedlens.functions.bits import lower_ascii
from feedlens.plans import filters
from feedlens.plans.filters import LineFilter
from feedlens.sources.text import as_lines


def test_tree_equals_containment():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abAB-.x") for _ in range(rng.randint(1, n)))
    for size in (1, 5, 9, 40, 300):
        words = [word(9) for _ in range(size)] + ["a" * k + "bb" for k in range(30)]
        test = re.compile(filters.literals(words), re.ASCII)
        for name in [word(14) for _ in range(300)] + words:
            assert bool(test.search(name)) == any(lower_ascii(w) in lower_ascii(name) for w in words), (words, name)
    assert filters.literals(["", "a"]) == ""
    assert filters._minimal({"get", "mget", "ge.t", "set"}) == ["ge.t", "get", "set"]


def test_deep_trees_are_listed():
    test = re.compile(filters.literals(["a" * k + "b!" for k in range(200)] + ["c" * 500 + y for y in "12"] + ["d" * k + "e" * (200 - k) for k in range(200)]))
    assert test.search("a" * 120 + "b!") and test.search("c" * 501 + "2") and test.search("d" * 150 + "e" * 50)
    assert not test.search("ab") and not test.search("c" * 499 + "2") and not test.search("d" * 150 + "e" * 49)


def test_thousands_of_literals(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz._") for _ in range(rng.randint(6, 14))) for _ in range(10_000)]
    names = [rng.choice(words).upper() if i % 3 == 0 else f"M.{rng.choice(words)[1:]}" if i % 3 == 1 else "GETRANGE" for i in range(900)]
    rows = as_lines(spark.createDataFrame([(i, f'1.0 [0 lua] "{n}" "k"') for i, n in enumerate(names)], "n long, value string"), seq=F.col("n"))
    kept = {r.seq for r in rows.where(LineFilter.of(words).column()).select("seq").collect()}
    low = [w.lower() for w in words]
    assert kept == {i for i, n in enumerate(names) if any(w in n.lower() for w in low)} and len(kept) >= 300
    left = {r.seq for r in rows.where(LineFilter.of([f"!{w}" for w in words]).column()).select("seq").collect()}
    assert left == set(range(900)) - kept


def test_literals_beyond_ascii_match_their_bytes(spark):
    rows = as_lines(spark.createDataFrame([('1.0 [0 lua] "GÉT"',), ('1.0 [0 lua] "GéT"',)], "value string"))
    assert [bytes(r.line).decode() for r in rows.where(LineFilter.of(["é"]).column()).select("line").collect()] == ['1.0 [0 lua] "GéT"']
