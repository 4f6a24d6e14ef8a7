"""The registered queries against their SQL, and the pipeline stage by stage."""

from collections import defaultdict

import pytest

from feedlens.llm import crf, queries
from oracle import same
from test_chosenpath import brute, shingles


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 1 + len(queries.queries())))


@pytest.mark.parametrize("name", ["op2_quality", "op4_sharding", "op5_simple8b", "op6_packing", "op7_toxicity", "op9_decontamination", "op11_suffix_dedup"])
def test_query_covers_every_document(spark, sf_dir, name):
    rows = queries.queries()[name](spark, sf_dir)
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    seen = {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        seen[name] = (docs.collect(), out.collect())
        docs = spark.createDataFrame(seen[name][1], out.schema)
    assert [n for n, _ in c.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    ids = lambda rows: sorted(r.doc_id for r in rows)
    before, after = seen["toxicity"]
    scored = crf.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).where("predicted = 0").select("doc_id").collect()
    assert ids(after) == ids(scored) and len(after) <= len(before)
    before, after = seen["exact_dedup"]
    last = defaultdict(int)
    for r in before:
        key = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in r.text)
        last[key] = max(last[key], r.doc_id)
    assert ids(after) == sorted(last.values())
    before, after = seen["near_dedup"]
    assert ids(after) == sorted(set(brute([(r.doc_id, r.text) for r in before], 80)[0].values()))
    before, after = seen["decontamination"]
    items = [r.text.lower() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaking = {r.doc_id for r in before if any(i in r.text.lower() for i in items)}
    assert not leaking & set(ids(after)) and all(shingles(r.text) for r in before if r.doc_id not in ids(after))
    before, after = seen["packing"]
    cover = defaultdict(int)
    for r in after:
        cover[r.doc_id] += r.length
    assert set(cover) == set(ids(before)) and all(r.doc_tokens == cover[r.doc_id] for r in after)
