"""Counts as keyed state against the batch."""

import time

import pytest
from pyspark.sql import functions as F

from feedlens.operators import stats
from feedlens.queries import _values, feed_lines
from feedlens.sources.text import as_lines
from feedlens.streaming.feed import counts_query


@pytest.fixture(scope="module")
def replay(spark, sf_dir, tmp_path_factory):
    """The feed in four files by event_id, as a stream of a file a batch; command names beyond the feed's own among them."""
    path = str(tmp_path_factory.mktemp("replay"))
    odd = spark.createDataFrame([(-1, '1.0 [0 lua] "ODD" "k"'), (-2, '1.0 [0 lua] "ODD" "first"'), (-3, "no command"), (-4, "OK")], "event_id long, value string")
    rows = _values(spark, sf_dir).unionByName(odd).withColumn("file", F.when(F.col("event_id") < 0, 0).otherwise(F.least(F.lit(3), F.expr("event_id div 300"))))
    for n in range(4):
        rows.where(F.col("file") == n).select("event_id", "value").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files go by their time
    return path


def streamed(spark, path):
    return as_lines(spark.readStream.schema("event_id long, value string").option("maxFilesPerTrigger", 1).parquet(path), seq=F.col("event_id"))


@pytest.mark.parametrize("compat", [False, True])
def test_stream_equals_batch(spark, replay, tmp_path, compat):
    latest, batches = {}, []

    def write(batch, n):
        batches.append(n)
        latest.update({r.name: (r["count"], r.bytes) for r in batch.collect()})

    counts_query(streamed(spark, replay), write, str(tmp_path / "c"), compat).awaitTermination()
    want = stats.by_command(as_lines(spark.read.parquet(replay).where("value <> 'OK'"), seq=F.col("event_id")), compat)
    assert latest == {r.name: (r["count"], r.bytes) for r in want.collect()} and len(batches) >= 4 and latest["ODD"][0] == 2 - compat


def test_state_outlives_a_restart(spark, replay, tmp_path):
    latest = {}

    def write(batch, n):
        if n == 2 and "failed" not in latest:
            latest["failed"] = True
            raise RuntimeError("once")
        latest.update({r.name: (r["count"], r.bytes) for r in batch.collect()})

    with pytest.raises(Exception, match="once"):
        counts_query(streamed(spark, replay), write, str(tmp_path / "c"), True).awaitTermination()
    counts_query(streamed(spark, replay), write, str(tmp_path / "c"), True).awaitTermination()
    want = stats.by_command(as_lines(spark.read.parquet(replay).where("value <> 'OK'"), seq=F.col("event_id")), True)
    assert latest.pop("failed") and latest == {r.name: (r["count"], r.bytes) for r in want.collect()}


def test_timer_gives_each_command_once_an_interval(spark, sf_dir, tmp_path):
    path, seen = str(tmp_path / "in"), []
    feed_lines(spark, sf_dir).select(F.col("seq").alias("event_id"), F.col("line").cast("string").alias("value")).limit(50).coalesce(1).write.parquet(path)
    query = counts_query(streamed(spark, path), lambda b, n: seen.extend((r.name, r["count"]) for r in b.collect()), str(tmp_path / "c"), seconds=1.0)
    for _ in range(40):
        query.awaitTermination(1)
        if query.exception() or sum(n for _, n in seen) >= 50:
            break
    time.sleep(3)
    query.stop()
    assert query.exception() is None and len(seen) == len({name for name, _ in seen}) and sum(n for _, n in seen) == 50
