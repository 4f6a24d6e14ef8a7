"""Event time in streams against the batch, and merged sketches."""

import time

import pytest
from pyspark.sql import functions as F

from feedlens.operators import sketches, windows
from feedlens.sources.text import as_lines, stream_lines
from feedlens.streaming.counters import Totals


def line(second, name, who="lua"):
    return f'{second}.000000 [0 {who}] "{name}" "k{second % 5}"'


@pytest.fixture
def stream(spark, tmp_path):
    """A function that takes the lines of each file, read a file a batch, and gives them as a stream and as a batch."""
    def make(*files):
        folder = tmp_path / "in"
        folder.mkdir()
        for i, lines in enumerate(files):
            (folder / f"{i}.log").write_text("".join(f"{x}\n" for x in lines))
            time.sleep(1.1)
        return stream_lines(spark, str(folder), max_files=1), as_lines(spark.read.text(str(folder)))

    return make


def collected(spark, rows, tmp_path, mode="append"):
    out = []
    with Totals(spark) as totals:
        query = rows.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        time.sleep(1)
        return sorted(out), totals.late(query.id)


def test_windows_of_a_stream_close_and_late_lines_are_counted(spark, stream, tmp_path):
    rows, batch = stream([line(s, "GET") for s in range(0, 1200, 7)] + ["broken", "OK"], [line(s, "SET") for s in range(1200, 2400, 5)], [line(30, "GET"), line(2000, "GET")], [line(9000, "END")])
    got, late = collected(spark, windows.by_window(rows, "10 minutes", delay="5 minutes"), tmp_path)
    want = sorted(tuple(r) for r in windows.by_window(batch, "10 minutes").collect())
    # The line of second 30 came after its window had closed, and the last window is still open.
    assert late == 1 and [g[2:] for g in got] == [w[2:] if w[3] != 87 else ("GET", 86, w[4] - len(line(30, "GET"))) for w in want[:-1]]


def test_sessions_of_a_stream_equal_the_batch(spark, stream, tmp_path):
    first, second = [line(s, "GET", "10.0.0.1:5") for s in (0, 100, 390, 1000)], [line(s, "GET", "10.0.0.2:6") for s in (50, 351)]
    rows, batch = stream(first[:2] + second[:1], first[2:] + second[1:], [line(9000, "END")])
    got, late = collected(spark, windows.sessions(rows, delay="10 minutes"), tmp_path)
    want = sorted(tuple(r) for r in windows.sessions(batch).collect())
    assert late == 0 and got == want[:-1] and [w[3] for w in want[:-1]] == [3, 1, 1, 1]


def test_lines_of_a_feed_read_twice_come_once(spark, stream, tmp_path):
    lines = [line(s, "GET") for s in range(1000, 1050)]
    rows, batch = stream(lines[:30] + lines[5:9], lines[20:], [lines[49], line(1060, "SET"), "broken"])
    got, _ = collected(spark, windows.once_each(rows, "10 minutes").select(F.col("line").cast("string")), tmp_path)
    assert got == sorted((x,) for x in [*lines, line(1060, "SET")])
    assert sorted(tuple(r) for r in windows.once_each(batch).select(F.col("line").cast("string")).collect()) == got


def test_sketches_merge(spark):
    rows = as_lines(spark.range(40_000).select(F.concat((F.col("id") * 60).cast("string"), F.lit('.0 [0 lua] "SET" "key'), (F.col("id") % 9000).cast("string"), F.lit('"')).alias("value")))
    days = sketches.daily(rows)
    assert days.count() == 28
    one = sketches.estimates(sketches.merged(days), 0.0, 1.0).first()
    assert one.lines == 40_000 and abs(one.distinct_keys - 9000) < 270 and (one.size_0, one.size_100) == (len('0.0 [0 lua] "SET" "key0"'), len('2399940.0 [0 lua] "SET" "key3999"'))
    again = sketches.estimates(sketches.merged(sketches.merged(days, "day").unionByName(sketches.merged(days, "day"))), 0.5).first()
    assert abs(again.distinct_keys - 9000) < 270 and again.lines == 80_000
