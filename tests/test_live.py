"""Live feeds: capture, replay, bounded buffers, counters, the sink."""

import json
import socket
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedlens.engine import Feed
from feedlens.operators import stats
from feedlens.operators.parse import parse
from feedlens.plans.filters import LineFilter
from feedlens.sources import live, receiver, sink
from feedlens.sources.text import as_lines
from feedlens.streaming.counters import Totals
from feedlens.streaming.feed import render_query, stats_query


class Server:
    """A feed that counts its lines up over all connections; some do not parse. It ends after `most` lines or never."""

    def __init__(self, pause: float = 0.002, most: int = 1 << 40, size: int = 0):
        self.listener, self.connections, self.sent, self.most, self.pause, self.size = socket.create_server(("127.0.0.1", 0)), 0, 0, most, pause, size
        self.address = f"127.0.0.1:{self.listener.getsockname()[1]}"
        threading.Thread(target=self._serve, daemon=True).start()

    def _line(self, n: int) -> bytes:
        return b'+1.%d [0 lua] "%s" "%d%s"\r\n' % (n, b"BAD-CMD" if n % 7 == 3 else b"GET" if n % 2 else b"SET", n, b"x" * self.size)

    def _follow(self, conn) -> None:
        try:
            conn.recv(1000)
            conn.sendall(b"+OK\r\n")
            while self.sent < self.most:
                conn.sendall(self._line(self.sent))
                self.sent += 1
                if self.pause:
                    time.sleep(self.pause)
            conn.recv(10)
        except OSError:
            pass

    def _serve(self) -> None:
        while True:
            conn = self.listener.accept()[0]
            self.connections += 1
            threading.Thread(target=self._follow, args=(conn,), daemon=True).start()


def number(line: bytes) -> int:
    return int(line.split(b" ")[0].split(b".")[1])


@pytest.fixture
def feed(spark, tmp_path):
    spark.dataSource.register(live.FeedSource)

    def make(servers, **options):
        options = {"batch_seconds": "0.3", "idle_seconds": "8", "capture": str(tmp_path / "capture")} | options
        return spark.readStream.format("command_feed").option("addresses", ",".join(s.address for s in servers)).options(**options).load()

    return make


def until(query, done, seconds=90) -> None:
    end = time.time() + seconds
    while time.time() < end and not done():
        assert query.exception() is None, query.exception()
        time.sleep(0.2)
    query.stop()
    assert done()


def test_a_capture_is_asked_for(spark):
    with pytest.raises(ValueError, match="capture"):
        live.FeedReader({"addresses": "h:1"})


def test_every_line_is_written_once_over_twenty_batches(spark, feed, tmp_path):
    servers = [Server(), Server()]
    out = str(tmp_path / "out")
    query = render_query(feed(servers), out, str(tmp_path / "c"), "plain", "%l", once=False)
    until(query, lambda: len(list((tmp_path / "out").glob("batch=*"))) >= 20)
    assert [s.connections for s in servers] == [1, 1]
    lines = spark.read.option("recursiveFileLookup", "true").text(out).collect()
    rejects = spark.read.option("recursiveFileLookup", "true").json(f"{out}-rejects").select("source_id", F.unbase64("line").alias("line")).collect()
    assert all(number(bytes(r.line)) % 7 == 3 for r in rejects)
    for server in servers:
        bad = [number(bytes(r.line)) for r in rejects if r.source_id == server.address]
        assert len(bad) == len(set(bad)) and len(bad) > 100 and sorted(bad) == list(range(3, 7 * len(bad), 7))
    # The other lines do not tell their source: each number comes from both, up to where the sources end.
    seen = Counter(int(r.value.rsplit('"', 2)[1]) for r in lines)
    ends = sorted(max(number(bytes(r.line)) for r in rejects if r.source_id == s.address) for s in servers)
    assert all(seen[n] == 2 for n in range(ends[0]) if n % 7 != 3) and max(seen.values()) == 2
    captured = live.captured(spark, str(tmp_path / "capture"))
    assert captured.count() >= len(lines) + len(rejects) and captured.groupBy("source_id", "seq").count().where("count > 1").isEmpty()


def test_actions_and_retries_of_a_batch_read_the_same_lines(spark, feed, tmp_path):
    server, got, failed = Server(), [], []

    def write(batch, n):
        first, second = ([bytes(r.line) for r in batch.collect()] for _ in range(2))
        assert first == second
        if len(got) == 2 and not failed:
            failed.append((n, first))
            raise RuntimeError("this batch fails once")
        got.append((n, first))

    start = lambda: feed([server]).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(write).start()
    query = start()
    with pytest.raises(Exception, match="fails once"):
        for _ in range(60):
            query.awaitTermination(1)
    until(start(), lambda: len(got) >= 6)
    assert failed and failed[0] in got
    numbers = [number(x) for _, lines in got for x in lines]
    assert numbers == list(range(len(numbers))) and len(numbers) > 100 and server.connections == 1


def test_a_slow_sink_stalls_the_server_and_nothing_is_lost(spark, feed, tmp_path):
    server, got = Server(pause=0, most=20_000, size=2000), []  # more than sockets hold

    def write(batch, n):
        got.extend(number(bytes(r.line)) for r in batch.select("line").collect())
        time.sleep(0.5)

    query = feed([server], buffer_lines="1500", max_lines="1000").writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(write).start()
    for _ in range(150):
        time.sleep(0.2)
        if len(list(tmp_path.glob("capture/*/*/done.json"))) >= 2:
            break
    assert server.sent < 20_000
    found = live.report(spark, str(tmp_path / "capture"))
    assert found.agg(F.max("lines")).first()[0] <= 1000
    until(query, lambda: len(got) >= 20_000)
    assert got == list(range(20_000)) and live.stalls(spark, str(tmp_path / "capture")) > 0
    assert found.agg(F.max("stalled_seconds")).first()[0] > 0


def test_counters_of_a_standing_query(spark, feed, tmp_path):
    server = Server(most=600)
    with Totals(spark) as totals:
        lines = stats.counted(feed([server]), LineFilter.of(["get"]).column())
        query = render_query(lines, str(tmp_path / "out"), str(tmp_path / "c"), "json", once=False)
        until(query, lambda: totals.of(query.id)["total"] >= 600)
        time.sleep(1)
        names = [bytes(r.line).split(b'"')[1] for r in live.captured(spark, str(tmp_path / "capture")).collect()]
        assert totals.of(query.id) == {"total": 600, "filtered": sum(b"GET" not in x for x in names)} and len(names) == 600
        assert totals.report(query.id, 2).startswith("Processed 600 lines (filtered: 3") and totals.report(query.id, 2).endswith("stalls: 2")
    assert totals.of("none") == {"total": 0, "filtered": 0}


def test_a_second_query_follows_the_capture(spark, feed, tmp_path):
    server, seen = Server(most=300), {}
    query = render_query(feed([server]), str(tmp_path / "out"), str(tmp_path / "c"), once=False)
    until(query, lambda: (tmp_path / "capture").exists() and sum(json.loads(p.read_text())["lines"] for p in (tmp_path / "capture").glob("*/*/done.json")) >= 300)
    stats_query(live.follow(spark, str(tmp_path / "capture")), lambda b, n: seen.update({r.name: r["count"] for r in b.collect()}), str(tmp_path / "c2")).awaitTermination()
    assert sum(seen.values()) == 300 and server.connections == 1


def test_a_command_that_a_server_learns_between_two_connections_is_filtered_rightly(spark, feed, tmp_path):
    """The server tells of ODD at its second connection: as a writing command, before that it is unknown and passes."""
    listener, reply = socket.create_server(("127.0.0.1", 0)), b"*7\r\n$%d\r\n%s\r\n:2\r\n*1\r\n+%s\r\n:1\r\n:1\r\n:1\r\n*1\r\n+@slow\r\n"
    monitors = []

    def follow(conn):
        try:
            asked = conn.recv(1000)
            if b"COMMAND" in asked:
                rows = [reply % (3, b"get", b"readonly")] + [reply % (3, b"Odd", b"write")] * bool(monitors)
                conn.sendall(b"*%d\r\n" % len(rows) + b"".join(rows))
            else:
                monitors.append(conn)
                n = len(monitors)
                conn.sendall(b"+OK\r\n" + b"".join(b'+%d.%d [0 lua] "%s" "k"\r\n' % (n, i, (b"GET", b"odd", b"NEW")[i % 3]) for i in range(30)))
                if n > 1:
                    conn.recv(10)
            conn.close()
        except OSError:
            pass

    def serve():
        while True:
            threading.Thread(target=follow, args=(listener.accept()[0],), daemon=True).start()

    threading.Thread(target=serve, daemon=True).start()
    server = type("Listening", (), {"address": f"127.0.0.1:{listener.getsockname()[1]}"})
    got = []
    lines = Feed(feed([server], metadata="true")).filter(flags=["readonly"]).lines
    query = lines.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, n: got.extend(bytes(r.line) for r in b.collect())).start()
    until(query, lambda: sum(x.startswith(b"2.") for x in got) >= 20)
    count = Counter((x[:1], x.split(b'"')[1]) for x in got)
    assert count == {(b"1", b"GET"): 10, (b"1", b"odd"): 10, (b"1", b"NEW"): 10, (b"2", b"GET"): 10, (b"2", b"NEW"): 10}
    assert live.captured(spark, str(tmp_path / "capture"), True).where("cmd_flags is null").count() == 30


def test_old_batches_of_a_capture_go(tmp_path):
    capture = live.Capture(str(tmp_path), 0)
    for n in (1, 2, 30):
        assert capture.folder.claim(f"batch={n}/done.json", {"batch": n})
    assert not capture.folder.claim("batch=2/done.json", {"batch": 5}) and capture.done(2) == {"batch": 2}
    capture.purge(2)
    assert sorted(capture.folder.names()) == ["batch=2", "batch=30"] and capture.done(1) is None


def test_buffer_is_bounded():
    buffer = receiver.Buffer(3, 100, 10)
    threading.Thread(target=lambda: [buffer.put(b"%d" % i) for i in range(8)], daemon=True).start()
    assert buffer.take(0, 99, 99, 0.3) == [(10, b"0"), (11, b"1"), (12, b"2")]
    assert buffer.take(11, 2, 99, 0.3) == [(12, b"2"), (13, b"3")]
    assert buffer.take(11, 99, 1, 0.3) == [(12, b"2")]
    assert [x for _, x in buffer.take(14, 99, 99, 0.3)] == [b"5", b"6", b"7"] and buffer.stalls >= 2
    wide = receiver.Buffer(99, 10, 0)
    wide.put(b"x" * 50)
    assert wide.take(-1, 9, 9, 0) == [(0, b"x" * 50)]


def test_a_receiver_answers_only_its_own_readers(tmp_path):
    server = Server(most=5)
    reader = live.FeedReader({"addresses": server.address, "capture": str(tmp_path), "idle_seconds": "5"})
    known = reader._start(0)
    lines, facts = receiver.ask(known, {"after": 0, "lines": 5, "bytes": 1000, "wait": 5})
    assert [number(x[1:]) for _, x in lines] == list(range(5)) and facts["connections"] == 1
    with pytest.raises(receiver.Refused):
        receiver.ask(known | {"token": "other"}, {"after": 0, "lines": 1, "bytes": 1, "wait": 0})
    # One that is out of reach is replaced.
    gone = live.FeedReader({"addresses": "127.0.0.1:1", "capture": str(tmp_path), "idle_seconds": "2", "retries": "1", "batch_seconds": "1"})
    live.Capture(str(tmp_path), 0).folder.put_json("receiver.json", known | {"port": 1})
    with pytest.raises(RuntimeError, match="no connection"):
        list(gone.read(live.Slice(0, 0, 1)))
        list(gone.read(live.Slice(0, 1, 2)))


# ---------------------------------------------------------------- the sink

RECORDS = ['1.5 [0 lua] "SET" "a" "b"', "broken", '1.5 [0 lua] "GET" "c,d"', '1.5 [0 lua] "GET" "open']


@pytest.fixture
def outcome(spark):
    spark.dataSource.register(sink.FeedOutput)
    rows = as_lines(spark.createDataFrame(list(enumerate(RECORDS)), "n long, value string"), seq=F.col("n"))
    return lambda kind: sink.outcome(parse(rows), kind)


@pytest.mark.parametrize(("kind", "want"), [
    ("resp", b"*3\r\n$3\r\nSET\r\n$1\r\na\r\n$1\r\nb\r\n*2\r\n$3\r\nGET\r\n$3\r\nc,d\r\n"),
    ("csv", b'1.5,0,lua,SET,a,b\n1.5,0,lua,GET,"c,d"\n'), ("plain", b'1.5 [0 lua] "SET" "a" "b"\n1.5 [0 lua] "GET" "c,d"\n1.5 [0 lua] "GET" "open\n'),
])
def test_sink_writes_bytes_and_dead_letters(outcome, tmp_path, kind, want):
    path = tmp_path / "out"
    for mode in ("append", "overwrite"):
        outcome(kind).coalesce(1).write.format("feed_output").option("kind", kind).mode(mode).save(str(path))
        assert [p.read_bytes() for p in path.glob("batch=*/part-*.txt")] == [want]
        dead = [json.loads(x) for p in (tmp_path / "out-rejects").glob("batch=*/part-*.json") for x in p.read_text().splitlines()]
        assert [d["seq"] for d in dead] == ([1] if kind == "plain" else [1, 3]) and dead[0]["message"] == "Failed to parse line 'broken' (grammar)"
    outcome(kind).coalesce(1).write.format("feed_output").option("kind", kind).mode("append").save(str(path))
    assert len(list(path.glob("batch=*/part-*.txt"))) == 2 and not list(path.glob("_work-*"))


def test_a_task_that_fails_leaves_no_bytes(spark, outcome, tmp_path):
    bad = outcome("plain").unionAll(outcome("plain").withColumn("value", F.raise_error(F.lit("stop")).cast("binary")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("feed_output").mode("append").save(str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []


def test_a_killed_worker_leaves_no_bytes(spark, outcome, tmp_path):
    """Its task runs again on another worker; the batch has its records once."""
    once = str(tmp_path / "killed")

    @F.udf("binary")
    def kill(value):
        import os

        if not os.path.exists(once):
            open(once, "w").close()
            os.kill(os.getpid(), 9)
        return value

    rows = outcome("plain").coalesce(1).withColumn("value", kill("value"))
    try:
        rows.write.format("feed_output").mode("append").save(str(tmp_path / "out"))
    except Exception:  # a local session does not run a task again
        assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []
        rows.write.format("feed_output").mode("append").save(str(tmp_path / "out"))
    assert [len(p.read_bytes().splitlines()) for p in (tmp_path / "out").glob("batch=*/part-*.txt")] == [3] and not list((tmp_path / "out").glob("_work-*"))
