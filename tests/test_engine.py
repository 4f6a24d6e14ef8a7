"""Filters, sources, streaming, live feeds and the command line."""

import socket
import threading
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from feedlens import cli
from feedlens.engine import Feed
from feedlens.functions import bits
from feedlens.operators import metadata, stats
from feedlens.plans.filters import LineFilter, Pattern, java, matches
from feedlens.sources import config, live
from feedlens.sources.text import as_lines, stream_lines
from feedlens.streaming.feed import positive, render_query


def test_patterns():
    assert Pattern.parse("!/^a/") == Pattern("^a", True, True)
    assert Pattern.parse("/") == Pattern("/", False, False)
    assert Pattern.parse("!") == Pattern("", False, True)
    for bad in ("/(/", "/(?=a)/", r"/(a)\1/", "/a*+/"):
        with pytest.raises(ValueError):
            Pattern.parse(bad)
    assert java("(?P<n>[[:alpha:]])") == r"(?<n>[\p{Alpha}])"
    # The text alone decides what counts as the same pattern; the first one stays.
    assert LineFilter.of(["/get/", "get"]).include == (Pattern("get", True, False),)
    assert matches("MGET", ["get"]) and not matches("GEOADD", ["/^geo/"]) and not matches("GET", ["get", "!g"])


def test_literals_are_ascii_case_insensitive_and_quoted(spark):
    rows = as_lines(spark.createDataFrame([(f'1.0 [0 lua] "{c}"',) for c in ("M.GET", "MXGET", "m.get", "É")], "value string"))
    f = LineFilter.of(["m.g"])
    assert sorted(r[0] for r in rows.where(f.column()).select(F.col("line").cast("string")).collect()) == ['1.0 [0 lua] "M.GET"', '1.0 [0 lua] "m.get"']


def test_masks():
    assert bits.parse_masks(["write, @hash", "RO", "nosuch"]) == (bits.FLAG_BITS["write"] | bits.FLAG_BITS["readonly"], bits.CATEGORY_BITS["@hash"])
    assert bits.FLAG_BITS["write"] == 1 << 19 and bits.CATEGORY_BITS["@write"] == 1 << 20 and bits.KEY_SPEC_BITS["variable_flags"] == 1 << 10


def test_metadata_by_source(spark):
    rows = as_lines(spark.createDataFrame([('1.0 [0 lua] "Get"',)], "value string"), source_id="a").unionByName(as_lines(spark.createDataFrame([('1.0 [0 lua] "Get"',)], "value string"), source_id="b"))
    table = metadata.from_rows(spark, [("GET", ["readonly"], [])]).withColumn("source_id", F.lit("a"))
    assert {(r.source_id, r.cmd_flags) for r in metadata.lookup(rows, table, ["source_id"]).collect()} == {("a", 1 << 15), ("b", None)}


def test_observed_counters(spark):
    rows = as_lines(spark.range(10).select(F.format_string('1.0 [0 lua] "C%d"', "id").alias("value")))
    seen = Observation("io")
    assert Feed(rows).filter(["!C3"], seen=seen).lines.count() == 9 and seen.get == {"total": 10, "filtered": 1}
    assert stats.report(10, 1) == "Processed 10 lines (filtered: 1), backpressure stalls: 0"


def test_config(tmp_path, monkeypatch):
    file = tmp_path / "c.toml"
    file.write_text('[one]\nhost = "h"\nport = 7000\npath = "/unused"\nuser = "u"\npass = "p"\ntls = true\n[two]\naddresses = ["a:1", "b"]\n[three]\npath = "/s"\n[bad]\ncolor = "red"\n')
    c = config.load(str(file))
    got = config.sources(["one", "two", "three", "b:6379", "6400"], c, "x", "y")
    assert [(s.name, s.address.text, s.user) for s in got] == [("one", "h:7000", "u"), ("two", "a:1", None), ("two", "b:6379", None), ("three", "/s", None), (None, "127.0.0.1:6400", "x")]
    assert got[0].tls == config.Tls() and "password" not in repr(got[0])
    with pytest.raises(ValueError):
        config.sources(["bad"], c)
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path / "none"))
    assert config.load() == {}
    assert [s.address.text for s in config.sources([], {})] == ["localhost:6379"]
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "missing"))


def test_requests_and_backoff():
    assert live.request("AUTH", "ü") == b"*2\r\n$4\r\nAUTH\r\n$2\r\n\xc3\xbc\r\n"
    with pytest.raises(ValueError):
        live.request()
    assert all(0.05 <= live.backoff(n) <= 1 for n in range(20))
    assert live.frame(b"+x\r\n") == b"x"


def _server(n: int) -> int:
    """A feed that asks for a password, sends lines with the reply, and then more."""
    listener = socket.create_server(("127.0.0.1", 0))

    def serve():
        conn, _ = listener.accept()
        assert b"secret" in conn.recv(1000)
        conn.sendall(b"+OK\r\n")
        assert b"MONITOR" in conn.recv(1000)
        conn.sendall(b"+OK\r\n" + b"".join(b'+1.%d [0 lua] "GET" "k"\r\n' % i for i in range(n // 2)))
        conn.sendall(b"".join(b'+1.%d [0 lua] "GET" "k"\r\n' % i for i in range(n // 2, n)))
        conn.recv(10)

    threading.Thread(target=serve, daemon=True).start()
    return listener.getsockname()[1]


def test_live_feed(spark, tmp_path):
    spark.dataSource.register(live.FeedSource)
    rows = spark.readStream.format("command_feed").option("addresses", f"127.0.0.1:{_server(50)}").option("password", "secret").option("batch_seconds", "2").option("capture", str(tmp_path / "capture")).option("idle_seconds", "10").load()
    got = []
    q = rows.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, n: got.extend(b.collect())).start()
    for _ in range(40):
        q.awaitTermination(1)
        if len(got) >= 50 or q.exception():
            break
    q.stop()
    assert len(got) == 50 and bytes(got[0].line).startswith(b"1.0 [0 lua]") and got[0].server.port > 0


def _answers(*replies: bytes) -> int:
    """A server that gives each connection the same reply to its one request."""
    listener = socket.create_server(("127.0.0.1", 0))

    def serve():
        for reply in replies:
            conn, _ = listener.accept()
            conn.recv(1000)
            for a in range(0, len(reply), 7):  # in small packets
                conn.sendall(reply[a : a + 7])

    threading.Thread(target=serve, daemon=True).start()
    return listener.getsockname()[1]


def test_discovery(spark):
    from feedlens.operators import topology

    slots = b"*2\r\n*4\r\n:0\r\n:9\r\n*3\r\n$2\r\nh1\r\n:7000\r\n$1\r\na\r\n*3\r\n$2\r\nh2\r\n:7001\r\n$1\r\nr\r\n*2\r\n:10\r\n:19\r\n"
    command = b"*1\r\n*7\r\n$3\r\nget\r\n:2\r\n*2\r\n+readonly\r\n+fast\r\n:1\r\n:1\r\n:1\r\n*1\r\n+@read\r\n"
    rows = live.slot_rows(["127.0.0.1:1", f"127.0.0.1:{_answers(slots)}"])
    assert rows == [(0, 9, [("h1", 7000, "a"), ("h2", 7001, "r")])]
    table = spark.createDataFrame(rows, "start long, end long, nodes array<struct<host string, port int, id string>>")
    assert {(r.host, r.role) for r in topology.members(topology.nodes(table), True).collect()} == {("h1", "primary"), ("h2", "replica")}
    found = metadata.commands(spark.createDataFrame(live.command_rows(f"127.0.0.1:{_answers(command)}"), "reply string")).collect()
    assert [(r.name, r.arity, r.flags, r.categories) for r in found] == [("get", 2, bits.FLAG_BITS["readonly"] | bits.FLAG_BITS["fast"], bits.CATEGORY_BITS["@read"])]
    with pytest.raises(ConnectionError):
        live.command_rows(f"127.0.0.1:{_answers(b'-ERR no' + bytes([13, 10]))}")


def test_stream_renders_like_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.log").write_text("".join(f'1.{k} [0 lua] "SET" "k{i}" "{k}"\n' for k in range(20)) + "OK\nbroken\n")
    render_query(stream_lines(spark, str(tmp_path / "in"), max_files=1), str(tmp_path / "out"), str(tmp_path / "c"), "json").awaitTermination()
    got = sorted(r.value for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out")).collect())
    assert got == sorted(bytes(r.value).decode() for r in Feed.read(spark, str(tmp_path / "in")).render("json").collect()) and len(got) == 60


def test_a_repeated_batch_replaces_its_output(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('1.5 [0 lua] "GET" "k"\nbroken\n')
    out = str(tmp_path / "out")
    for i in range(2):  # with a checkpoint of its own the second run starts again at batch 0
        render_query(stream_lines(spark, str(tmp_path / "in")), out, str(tmp_path / f"c{i}"), "plain", "%C").awaitTermination()
    assert [r.value for r in spark.read.option("recursiveFileLookup", "true").text(out).collect()] == ["GET"]
    assert [r.error for r in spark.read.option("recursiveFileLookup", "true").json(f"{out}-rejects").collect()] == ["grammar"]


def test_flags_by_the_table_of_each_source(spark):
    from feedlens.sources.text import as_lines

    rows = spark.createDataFrame([('1.5 [0 lua] "ODD" "k"',)], "value string")
    lines = as_lines(rows, source_id="a").unionByName(as_lines(rows, source_id="b"))
    replies = spark.createDataFrame([("a", '["odd",2,["write"],1,1,1,["@hash"]]'), ("b", '["odd",2,["readonly"],1,1,1,["@hash"]]'), ("b", '["short"]')], "source_id string, reply string")
    kept = Feed(lines).with_commands(metadata.commands_by_source(replies)).filter(flags=["write"]).lines
    assert [r.source_id for r in kept.collect()] == ["a"]


def test_interval():
    assert positive("0.5") == 0.5
    for bad in ("0", "-1", "nan"):
        with pytest.raises(ValueError):
            positive(bad)


def test_cli(spark, tmp_path, capfdbinary):
    (tmp_path / "x.log").write_text('1.5 [2 lua] "SET" "k" "v"\n1.5 [0 lua] "GET" "k"\n')
    assert cli.main(["--stdin", str(tmp_path), "--filter", "!get", "--db", "2", "-o", "plain", "-f", "%d %C"]) == 0
    shown = capfdbinary.readouterr()
    assert shown.out.endswith(b"2 SET\n") and b"Processed 2 lines (filtered: 1), backpressure stalls: 0" in shown.err
    out = tmp_path / "out"
    assert cli.main(["--stdin", str(tmp_path / "x.log"), "--filter", "!get", "-o", "resp", "--out", str(out)]) == 0
    assert b"".join(p.read_bytes() for p in out.glob("batch=*/part-*.txt")) == b"*3\r\n$3\r\nSET\r\n$1\r\nk\r\n$1\r\nv\r\n"
    assert b"Processed 2 lines (filtered: 1)" in capfdbinary.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["--output", "xml"])
    with pytest.raises(ValueError):
        cli.main(["--stdin", str(tmp_path), "--filter", "/(/"])


def test_views(spark, sf_dir):
    from feedlens.queries import feed_lines

    Feed(feed_lines(spark, sf_dir)).register(spark)
    assert spark.sql("select count(*) from parsed_lines where ok").first()[0] == spark.table("raw_lines").count()
