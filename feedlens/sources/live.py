"""Live feeds as a replayable streaming source, by Spark's Python data source API.

A server's feed cannot be read twice, so what is read is captured first. Each source is a partition of its own.
Its connection belongs to a receiver, a process beside the workers that holds a bounded number of lines
(feedlens.sources.receiver). The first read of a batch takes lines from there, up to a deadline or the batch's
bounds, and writes them as Parquet to the capture folder; a file `done.json` makes them the batch, for good. Every
later action on the batch, and every retry of it, reads the capture. The receiver lets go of lines once a later
batch says that they were captured, so a task that dies on the way loses none.

A receiver that is lost with its machine takes what it held and what came until the next one with it: a feed has
no memory. A full receiver stops reading, which the server sees; each time counts as a stall.
"""

from __future__ import annotations

import bisect
import json
import os
import socket
import subprocess
import sys
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from feedlens.functions import bits
from feedlens.sources import receiver
from feedlens.sources.connection import Feed, backoff, frame, request  # noqa: F401  (also names of this module)
from feedlens.sources.files import Folder

SCHEMA = "source_id string, server struct<kind:string,host:string,port:int,path:string,ip:string>, name string, seq bigint, line binary"
#: What the option metadata adds: the bits of a line's command by its server's table at that time, null if that has none.
MASKS = ", cmd_flags int, cmd_categories int"
FACTS = "source int, batch bigint, lines bigint, bytes bigint, last bigint, stalls bigint, stalled_seconds double, connections bigint, receiver string"


def _plain(value):
    """A reply as JSON has it; array items that are arrays stay arrays."""
    return [_plain(x) for x in value] if isinstance(value, list) else value.decode(errors="replace") if isinstance(value, bytes) else value


def command_rows(address: str, **login) -> list[tuple[str]]:
    """Rows (reply) for operators.metadata.commands(): what a server says of its commands."""
    with Feed(address, monitor=False, **login) as feed:
        return [(json.dumps(_plain(row)),) for row in feed.query("COMMAND")]


def slot_rows(seeds: list[str], **login) -> list[tuple]:
    """Rows (start, end, nodes) for operators.topology.nodes(), of the first seed that answers."""
    error: Exception = ValueError("no seeds")
    for seed in seeds:
        try:
            with Feed(seed, monitor=False, **login) as feed:
                reply = _plain(feed.query("CLUSTER", "SLOTS"))
            return [(r[0], r[1], [(n[0], n[1], n[2]) for n in r[2:] if isinstance(n, list) and len(n) >= 3]) for r in reply if isinstance(r, list) and len(r) >= 3]
        except (OSError, ValueError) as e:
            error = e
    raise error


def _command(line: bytes) -> str | None:
    """What stands between the first two quotes, with lower-case letters."""
    parts = line.split(b'"', 2)
    return bits.lower_ascii(parts[1].decode("latin-1")) if len(parts) == 3 else None


class Slice(InputPartition):
    def __init__(self, source: int, start: int, batch: int):
        self.source, self.start, self.batch = source, start, batch


class Capture:
    """The batches of one source: source=i/batch=n/lines-x.parquet, and done.json, which names the file that counts."""

    def __init__(self, path: str, source: int):
        self.folder, self.source = Folder(f"{path.rstrip('/')}/source={source}"), source

    def done(self, batch: int) -> dict | None:
        return self.folder.read_json(f"batch={batch}/done.json")

    def write(self, batch: int, table, facts: dict) -> dict:
        """Add a batch; one that is there already stays."""
        import pyarrow.parquet as pq

        name = f"lines-{uuid.uuid4().hex}.parquet"
        with self.folder.create(f"batch={batch}/{name}") as out:  # not seen by other readers before it is whole
            pq.write_table(table, out)
        facts = {"source": self.source, "batch": batch, "file": name} | facts
        if not self.folder.claim(f"batch={batch}/done.json", facts):
            self.folder.remove(f"batch={batch}/{name}")
            return self.done(batch)
        return facts

    def read(self, done: dict) -> Iterator:
        import pyarrow.parquet as pq

        with self.folder.open(f"batch={done['batch']}/{done['file']}") as file:
            yield from pq.ParquetFile(file).iter_batches(10_000)

    def purge(self, keep: int) -> None:
        """Forget all but the last `keep` batches."""
        numbers = sorted(int(n.removeprefix("batch=")) for n in self.folder.names() if n.startswith("batch="))
        for n in numbers[: max(0, len(numbers) - keep)]:
            self.folder.remove(f"batch={n}")


class FeedReader(DataSourceStreamReader):
    """Options: addresses, names, logins (or user, password, tls...); capture, a folder that all machines share;

    batch_seconds, max_lines, max_bytes (of a batch and source); buffer_lines, buffer_bytes (of a receiver);
    retries (failed connections in a row that end the query), idle_seconds (after which a receiver that nobody asks
    ends), metadata (`true`: a server's command table is read at each connection, and lines carry the bits of their
    command), retain (batches that stay in the capture, or `all`), receiver_host (where receivers listen; with an
    address that other machines reach, they share one connection too).
    """

    def __init__(self, options: dict):
        if not options.get("capture"):
            raise ValueError("a live feed needs the option capture: a folder for what was read, which all machines share")
        self.capture = options["capture"]
        self.addresses = [a.strip() for a in options.get("addresses", "localhost:6379").split(",") if a.strip()]
        self.names = [n.strip() or None for n in options.get("names", "").split(",")] if options.get("names") else [None] * len(self.addresses)
        tls = {k: v for k, v in {"insecure": options.get("insecure", "false").lower() == "true", "ca": options.get("tls_ca"), "cert": options.get("tls_cert"), "key": options.get("tls_key")}.items() if v} if options.get("tls", "false").lower() == "true" else None
        common = {"user": options.get("user"), "password": options.get("password"), "tls": tls}
        # One login a source, as JSON; null means the common one.
        self.logins = [x or common for x in json.loads(options["logins"])] if options.get("logins") else [common] * len(self.addresses)
        self.seconds = float(options.get("batch_seconds", "1"))
        self.idle = float(options.get("idle_seconds", str(max(30.0, 10 * self.seconds))))
        self.retries = int(options.get("retries", "8"))
        self.most = int(options.get("max_lines", "65536")), int(options.get("max_bytes", str(16 << 20)))
        self.held = int(options.get("buffer_lines", "81920")), int(options.get("buffer_bytes", str(64 << 20)))
        self.retain = options.get("retain", "1000")
        self.host = options.get("receiver_host", "127.0.0.1")
        self.metadata = options.get("metadata", "false").lower() == "true"
        self.batch = 0

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        # By the clock, so that numbers also grow from one run of a query to the next.
        self.batch = max(self.batch + 1, time.time_ns() // 1_000_000)
        return {"batch": self.batch}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.batch = max(self.batch, end["batch"])
        return [Slice(i, start["batch"], end["batch"]) for i in range(len(self.addresses))]

    def commit(self, end: dict) -> None:
        if self.retain != "all":
            for i in range(len(self.addresses)):
                Capture(self.capture, i).purge(max(2, int(self.retain)))

    def read(self, part: Slice) -> Iterator:
        capture = Capture(self.capture, part.source)
        done = capture.done(part.batch)
        if done is None:
            after = (capture.done(part.start) or {}).get("last", 0)
            lines, facts = self._fetch(capture, part.source, after)
            done = capture.write(part.batch, self._table(part.source, lines, facts.pop("tables")), facts | {"lines": len(lines), "bytes": sum(len(x) for _, x in lines), "last": lines[-1][0] if lines else after})
        yield from capture.read(done)

    def _table(self, source: int, lines: list[tuple[int, bytes]], tables: list[tuple[int, dict]]):
        import pyarrow as pa

        from feedlens.sources.config import Address

        server = Address.parse(self.addresses[source])
        ip = server.host if server.kind == "tcp" and server.host.replace(".", "").isdigit() else None
        kind = pa.struct([("kind", pa.string()), ("host", pa.string()), ("port", pa.int32()), ("path", pa.string()), ("ip", pa.string())])
        shown = {"kind": server.kind, "host": server.host, "port": server.port, "path": server.path, "ip": ip}
        n = len(lines)
        columns = [pa.array([self.addresses[source]] * n, pa.string()), pa.array([shown] * n, kind), pa.array([self.names[source]] * n, pa.string()), pa.array([s for s, _ in lines], pa.int64()), pa.array([frame(x) for _, x in lines], pa.binary())]
        names = ["source_id", "server", "name", "seq", "line"]
        if self.metadata:
            starts = [n for n, _ in tables]
            found = [tables[max(0, bisect.bisect_right(starts, s) - 1)][1].get(_command(x), (None, None)) if tables else (None, None) for s, x in lines]
            columns += [pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)]
            names += ["cmd_flags", "cmd_categories"]
        return pa.table(columns, names=names)

    def _fetch(self, capture: Capture, source: int, after: int) -> tuple[list[tuple[int, bytes]], dict]:
        """Lines after a number, from the receiver that the capture names or from a new one."""
        ask = {"after": after, "lines": self.most[0], "bytes": self.most[1], "wait": self.seconds}
        known = capture.folder.read_json("receiver.json")
        if known:
            try:
                return self._asked(known, ask)
            except (OSError, receiver.Refused):
                pass  # it is gone, or lives where this machine does not reach
        started = self._start(source)
        capture.folder.put_json("receiver.json", started)
        return self._asked(started, ask)

    def _asked(self, known: dict, ask: dict) -> tuple[list[tuple[int, bytes]], dict]:
        lines, facts = receiver.ask(known, ask)
        if not lines and facts.pop("failures") > self.retries:
            raise RuntimeError(f"no connection: {facts['error']}")
        return lines, {"tables": facts.get("tables", [])} | {k: facts[k] for k in ("stalls", "stalled_seconds", "connections", "receiver")}

    def _start(self, source: int) -> dict:
        settings = {"address": self.addresses[source], "login": self.logins[source], "lines": self.held[0], "bytes": self.held[1], "idle": self.idle, "host": self.host, "metadata": self.metadata, "token": uuid.uuid4().hex}
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        process = subprocess.Popen([sys.executable, "-m", "feedlens.sources.receiver"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env, start_new_session=True)
        process.stdin.write(json.dumps(settings).encode() + b"\n")
        process.stdin.close()
        port = process.stdout.readline()
        process.stdout.close()
        if not port.strip():
            raise RuntimeError("the receiver did not start")
        shown = socket.gethostname() if self.host == "0.0.0.0" else self.host
        return {"host": shown, "port": int(port), "token": settings["token"]}


class FeedSource(DataSource):
    """spark.readStream.format("command_feed").option("addresses", "host:port,...").option("capture", folder)"""

    @classmethod
    def name(cls) -> str:
        return "command_feed"

    def schema(self) -> str:
        return SCHEMA + (MASKS if str(self.options.get("metadata", "false")).lower() == "true" else "")

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(dict(self.options))


def captured(spark: SparkSession, capture: str, metadata: bool = False) -> DataFrame:
    """All lines of a capture that have not been purged, as a batch."""
    return spark.read.schema(SCHEMA + MASKS * metadata).parquet(f"{capture.rstrip('/')}/source=*/batch=*/lines-*.parquet")


def follow(spark: SparkSession, capture: str, metadata: bool = False) -> DataFrame:
    """The lines of a capture as a stream of its own: another query over the same feed, without another connection."""
    return spark.readStream.schema(SCHEMA + MASKS * metadata).option("pathGlobFilter", "lines-*.parquet").parquet(f"{capture.rstrip('/')}/source=*/batch=*")


def report(spark: SparkSession, capture: str) -> DataFrame:
    """Each batch of each source: lines, bytes, and the receiver's stalls and connections up to it."""
    return spark.read.schema(FACTS).json(f"{capture.rstrip('/')}/source=*/batch=*/done.json")


def stalls(spark: SparkSession, capture: str) -> int:
    """Stalls of all receivers of a capture; each counts on from its start."""
    from pyspark.sql import functions as F

    return report(spark, capture).groupBy("source", "receiver").agg(F.max("stalls").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
