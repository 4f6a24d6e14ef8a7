"""A receiver: a process that holds the connection of one feed and hands its lines out by number.

It keeps a bounded number of lines and bytes. When they are used up it stops reading, and the server feels it; each
such wait is a stall. Whoever asks says up to which number lines are safe; those go, the next ones are the answer.
A lost connection is made again, with growing pauses. Each connection may begin with the server's table of commands,
which holds for the lines that follow. A receiver that nobody asks for a while ends.
"""

from __future__ import annotations

import hmac
import json
import socket
import struct
import sys
import threading
import time
import uuid
from collections import deque

from feedlens.functions import bits
from feedlens.sources.connection import Feed, backoff


class Refused(Exception):
    """The other side is no receiver of this feed."""


class Buffer:
    """Lines by growing number, bounded by lines and bytes; one line always fits."""

    def __init__(self, lines: int, size: int, first: int):
        self.lines, self.size, self.next = lines, size, first
        self.held: deque[tuple[int, bytes]] = deque()
        self.bytes = self.stalls = 0
        self.stalled = 0.0
        self.changed = threading.Condition()

    def _full(self, line: bytes) -> bool:
        return bool(self.held) and (len(self.held) >= self.lines or self.bytes + len(line) > self.size)

    def put(self, line: bytes) -> None:
        with self.changed:
            if self._full(line):
                self.stalls += 1
                began = time.monotonic()
                while self._full(line):
                    self.changed.wait()
                self.stalled += time.monotonic() - began
            self.held.append((self.next, line))
            self.next += 1
            self.bytes += len(line)
            self.changed.notify_all()

    def take(self, after: int, lines: int, size: int, wait: float) -> list[tuple[int, bytes]]:
        """Forget what is numbered up to `after`; what comes next, once it reaches a bound or the time is over."""
        deadline = time.monotonic() + wait
        with self.changed:
            while self.held and self.held[0][0] <= after:
                self.bytes -= len(self.held.popleft()[1])
            self.changed.notify_all()
            while len(self.held) < lines and self.bytes < size and (left := deadline - time.monotonic()) > 0:
                self.changed.wait(left)
            out, total = [], 0
            for number, line in self.held:
                if out and (len(out) >= lines or total + len(line) > size):
                    break
                out.append((number, line))
                total += len(line)
            return out


def command_masks(reply: list) -> dict[str, tuple[int, int]]:
    """Flag and category bits of each command by its lower-case name, of a COMMAND reply."""
    text = lambda x: x.decode("latin-1") if isinstance(x, bytes) else str(x)
    names = lambda x: [text(n) for n in x] if isinstance(x, list) else []
    rows = [r for r in reply if isinstance(r, list) and len(r) >= 7 and r[0] is not None]
    return {bits.lower_ascii(text(r[0])): (bits.mask(names(r[2]), bits.FLAG_BITS), bits.mask(names(r[6]), bits.CATEGORY_BITS)) for r in rows}


class Receiver:
    def __init__(self, settings: dict):
        self.settings, self.id = settings, uuid.uuid4().hex
        self.buffer = Buffer(settings["lines"], settings["bytes"], (time.time_ns() // 1_000_000) << 20)
        self.connections = self.failures = 0
        self.error: str | None = None
        self.tables: deque[tuple[int, dict]] = deque(maxlen=16)  #: command tables, with the number from which each holds
        self.asked = time.monotonic()

    def follow(self) -> None:
        """Read the feed for ever."""
        while True:
            try:
                if self.settings.get("metadata"):
                    self.tables.append((self.buffer.next, self.commands()))
                with Feed(self.settings["address"], **self.settings["login"]) as feed:
                    self.connections += 1
                    self.failures = 0
                    while True:
                        for line in feed.lines(time.monotonic() + 3600):
                            self.buffer.put(line)
            except (OSError, ValueError) as e:
                self.failures, self.error = self.failures + 1, f"{type(e).__name__}: {e}"
                time.sleep(backoff(self.failures))

    def commands(self) -> dict[str, tuple[int, int]]:
        """The server's command table; of one that does not tell, every command is unknown."""
        try:
            with Feed(self.settings["address"], monitor=False, **self.settings["login"]) as feed:
                return command_masks(feed.query("COMMAND"))
        except (OSError, ValueError, TypeError):
            return {}

    def answer(self, conn: socket.socket) -> None:
        with conn:
            conn.settimeout(10)
            got = _received(conn)
            if not hmac.compare_digest(str(got.get("token")), self.settings["token"]):
                return
            self.asked = time.monotonic() + got["wait"]
            lines = self.buffer.take(got["after"], got["lines"], got["bytes"], got["wait"])
            facts = {"stalls": self.buffer.stalls, "stalled_seconds": round(self.buffer.stalled, 3), "connections": self.connections, "failures": self.failures, "error": self.error, "receiver": self.id, "sizes": [len(x) for _, x in lines], "numbers": [n for n, _ in lines]}
            if lines and self.tables:
                tables = list(self.tables)
                first = max((i for i, (n, _) in enumerate(tables) if n <= lines[0][0]), default=0)
                facts["tables"] = [t for t in tables[first:] if t[0] <= lines[-1][0]]
            conn.settimeout(60)
            _send(conn, facts, b"".join(x for _, x in lines))
            self.asked = time.monotonic()

    def serve(self, server: socket.socket) -> None:
        server.settimeout(1)
        while time.monotonic() - self.asked < self.settings["idle"]:
            try:
                conn, _ = server.accept()
            except TimeoutError:
                continue
            try:
                self.answer(conn)
            except (OSError, ValueError, KeyError):
                pass  # whoever asked is gone or is no reader; nothing is forgotten before the next request says so


def _send(conn: socket.socket, head: dict, body: bytes = b"") -> None:
    text = json.dumps(head).encode()
    conn.sendall(struct.pack(">II", len(text), len(body)) + text + body)


def _exactly(conn: socket.socket, size: int) -> bytes:
    out = bytearray()
    while len(out) < size:
        if not (more := conn.recv(min(1 << 20, size - len(out)))):
            raise ConnectionError("the other side ended early")
        out += more
    return bytes(out)


def _received(conn: socket.socket) -> dict:
    size, _ = struct.unpack(">II", _exactly(conn, 8))
    if size > 1 << 16:
        raise ValueError("too long a request")
    return json.loads(_exactly(conn, size))


def ask(known: dict, request: dict) -> tuple[list[tuple[int, bytes]], dict]:
    """Lines with their numbers, and what the receiver says of itself."""
    with socket.create_connection((known["host"], known["port"]), 5) as conn:
        conn.settimeout(request["wait"] + 60)
        _send(conn, request | {"token": known["token"]})
        try:
            head, body = struct.unpack(">II", _exactly(conn, 8))
        except ConnectionError as e:
            raise Refused("no answer") from e
        facts = json.loads(_exactly(conn, head))
        rest = _exactly(conn, body)
    lines, at = [], 0
    for number, size in zip(facts.pop("numbers"), facts.pop("sizes"), strict=True):
        lines.append((number, rest[at : at + size]))
        at += size
    return lines, facts


def main() -> None:
    settings = json.loads(sys.stdin.readline())
    server = socket.create_server((settings["host"], 0))
    print(server.getsockname()[1], flush=True)
    receiver = Receiver(settings)
    threading.Thread(target=receiver.follow, daemon=True).start()
    receiver.serve(server)


if __name__ == "__main__":
    main()
