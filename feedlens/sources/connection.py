"""One connection to a server: requests, replies, and the lines of its feed."""

from __future__ import annotations

import random
import socket
import ssl
import time
from collections.abc import Iterator


def request(*parts: str | bytes) -> bytes:
    """A request as an array of bulk strings."""
    if not parts:
        raise ValueError("an empty request")
    body = [p.encode() if isinstance(p, str) else p for p in parts]
    return b"*%d\r\n" % len(body) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in body)


def backoff(retries: int, rng=random) -> float:
    """Seconds to wait: 50 ms doubled per retry with jitter, a second at most."""
    return min(1.0, 0.05 * 2 ** (min(retries, 6) + rng.choice((0, 1, 2))))


def frame(line: bytes) -> bytes:
    """A line without one line end and one leading plus."""
    return line.removesuffix(b"\n").removesuffix(b"\r").removeprefix(b"+")


class Feed:
    """One connection: handshake, then lines. What follows a reply in the same packet is kept."""

    def __init__(self, address: str, user: str | None = None, password: str | None = None, tls: dict | None = None, timeout: float = 5.0, monitor: bool = True):
        from feedlens.sources.config import Address

        self.address = Address.parse(address)
        self.held, self.at, self.closed = bytearray(), 0, False
        if self.address.kind == "unix":
            self.socket = socket.socket(socket.AF_UNIX)
            self.socket.settimeout(timeout)
            self.socket.connect(self.address.path)
        else:
            self.socket = socket.create_connection((self.address.host, self.address.port), timeout)
            if tls is not None:
                self.socket = context(**tls).wrap_socket(self.socket, server_hostname=self.address.host)
        if password is not None:
            self.ask("AUTH", *([user] if user is not None else []), password)
        if monitor:
            self.ask("MONITOR")

    def close(self) -> None:
        self.closed = True
        self.socket.close()

    def __enter__(self) -> Feed:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def ask(self, *parts: str) -> bytes:
        self.socket.sendall(request(*parts))
        reply = next(self.lines(time.monotonic() + 5), None)
        if reply is None or not reply.startswith(b"+"):
            raise ConnectionError(f"{parts[0]} failed: {reply!r}")
        return reply

    def query(self, *parts: str):
        """One request and its whole reply: bytes, str (simple), int, None or a list of those."""
        self.socket.sendall(request(*parts))
        return self._reply()

    def _reply(self):
        line = next(self.lines(time.monotonic() + 5), None)
        if line is None:
            raise ConnectionError("no reply")
        kind, rest = line[:1], line[1:].rstrip(b"\r\n")
        if kind == b"-":
            raise ConnectionError(rest.decode(errors="replace"))
        if kind == b"*":
            return [self._reply() for _ in range(int(rest))]
        if kind == b"$":
            size = int(rest)
            if size < 0:
                return None
            while len(self.held) - self.at < size + 2:
                self._receive()
            value = bytes(self.held[self.at : self.at + size])
            self.at += size + 2
            return value
        return int(rest) if kind == b":" else rest.decode(errors="replace")

    def _receive(self) -> None:
        """Add what comes next, and drop what was taken."""
        if not (more := self.socket.recv(1 << 16)):
            raise ConnectionError("the feed ended")
        del self.held[: self.at]
        self.at = 0
        self.held += more

    def lines(self, deadline: float) -> Iterator[bytes]:
        """Whole lines, with their first sign, until the deadline or the end of the feed."""
        searched = self.at
        while True:
            while (end := self.held.find(b"\n", max(searched, self.at))) >= 0:
                line, self.at = bytes(self.held[self.at : end + 1]), end + 1
                yield line
            left = deadline - time.monotonic()
            if left <= 0:
                return
            self.socket.settimeout(left)
            searched = len(self.held) - self.at
            try:
                self._receive()
            except TimeoutError:
                return


def context(insecure: bool = False, ca: str | None = None, cert: str | None = None, key: str | None = None) -> ssl.SSLContext:
    out = ssl.create_default_context(cafile=ca)
    if insecure:
        out.check_hostname, out.verify_mode = False, ssl.CERT_NONE
    if cert:
        out.load_cert_chain(cert, key)
    return out
