"""Named instances from a TOML file, and instance arguments as sources."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Looked for in the working folder, then at home, in this order.
FILE_NAMES = (".feedlens", ".feedlens.toml")
DEFAULT_INSTANCE = "localhost:6379"


@dataclass(frozen=True)
class Address:
    kind: str
    host: str | None = None
    port: int | None = None
    path: str | None = None

    @classmethod
    def parse(cls, text: str) -> Address:
        """By the rules of functions.addresses.server_address, on one string."""
        if text.isascii() and text.isdigit() and int(text) <= 65535:
            return cls("tcp", "127.0.0.1", int(text))
        if "/" in text:
            return cls("unix", path=text)
        parts = text.split(":")
        if len(parts) == 2:
            if not (parts[1].isascii() and parts[1].isdigit() and int(parts[1]) <= 65535):
                raise ValueError(f"invalid port: {text}")
            return cls("tcp", parts[0], int(parts[1]))
        return cls("tcp", parts[0], 6379)

    @property
    def text(self) -> str:
        return f"{self.host}:{self.port}" if self.kind == "tcp" else str(self.path)


@dataclass(frozen=True)
class Tls:
    insecure: bool = False
    ca: str | None = None
    cert: str | None = None
    key: str | None = None


@dataclass(frozen=True)
class Source:
    """What to read; sources with one address are the same."""

    address: Address
    name: str | None = field(default=None, compare=False)
    user: str | None = field(default=None, compare=False)
    password: str | None = field(default=None, compare=False, repr=False)
    tls: Tls | None = field(default=None, compare=False)
    cluster: bool = field(default=False, compare=False)


def load(path: str | None = None) -> dict[str, dict]:
    """Entries by name. A named file must exist; without one the known places are searched, and none is an empty config."""
    if path:
        return tomllib.loads(Path(path).read_text())
    for folder in (Path.cwd(), Path.home()):
        for name in FILE_NAMES:
            if (found := folder / name).is_file():
                return tomllib.loads(found.read_text())
    return {}


def addresses(entry: dict) -> list[Address]:
    """Host and port come first, then addresses, then the path."""
    if entry.get("host") is not None and entry.get("port") is not None:
        return [Address("tcp", entry["host"], int(entry["port"]))]
    if entry.get("addresses") is not None:
        return [Address.parse(str(x)) for x in entry["addresses"]]
    if entry.get("path") is not None:
        return [Address("unix", path=entry["path"])]
    raise ValueError("an entry needs host and port, addresses or a path")


def tls_of(entry: dict) -> Tls | None:
    return Tls(bool(entry.get("insecure")), entry.get("tls_ca"), entry.get("tls_cert"), entry.get("tls_key")) if entry.get("tls") else None


def sources(instances: list[str], config: dict[str, dict], user: str | None = None, password: str | None = None, tls: Tls | None = None) -> list[Source]:
    """Each instance as its config entry's sources, else as an address; of equal addresses the first stays."""
    out: dict[Address, Source] = {}
    for text in instances or [DEFAULT_INSTANCE]:
        entry = config.get(text)
        if entry is None:
            own = [Source(Address.parse(text), None, user, password, tls)]
        else:
            own = [Source(a, text, entry.get("user"), entry.get("pass"), tls_of(entry), bool(entry.get("cluster"))) for a in addresses(entry)]
        for s in own:
            out.setdefault(s.address, s)
    return list(out.values())


def table(spark: SparkSession, config: dict[str, dict]) -> DataFrame:
    """Entries as rows, for operators.topology.resolve()."""
    rows = [(n, e.get("host"), e.get("port"), [str(a) for a in e["addresses"]] if e.get("addresses") is not None else None, e.get("path"), e.get("user"), e.get("pass")) for n, e in config.items()]
    return spark.createDataFrame(rows, "name string, host string, port int, addresses array<string>, path string, user string, pass string")
