"""The format language of plain output: compiled once into expressions of the line's fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions import addresses as A
from feedlens.functions import lines as L

# Fixed values.
SINGLE = "%t [%d %ca] %l"
MULTI = "%t [%S %d] %l"
TOKENS = ("sa", "sh", "sp", "sn", "ca", "ch", "cp", "S", "t", "d", "C", "a", "l")


def compile_format(text: str) -> list[tuple[str, str]]:
    """("token", name) and ("text", literal) in order; what is no token stays as it is, a percent sign too."""
    out: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        name = next((t for t in TOKENS if text[at] == "%" and text.startswith(t, at + 1)), None)
        if name:
            out.append(("token", name))
            at += 1 + len(name)
            continue
        # A literal reaches to the next percent sign; one that opens no token is part of it.
        end = text.find("%", at + 1)
        end = len(text) if end < 0 else end
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + text[at:end])
        else:
            out.append(("text", text[at:end]))
        at = end
    return out


def _base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def token(name: str) -> Column:
    """A token as BINARY, from the columns of parse() and the source's server and name."""
    server, client = F.col("server"), F.col("client")
    is_tcp = client["kind"] == "tcp"
    port = client["port"].cast("string")
    path_port = F.when(F.length(_base_name(client["path"])) > 0, _base_name(client["path"])).otherwise("-")
    full = lambda: F.concat(A.server_text(server), F.lit(" "), F.col("addr"))
    text = {
        "S": lambda: F.when((server["kind"] == "tcp") & is_tcp & (server["ip"] == client["host"]), F.concat(server["port"].cast("string"), F.lit(" "), port)).otherwise(full()),
        "sa": lambda: A.server_text(server),
        "sh": lambda: F.when(server["kind"] == "tcp", server["host"]).otherwise(server["path"]),
        "sp": lambda: F.when(server["kind"] == "tcp", server["port"].cast("string")).otherwise(_base_name(server["path"])),
        "sn": lambda: F.coalesce(F.col("name"), F.lit("-")),
        "ca": lambda: F.col("addr"),
        "ch": lambda: F.when(is_tcp, client["host"]).otherwise("-"),
        "cp": lambda: F.when(is_tcp, port).when(client["kind"] == "path", path_port).when(client["kind"] == "lua", "lua").otherwise("-"),
        "t": lambda: L.timestamp_text(F.col("ts_int"), F.col("ts_frac")),
        "d": lambda: F.col("db").cast("string"),
        "C": lambda: F.col("cmd"),
        "a": lambda: L.lossy(F.col("tail")),
    }
    if name == "l":
        return F.concat(F.lit(b'"'), F.col("cmd").cast("binary"), F.lit(b'" '), L.to_bytes(F.col("tail")))
    return text[name]().cast("binary")


def render(text: str) -> Column:
    """A line in the given format, as BINARY without a line end."""
    parts = [F.lit(value.encode()) if kind == "text" else token(value) for kind, value in compile_format(text)]
    return F.concat(*parts) if parts else F.lit(b"")
