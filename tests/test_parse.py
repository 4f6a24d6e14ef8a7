"""Vectors of the line grammar, and a byte-wise model of the argument grammar."""

import ipaddress
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from feedlens.functions import args as A
from feedlens.functions import lines as L
from feedlens.operators.parse import parse, rejected
from feedlens.plans import formats, serializers
from feedlens.sources.text import as_lines, read_lines, server_literal

P = "1699000555.000250 [7 10.20.30.40:6001] "


def lines(spark, values, **source):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, v if isinstance(v, bytes) else v.encode()) for i, v in enumerate(values)], "n long, value binary")
    return as_lines(rows, seq=F.col("n"), **source)


def rendered(spark, values, kind="plain", format=None, **source):
    return [bytes(r.value) for r in serializers.render(parse(lines(spark, values, **source)), kind, format).orderBy("seq").collect()]


class Grammar:
    """Lines made by the rules of the feed, with what their fields must be."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def padded(self, value: int, most: int = 3) -> str:
        return "0" * self.rng.randint(0, most) + str(value)

    def blanks(self) -> str:
        return "".join(self.rng.choice(" \t") for _ in range(self.rng.randint(0, 3)))

    def client(self) -> tuple[str, str, str, str]:
        """Text, address, host and port of a client."""
        rng, port = self.rng, self.rng.choice((0, 9, 6379, 65535))
        match rng.choice("46plu"):
            case "4":
                octets = [rng.choice((0, 7, 255, rng.randint(0, 255))) for _ in range(4)]
                host = ".".join(map(str, octets))
                return ".".join(self.padded(o) for o in octets) + ":" + self.padded(port), f"{host}:{port}", host, str(port)
            case "6":
                host = ipaddress.IPv6Address(bytes(rng.choice((0, 0, 0, rng.randint(0, 255))) for _ in range(16)))
                shown = f"::ffff:{host.ipv4_mapped}" if host.ipv4_mapped else host.compressed
                return f"[{rng.choice((host.compressed, host.exploded.upper()))}]:{self.padded(port)}", f"{shown}:{port}", shown, str(port)
            case "p":
                folder, name = "".join(rng.choice("/ab é.") for _ in range(rng.randint(0, 8))), "".join(rng.choice("xy .:") for _ in range(rng.randint(0, 4)))
                path = f"{folder}/{name}" if folder else ""
                return f"unix:{path}", path, "-", path.rsplit("/", 1)[-1] or "-"
            case "l":
                return "lua", "lua", "-", "lua"
        return "", "-", "-", "-"

    def line(self) -> tuple[str, list[str]]:
        """A line, and its database, address, host, port and command."""
        rng = self.rng
        db, (text, *shown) = rng.choice((0, 15, rng.randint(0, 1 << 20), (1 << 64) - 1)), self.client()
        command = "".join(rng.choice("aZ_9") for _ in range(rng.randint(1, 6)))
        seconds = f"{self.padded(rng.randint(0, 1 << 33))}.{rng.randint(0, 10**6):06}"
        return f'{seconds}{self.blanks()}[{self.padded(db)}{rng.choice((" ", self.blanks() + " "))}{text}]{self.blanks()}"{command}"{self.blanks()}', [str(db), *shown, command]


def test_lines_equal_the_grammar(spark):
    grammar = Grammar(11)
    made = [grammar.line() for _ in range(3000)]
    got = rendered(spark, [line for line, _ in made], format="%d|%ca|%ch|%cp|%C")
    assert [(line, x.decode()) for (line, want), x in zip(made, got, strict=True) if x.decode() != "|".join(want)] == []


def test_broken_lines_are_rejected(spark):
    grammar, bad = Grammar(12), []
    for i in range(400):
        line = grammar.line()[0]
        bad.append([line.replace("[", "", 1), "-" + line, line.replace('"', "", 1), line.replace(".", ",", 1), line[: line.index("]")], line.replace('"', '"é', 1)][i % 6])
    assert parse(lines(spark, bad)).where("ok").select("line").collect() == []


def test_a_few_lines(spark):
    got = rendered(spark, ["3.000000[1]\"A\"", '3.5 [2 8.8.4.4:53] "B_2"\t"x y"'], format="%d|%ca|%C|%a")
    assert got == [b"1|-|A|", b'2|8.8.4.4:53|B_2|"x y"']


def test_addresses_equal_the_standard_library(spark):
    from pyspark.sql import functions as F

    from feedlens.functions.addresses import with_canonical_ip

    rng = random.Random(3)
    some = lambda: rng.choice(["0", "0000", "00a", "F", "1", "beef", "12345", ""])
    texts = [":".join(some() for _ in range(rng.randint(1, 9))) for _ in range(3000)] + ["::".join(":".join(rng.choice("0a1") for _ in range(rng.randint(0, 5))) for _ in range(2)) for _ in range(2000)]
    texts += [f"::{rng.choice(['', 'ffff:', '0:1:'])}{rng.randint(0, 300)}.2.3.4" for _ in range(200)]

    def want(text):
        try:
            ip = ipaddress.IPv6Address(text)
        except ValueError:
            return None
        return f"::ffff:{ip.ipv4_mapped}" if ip.ipv4_mapped else ip.compressed

    rows = with_canonical_ip(spark.createDataFrame([(x,) for x in set(texts)], "text string"), F.col("text"), "ip").collect()
    assert [(r.text, r.ip) for r in rows if r.ip != want(r.text)] == []
    assert sum(r.ip is not None for r in rows) > 500


def test_doubles_are_shortest(spark):
    from decimal import Decimal

    rng = random.Random(4)
    numbers = [0.0, 1.0, 2e-3, 2e23, 1e7, 1.2345678e7, 1e-7] + [rng.random() * 10 ** rng.randint(-5, 15) for _ in range(5000)]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", L.plain_double(L.F.col("x")).alias("text")).collect()

    def want(x):
        text = format(Decimal(repr(x)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text

    assert [(r.x, r.text) for r in got if r.text != want(r.x)] == []


def test_long_bytes_and_invalid_utf8(spark):
    tail = b'"k" "' + b"\xff\xfe\x00" * 1000 + b'"'
    line = P.encode() + b'"SET" ' + tail
    assert rendered(spark, [line], format="%l") == [b'"SET" ' + tail]
    assert rendered(spark, [line], "resp") == [b"*3\r\n$3\r\nSET\r\n$1\r\nk\r\n$3000\r\n" + b"\xff\xfe\x00" * 1000 + b"\r\n"]
    assert rendered(spark, [line], format="%a") == [b'"k" "' + (b"\xff\xfe\x00" * 1000).decode(errors="replace").encode() + b'"']


def test_formats(spark):
    ip = dict(server=server_literal("tcp", "127.0.0.1", 6379, None, "127.0.0.1"))
    unix = dict(server=server_literal("unix", None, None, "/run/server.sock"))
    a, b, c = ('1.0 [0 127.0.0.1:49152] "PING"', '1.0 [0 127.0.0.2:49152] "PING"', '1.0 [0 unix:/run/client.sock] "PING"')
    assert rendered(spark, [a, b], format="%S", **ip) == [b"6379 49152", b"127.0.0.1:6379 127.0.0.2:49152"]
    assert rendered(spark, [c], format="%S", **unix) == [b"/run/server.sock /run/client.sock"]
    assert rendered(spark, [c], format="%sp %ch %cp", **unix) == [b"server.sock - client.sock"]
    assert rendered(spark, [a], format="%% %%d %x %sx %") == [b"%% %0 %x %sx %"]
    assert rendered(spark, [a], format="") == [b""]
    assert formats.compile_format("%t [%d %ca] %l") == [("token", "t"), ("text", " ["), ("token", "d"), ("text", " "), ("token", "ca"), ("text", "] "), ("token", "l")]


def test_serializers(spark):
    line = P.encode() + b'"SET" "k" "\\xff \xc3\xa9,\\"\\x01"'
    out = json.loads(rendered(spark, [line], "json")[0])
    assert out == {"timestamp": 1699000555.00025, "db": 7, "addr": "10.20.30.40:6001", "cmd": "SET", "args": ["k", '� é,"\x01']}
    assert rendered(spark, [line], "csv") == ['1699000555.00025,7,10.20.30.40:6001,SET,k,"� é,""\x01"'.encode()]
    assert rendered(spark, [line], "php")[0].endswith(b's:4:"args";a:2:{i:0;s:1:"k";i:1;s:7:"\xff \xc3\xa9,"\x01";}}')
    assert rendered(spark, ['1.000000 [0 lua] "PING"'], "json") == [b'{"timestamp":1.0,"db":0,"addr":"lua","cmd":"PING","args":[]}']
    with pytest.raises(ValueError, match="plain, json"):
        serializers.kind_of("xml")


def test_structured_kinds_reject_what_plain_takes(spark):
    p = parse(lines(spark, [P + '"SET" "unterminated']))
    assert rejected(p).count() == 0
    assert [r.message for r in rejected(p, structured=True).collect()] == [f"Failed to parse line '{P}\"SET\" \"unterminated' (arguments)"]


def test_framing(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"+a\r\n\r\n++b\r\r\nc\rd\nlast")
    assert [bytes(r.line) for r in read_lines(spark, str(tmp_path)).orderBy("seq").collect()] == [b"a", b"", b"+b", b"c\rd", b"last"]
    assert [bytes(r.line) for r in lines(spark, [b"+x\r\r\n"], live=True).collect()] == [b"x\r"]


def test_resp_file_bytes(spark, tmp_path):
    r = serializers.render(parse(lines(spark, [P + '"SET" "k" "v"'] * 2)), "resp")
    serializers.write(r.coalesce(1), str(tmp_path / "out"), "resp")
    data = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert data == b"*3\r\n$3\r\nSET\r\n$1\r\nk\r\n$1\r\nv\r\n" * 2


def test_empty_table(spark):
    assert rendered(spark, [], "json") == []


# ---------------------------------------------------------------- a byte-wise model

ESC = {ord(k): v for k, v in zip('nrtabf\\/" ', b'\n\r\t\a\b\f\\/" ', strict=True)}


def closes(s: bytes, i: int) -> bool:
    rest = s[i + 1 :]
    bare = rest.lstrip(b" \t\r\n")
    return not bare or (len(bare) < len(rest) and bare[:1] == b'"')


def model(s: bytes):
    out, i = [], 0
    while i < len(s):
        if s[i : i + 1] != b'"':
            return None
        i, arg = i + 1, bytearray()
        while True:
            if i >= len(s):
                return None
            c = s[i]
            if c == 34 and closes(s, i):
                i += 1
                break
            if c == 92 and s[i + 1 : i + 2] == b"x" and len(s) >= i + 4 and all(x in b"0123456789abcdefABCDEF" for x in s[i + 2 : i + 4]):
                arg.append(int(s[i + 2 : i + 4], 16))
                i += 4
            elif c == 92 and i + 1 < len(s) and s[i + 1] in ESC:
                arg.append(ESC[s[i + 1]])
                i += 2
            else:
                arg.append(c)
                i += 1
        out.append(bytes(arg))
        j = i
        while j < len(s) and s[j] in b" \t":
            j += 1
        if j < len(s) and j == i:
            return None
        i = j
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([b'"', b"\\", b"a", b"x4", b"1", b" ", b"\t", b"\n", b"\xff", b"n", b'" "', b'\\"']), max_size=12), min_size=300, max_size=300))
def test_args_equal_the_model(spark, tails):
    from pyspark.sql import functions as F

    tails = [b'"' + b"".join(t) + b'"' for t in tails]
    rows = spark.createDataFrame(list(enumerate(tails)), "i long, t binary").withColumn("c", L.chars(F.col("t")))
    got = rows.select("i", A.args_ok(F.col("c")).alias("ok"), F.transform(A.args(F.col("c")), L.to_bytes).alias("a")).orderBy("i").collect()
    for r, t in zip(got, tails, strict=True):
        assert ([bytes(x) for x in r.a] if r.ok else None) == model(t), t
