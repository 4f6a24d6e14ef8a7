"""IP and server addresses, as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.rows import once

_V4 = r"\A(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\z"
_H = "[0-9a-fA-F]{1,4}"
_V6_FULL = rf"\A{_H}(?::{_H}){{7}}\z"
_V6_SHORT = rf"\A(?:{_H}(?::{_H})*)?::(?:{_H}(?::{_H})*)?\z"
_V6_TAIL = r"\A(.*:)([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\z"


def unpadded(digits: Column) -> Column:
    """A string of digits without leading zeros; all zeros give one."""
    short = F.ltrim(digits, F.lit("0"))
    return F.when(~digits.startswith("0"), digits).when((short == "") & digits.startswith("0"), "0").otherwise(short)


def fits_u64(digits: Column) -> Column:
    """Whether a digit string is a number below 2^64; leading zeros do not count."""
    short = F.ltrim(digits, F.lit("0"))
    return F.when(F.octet_length(digits) < 20, F.lit(True)).otherwise((F.length(short) < 20) | ((F.length(short) == 20) & (short <= "18446744073709551615")))


def small_int(digits: Column, most: int) -> Column:
    """A digit string as an int up to `most`, else null."""
    plain = F.octet_length(digits) <= 9
    value = F.when(plain, digits.try_cast("int")).otherwise(F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 9, F.coalesce(F.ltrim(digits, F.lit("0")).try_cast("int"), F.lit(0))))
    return F.when(value <= most, value)


#: Zeros at the head of a number in an address.
_PADDING = r"(?<![0-9a-f])0+(?=[0-9a-f])"


def padded_v4(text: Column) -> Column:
    """Four numbers of digits, of any width, as an IPv4 address; null where one is over 255."""
    bare = F.regexp_replace(text, _PADDING, "")
    return F.when(text.rlike(_V4), text).when(bare.rlike(_V4), bare)


def _colons(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(":"), F.lit("")))


def _hextets(text: Column) -> Column:
    """The eight hextets of an address without dots, joined by colons; null where `::` would stand for none."""
    left, right = F.split_part(text, F.lit("::"), F.lit(1)), F.split_part(text, F.lit("::"), F.lit(2))
    count = lambda x: F.when(x == "", 0).otherwise(_colons(x) + 1)
    given = count(left) + count(right)
    zeros = F.substring(F.repeat(F.lit(":0"), 8 - given), 2, 16)
    some = lambda x: F.when(x != "", x)
    return F.when(~text.contains("::"), text).when(given <= 7, F.concat_ws(":", some(left), zeros, some(right)))


def _mapped(framed: Column) -> Column:
    """A mapped IPv4 address, with dots, of eight hextets between colons."""
    number = lambda i: F.conv(F.split_part(framed, F.lit(":"), F.lit(i)), 16, 10).cast("int")
    octets = [f(number(i)) for i in (8, 9) for f in (lambda n: F.shiftright(n, 8), lambda n: n.bitwiseAND(F.lit(255)))]
    return F.concat(F.lit("::ffff:"), F.concat_ws(".", *[o.cast("string") for o in octets]))


def with_canonical_ip(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """rows with the canonical form of an IPv4 or IPv6 address, null for anything else.

    The steps are columns of their own, so that each is a small expression; a null text skips them.
    """
    tail = F.regexp_extract(text, _V6_TAIL, 2)
    octet = lambda i: F.split_part(tail, F.lit("."), F.lit(i)).cast("int")
    dotted = F.concat(F.regexp_extract(text, _V6_TAIL, 1), F.lower(F.hex(octet(1) * 256 + octet(2))), F.lit(":"), F.lower(F.hex(octet(3) * 256 + octet(4))))
    rows = once(rows, "_ip_plain", F.when(text.contains("."), F.when(tail.rlike(_V4), dotted)).otherwise(text))
    plain = F.col("_ip_plain")
    # Hextets in lower case without leading zeros.
    rows = once(rows, "_ip_bare", F.when(plain.rlike(_V6_FULL) | plain.rlike(_V6_SHORT), F.regexp_replace(F.lower(plain), _PADDING, "")))
    rows = once(rows, "_ip_framed", F.when(F.col("_ip_bare").isNotNull(), F.concat(F.lit(":"), _hextets(F.col("_ip_bare")), F.lit(":"))))
    framed = F.col("_ip_framed")
    # The first of the longest runs of zeros is left out.
    rows = once(rows, "_ip_zeros", F.coalesce(*[F.when(framed.contains(":0" * n + ":"), ":0" * n + ":") for n in range(8, 1, -1)]))
    zeros, at = F.col("_ip_zeros"), F.position(F.col("_ip_zeros"), framed)
    right = F.substring(framed, at + F.octet_length(zeros), F.octet_length(framed) - at - F.octet_length(zeros))
    short = F.when(zeros.isNull(), F.substring(framed, F.lit(2), F.octet_length(framed) - 2)).otherwise(F.concat(F.substring(framed, F.lit(2), at - 2), F.lit("::"), right))
    rows = once(rows, "_ip_short", F.when(framed.isNotNull(), short))
    out = F.when(framed.startswith(":0:0:0:0:0:ffff:"), _mapped(framed)).when(framed.isNotNull(), F.col("_ip_short")).when(text.rlike(_V4), text)
    return once(rows, name, out).drop("_ip_plain", "_ip_bare", "_ip_framed", "_ip_zeros", "_ip_short")


def server_address(text: Column) -> Column:
    """A server's address as struct kind, host, port, path, error.

    All digits up to 65535: a port of 127.0.0.1. With a slash: a socket path. With exactly one colon: host and
    port, an error if the port is none. Else the part before the first colon, at port 6379.
    """
    parts = F.split(text, ":")
    port = small_int(F.when(text.rlike(r"\A[0-9]+\z"), text), 65535)
    two = F.size(parts) == 2
    own = small_int(F.when(F.get(parts, F.lit(1)).rlike(r"\A[0-9]+\z"), F.get(parts, F.lit(1))), 65535)
    none = F.lit(None).cast("string")
    make = lambda kind, host, number, path, error: F.struct(F.lit(kind).alias("kind"), host.cast("string").alias("host"), number.cast("int").alias("port"), path.cast("string").alias("path"), error.cast("string").alias("error"))
    return (
        F.when(port.isNotNull(), make("tcp", F.lit("127.0.0.1"), port, none, none))
        .when(text.contains("/"), make("unix", none, none, text, none))
        .when(two & own.isNull(), make("error", none, none, none, F.lit("invalid port")))
        .when(two, make("tcp", parts[0], own, none, none))
        .otherwise(make("tcp", parts[0], F.lit(6379), none, none))
    )


def server_text(server: Column) -> Column:
    """host:port, or the path."""
    return F.when(server["kind"] == "tcp", F.concat(server["host"], F.lit(":"), server["port"].cast("string"))).otherwise(server["path"])


def server_url(server: Column) -> Column:
    return F.when(server["kind"] == "tcp", F.concat(F.lit("redis://"), server_text(server))).otherwise(F.concat(F.lit("unix://"), server["path"]))


def union_all(frames: list):
    """Fan-in: all rows of all frames."""
    return reduce(lambda a, b: a.unionByName(b), frames)
