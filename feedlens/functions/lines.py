"""Feed lines: framing, command names, the line grammar, numbers as text.

Lines are bytes. They are decoded as ISO-8859-1, one character for each byte, so that regular expressions
see every byte, and encoded again on the way out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions.addresses import fits_u64, padded_v4, small_int, unpadded
from feedlens.functions.rows import let

#: Joins the groups of the line pattern; no byte decodes to it.
SEP = "Ā"
_PREFIX = (
    r"(?s)\A([0-9]+)\.([0-9]+)[ \t]*\[([0-9]+)[ \t]*"
    r"(?:(unix:)([^\]]*)|([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+):([0-9]+)|\[([^\]]*)\]:([0-9]+)|(lua)|)\]"
    r'[ \t]*"([A-Za-z0-9_]+)"[ \t]*(.*)\z'
)
GROUPS = ["ts_int", "ts_frac", "db", "unix", "path", "v4", "v4_port", "v6", "v6_port", "lua", "cmd", "tail"]


def chars(line: Column) -> Column:
    """Bytes as a string of one character for each."""
    return F.decode(line, "ISO-8859-1")


def to_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def lossy(text: Column) -> Column:
    """Characters of bytes as UTF-8 text, malformed sequences replaced."""
    return F.make_valid_utf8(to_bytes(text).cast("string"))


def framed(line: Column, live: bool = False) -> Column:
    """A line as read, without line ends and a leading plus: all line ends of a replay, one of each kind of a live feed.

    Only lines that end with one are decoded for it.
    """
    bare = to_bytes(F.regexp_replace(chars(line), r"\r?\n?\z", "") if live else F.rtrim(chars(line), F.lit("\r\n")))
    ends = line.endswith(F.lit(b"\n")) | line.endswith(F.lit(b"\r"))
    unsigned = lambda x: F.when(x.startswith(F.lit(b"+")), F.substring(x, 2, 1 << 30)).otherwise(x)
    return F.when(ends, unsigned(bare)).otherwise(unsigned(line))


def command_bytes(line: Column) -> Column:
    """What stands between the first two quotes of a line, as a string of its own bytes; null with fewer than two.

    Quotes are single bytes, so the line need not be decoded.
    """
    head = F.substring_index(line.cast("string"), '"', 2)  # all of it with fewer quotes
    return F.when(F.octet_length(head) < F.octet_length(line), F.substring_index(head, '"', -1))


def command(line: Column) -> Column:
    """As command_bytes(), one character for each byte."""
    return chars(command_bytes(line).cast("binary"))


def groups(text: Column) -> Column:
    """The parts of a line by one pass of the pattern; an array of one element if the line does not fit it."""
    return F.split(F.regexp_replace(text, _PREFIX, SEP.join(f"${i + 1}" for i in range(len(GROUPS)))), SEP, len(GROUPS))


def fitting(parts: Column) -> Column:
    return F.size(parts) == len(GROUPS)


def group(parts: Column, name: str) -> Column:
    return F.get(parts, F.lit(GROUPS.index(name)))


def v6_text(parts: Column) -> Column:
    """The text in a client's brackets, null without brackets."""
    return F.when(F.length(group(parts, "v6_port")) > 0, group(parts, "v6"))


def client_host(parts: Column, v6: Column) -> Column:
    """A client's address in canonical form, null without a valid one. v6 is the canonical form of v6_text()."""
    return F.when(group(parts, "v4") != "", padded_v4(group(parts, "v4"))).when(group(parts, "v6_port") != "", v6)


def client_port(parts: Column) -> Column:
    """A client's port, null without a valid one."""
    return small_int(F.when(group(parts, "v4") != "", group(parts, "v4_port")).when(group(parts, "v6_port") != "", group(parts, "v6_port")), 65535)


def client_kind(parts: Column, host: Column, port: Column) -> Column:
    """tcp, path, lua or unknown; null where an address is invalid."""
    g = lambda name: group(parts, name)
    return (
        F.when((g("v4") != "") | (g("v6_port") != ""), F.when(host.isNotNull() & port.isNotNull(), "tcp"))
        .when(g("unix") != "", F.when(F.is_valid_utf8(to_bytes(g("path")).cast("string")), "path"))
        .when(g("lua") != "", "lua")
        .otherwise("unknown")
    )


def client_text(kind: Column, host: Column, port: Column, path: Column) -> Column:
    """Display form: ip:port, path, lua or -."""
    return F.when(kind == "tcp", F.concat(host, F.lit(":"), port.cast("string"))).when(kind == "path", path).when(kind == "lua", F.lit("lua")).otherwise(F.lit("-"))


def numbers_fit(parts: Column) -> Column:
    return fits_u64(group(parts, "ts_int")) & fits_u64(group(parts, "ts_frac")) & fits_u64(group(parts, "db"))


def timestamp(ts_int: Column, ts_frac: Column) -> Column:
    return ts_int.cast("double") + ts_frac.cast("double") / F.pow(F.lit(10.0), F.length(ts_frac))


def _shortest(number: Column, text: Column) -> Column:
    """The JVM's text of a double; where that has a digit too many, the text of fewer digits that is the same double."""
    def tidy(short: Column) -> Column:  # of 1.2340e+01 the digits and the power
        digits = F.regexp_replace(F.regexp_extract(short, r"\A(.*?)0*e", 1), r"\.\z", ".0")
        return F.concat(digits, F.lit("E"), F.regexp_extract(short, r"e\+?(-?)0*[0-9]+\z", 1), F.regexp_extract(short, r"e[+-]0*([0-9]+)\z", 1))

    same = lambda short: F.when(short.cast("double") == number, tidy(short))
    fewer = [let(F.format_string(f"%.{digits - 1}e", number), same) for digits in (15, 16, 17)]
    return F.when(F.length(text) < 17, text).otherwise(F.coalesce(*fewer, text))


def _unpowered(text: Column) -> Column:
    """A number with an exponent, as the JVM writes it, without the exponent."""
    digits = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0\z|\.", "")
    point = F.split_part(text, F.lit("E"), F.lit(2)).cast("int") + 1  # one digit stands before the point

    def placed(padded: Column) -> Column:
        whole = F.greatest(point, F.lit(1))
        return F.when(F.length(padded) > whole, F.concat(F.substring(padded, F.lit(1), whole), F.lit("."), F.substring(padded, whole + 1, F.length(padded)))).otherwise(padded)

    return let(F.when(point > 0, F.rpad(digits, F.greatest(F.length(digits), point), "0")).otherwise(F.concat(F.repeat(F.lit("0"), 1 - point), digits)), placed)


def plain_double(x: Column) -> Column:
    """The shortest decimal text of a double, without exponent and without a closing .0."""
    out = lambda best: F.when(best.contains("E"), _unpowered(best)).otherwise(F.regexp_replace(best, r"\.0\z", ""))
    return let(x, lambda number: let(_shortest(number, number.cast("string")), out))


def timestamp_text(ts_int: Column, ts_frac: Column) -> Column:
    """A timestamp as text, from its digits where six follow the point and ten at most stand before it, else by way of a double."""
    fraction = F.rtrim(ts_frac, F.lit("0"))
    short = F.concat(unpadded(ts_int), F.when(F.length(fraction) > 0, F.concat(F.lit("."), fraction)).otherwise(F.lit("")))
    return F.when((F.length(ts_int) <= 10) & (F.length(ts_frac) == 6), short).otherwise(plain_double(timestamp(ts_int, ts_frac)))
