"""Quoted arguments: a tail of a line as an array of byte strings, as built-in expressions.

A quote closes an argument only before the end or before white space and another quote. Known escapes are
decoded, other backslashes stay.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BODY = r'(?:[^"\\]++|\\x[0-9a-fA-F]{2}|\\[nrtabf\\/" ]|\\|"(?![ \t\r\n]*\z)(?![ \t\r\n]+"))*+'
_ARG = rf'(?s)"({_BODY})"(?:[ \t]+|\z)'
_WHOLE = rf'(?s)\A(?:"{_BODY}"(?:[ \t]+|\z))*+\z'
_TOKEN = r'(?s)\\x[0-9a-fA-F]{2}|\\[nrtabf\\/" ]|\\|[^\\]+'
# Escape letter and the character it stands for.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "a": "\a", "b": "\b", "f": "\f"}


def _unescaped(token: Column) -> Column:
    out = F.when(token.startswith("\\x") & (F.length(token) == 4), F.decode(F.unhex(F.substring(token, 3, 2)), "ISO-8859-1"))
    for letter, char in ESCAPES.items():
        out = out.when(token == "\\" + letter, F.lit(char))
    return out.when(token.startswith("\\") & (F.length(token) == 2), F.substring(token, 2, 1)).otherwise(token)


def args_ok(tail: Column) -> Column:
    """Whether a tail consists of arguments to its end."""
    return tail.rlike(_WHOLE)


def args(tail: Column) -> Column:
    """Arguments as characters of their bytes; only meaningful where args_ok() holds."""
    raw = F.regexp_extract_all(tail, F.lit(_ARG), F.lit(1))
    decode = lambda a: F.array_join(F.transform(F.regexp_extract_all(a, F.lit(_TOKEN), F.lit(0)), _unescaped), "")
    return F.when(tail.contains("\\"), F.transform(raw, lambda a: F.when(a.contains("\\"), decode(a)).otherwise(a))).otherwise(raw)
