"""Output kinds: each turns parsed lines into a column `value` of bytes, one record each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions import lines as L
from feedlens.functions.rows import once
from feedlens.operators.parse import accepted
from feedlens.plans import formats

KINDS = ("plain", "json", "php", "csv", "resp")


def kind_of(text: str) -> str:
    """An output kind by its name in any case."""
    if text.lower() not in KINDS:
        raise ValueError(f"no such output kind: {text}. Values: {', '.join(KINDS)}")
    return text.lower()


def _number_text() -> Column:
    """The timestamp as a float literal: with a fraction, also where that is zero."""
    text = L.timestamp_text(F.col("ts_int"), F.col("ts_frac"))
    return F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))


def _valid_args() -> Column:
    return F.transform("args", L.lossy)


def json_value() -> Column:
    rest = F.to_json(F.struct("db", "addr", "cmd", _valid_args().alias("args")))
    return F.concat(F.lit('{"timestamp":'), _number_text(), F.lit(","), F.substring(rest, F.lit(2), F.length(rest))).cast("binary")


def csv_value() -> Column:
    """Fields and then each argument; quoted where they hold a comma, a quote or a line end, and where the whole record is one empty field."""
    quote = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    fields = F.concat(F.array(_number_text(), F.col("db").cast("string"), F.col("addr"), F.col("cmd")), _valid_args())
    return F.array_join(F.transform(fields, quote), ",").cast("binary")


def php_value() -> Column:
    """A serialized array of five; lengths are bytes, arguments stay as they are."""
    text = lambda x: F.concat(F.lit("s:"), F.length(x).cast("string"), F.lit(':"'), x, F.lit('";'))
    latin = lambda x: L.chars(x.cast("binary"))
    items = F.array_join(F.transform("args", lambda a, i: F.concat(F.lit("i:"), i.cast("string"), F.lit(";"), text(a))), "")
    # Doubles have no closing .0 there.
    number = L.timestamp_text(F.col("ts_int"), F.col("ts_frac"))
    head = F.concat(F.lit('a:5:{s:9:"timestamp";d:'), number, F.lit(';s:2:"db";i:'), F.col("db").cast("string"), F.lit(';s:4:"addr";'), text(latin(F.col("addr"))), F.lit('s:3:"cmd";'), text(F.col("cmd")))
    return L.to_bytes(F.concat(head, F.lit('s:4:"args";a:'), F.size("args").cast("string"), F.lit(":{"), items, F.lit("}}")))


def resp_value() -> Column:
    """Command and arguments as an array of bulk strings; no line end follows."""
    bulk = lambda x: F.concat(F.lit("$"), F.length(x).cast("string"), F.lit("\r\n"), x, F.lit("\r\n"))
    each = F.array_join(F.transform(F.concat(F.array("cmd"), F.col("args")), bulk), "")
    return L.to_bytes(F.concat(F.lit("*"), (F.size("args") + 1).cast("string"), F.lit("\r\n"), each))


def _value(kind: str, format: str | None) -> Column:
    return {"plain": lambda: formats.render(formats.SINGLE if format is None else format), "json": json_value, "csv": csv_value, "php": php_value, "resp": resp_value}[kind]()


def _args_once(rows: DataFrame, kind: str) -> DataFrame:
    return rows if kind == "plain" else once(rows.withColumnRenamed("args", "_args"), "args", F.col("_args")).drop("_args")


def render(parsed: DataFrame, kind: str = "plain", format: str | None = None) -> DataFrame:
    """Accepted lines with `value`; plain takes any tail, the others need well-formed arguments."""
    kind = kind_of(kind)
    return _args_once(accepted(parsed, structured=kind != "plain"), kind).withColumn("value", _value(kind, format))


def values(parsed: DataFrame, kind: str = "plain", format: str | None = None) -> DataFrame:
    """All lines with `value`, null for those that the kind does not take."""
    kind = kind_of(kind)
    return _args_once(parsed, kind).withColumn("value", F.when(F.col("ok" if kind == "plain" else "args_ok"), _value(kind, format)))


def write(rendered: DataFrame, path: str, kind: str = "plain", mode: str = "errorifexists") -> None:
    """Write `value` as text files: a line each, and RESP records one after another.

    A RESP record ends with a line end of its own, which the sink's separator takes the place of.
    """
    value = F.col("value").cast("string")
    if kind_of(kind) == "resp":
        cut = L.to_bytes(F.regexp_replace(L.chars(F.col("value")), r"\r\n\z", "")).cast("string")
        rendered.select(cut.alias("value")).write.mode(mode).option("lineSep", "\r\n").text(path)
    else:
        rendered.select(value.alias("value")).write.mode(mode).option("lineSep", "\n").text(path)
