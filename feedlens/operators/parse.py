"""raw_lines to parsed_lines, and the lines that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions import args as A
from feedlens.functions import lines as L
from feedlens.functions.addresses import unpadded, with_canonical_ip
from feedlens.functions.rows import once

SETUP_REPLY = b"OK"


def without_replies(lines: DataFrame) -> DataFrame:
    """Lines without the bare reply that opens a feed; null lines stay and fail to parse."""
    return lines.where(~F.col("line").eqNullSafe(F.lit(SETUP_REPLY)))


def parse(lines: DataFrame) -> DataFrame:
    """lines (line BINARY, any other columns) with ok, error and the fields of each line.

    Fields are null where ok is false. `tail` and `args` hold one character for each byte; args_ok says
    whether the tail is well formed, which only structured output asks for. Catalyst drops what is not used.
    """
    text = L.chars(F.coalesce(F.col("line"), F.lit(b"")))
    p, host, port, kind = (F.col(c) for c in ("_p", "_host", "_port", "_kind"))
    rows = with_canonical_ip(once(lines, "_p", L.groups(text)), L.v6_text(p), "_v6")
    fits = L.fitting(p)
    rows = once(rows, "_host", L.client_host(p, F.col("_v6")))
    rows = once(rows, "_port", L.client_port(p))
    rows = once(rows, "_kind", F.when(fits, L.client_kind(p, host, port)))
    rows = once(rows, "ok", F.coalesce(fits & kind.isNotNull() & L.numbers_fit(p), F.lit(False)))
    ok = F.col("ok")
    g = lambda name: F.when(ok, L.group(p, name))
    error = F.when(ok, F.lit(None)).when(~fits, "grammar").when(kind.isNull(), "client address").otherwise("number out of range")
    path = F.when(kind == "path", L.to_bytes(L.group(p, "path")).cast("string"))
    client = F.struct(kind.alias("kind"), F.when(kind == "tcp", host).alias("host"), F.when(kind == "tcp", port).alias("port"), path.alias("path"))
    rows = rows.withColumns({
        "error": error.cast("string"), "client": F.when(ok, client),
        "ts_int": g("ts_int"), "ts_frac": g("ts_frac"), "db": unpadded(g("db")).cast("decimal(20,0)"), "cmd": g("cmd"), "tail": g("tail"),
        "addr": F.when(ok, L.client_text(kind, host, port, path)),
    })
    micros = F.concat(F.col("ts_int"), F.lit("."), F.substring(F.col("ts_frac"), 1, 6)).try_cast("decimal(26,6)")
    rows = rows.withColumns({
        "timestamp": L.timestamp(F.col("ts_int"), F.col("ts_frac")),
        "event_time": F.when(F.length(unpadded(F.col("ts_int"))) <= 11, F.timestamp_micros((micros * 1000000).cast("long"))),
        "args_ok": ok & A.args_ok(F.col("tail")), "args": A.args(F.col("tail")),
    })
    return rows.drop("_p", "_host", "_port", "_kind", "_v6")


def accepted(parsed: DataFrame, structured: bool = False) -> DataFrame:
    """Lines that an output takes: structured kinds also need well-formed arguments."""
    return parsed.where(F.col("args_ok") if structured else F.col("ok"))


def dead_letters(parsed: DataFrame, structured: bool = False) -> DataFrame:
    """All lines, with message and error of those that an output does not take, null for the others."""
    bad = ~F.col("args_ok") if structured else ~F.col("ok")
    error = F.when(bad, F.coalesce("error", F.lit("arguments")))
    text = L.lossy(L.chars(F.coalesce(F.col("line"), F.lit(b""))))
    return parsed.withColumn("error", error).withColumn("message", F.when(F.col("error").isNotNull(), F.concat(F.lit("Failed to parse line '"), text, F.lit("' ("), F.col("error"), F.lit(")"))))


def rejected(parsed: DataFrame, structured: bool = False) -> DataFrame:
    """Dead letters: message and error of the lines that an output does not take."""
    return dead_letters(parsed.where(~F.col("args_ok") if structured else ~F.col("ok")), structured)
