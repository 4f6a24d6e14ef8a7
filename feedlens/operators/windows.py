"""Counts in event time, sessions of clients, and lines read twice; in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.operators.parse import parse, without_replies


def timed(lines: DataFrame, delay: str | None = None) -> DataFrame:
    """Parsed lines with an event_time; a stream waits `delay` for late ones and drops what comes after that."""
    rows = parse(without_replies(lines)).where("ok and event_time is not null")
    return rows.withWatermark("event_time", delay) if delay else rows


def by_window(lines: DataFrame, width: str = "10 minutes", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """start, end, cmd, count, bytes: lines of each command in windows of event time, tumbling or sliding."""
    rows = timed(lines, delay).groupBy(F.window("event_time", width, slide).alias("w"), "cmd").agg(F.count(F.lit(1)).alias("count"), F.sum(F.octet_length("line").cast("long")).alias("bytes"))
    return rows.select("w.start", "w.end", "cmd", "count", "bytes")


def sessions(lines: DataFrame, gap: str = "5 minutes", delay: str | None = None) -> DataFrame:
    """addr, start, end, count: runs of lines of a client with pauses of at most `gap`; end is a gap after the last line."""
    rows = timed(lines, delay).groupBy(F.session_window("event_time", gap).alias("w"), "addr").agg(F.count(F.lit(1)).alias("count"))
    return rows.select("addr", "w.start", "w.end", "count")


def once_each(lines: DataFrame, delay: str | None = None) -> DataFrame:
    """Lines of a feed that is read more than once: each line of a source and time once.

    A stream remembers a line for `delay` of event time, so that its state is bounded; lines that do not parse have
    no time and are all kept out. A batch needs no delay.
    """
    rows = timed(lines, delay).withColumn("_digest", F.sha2("line", 256))
    keys = ["source_id", "event_time", "_digest"]
    kept = rows.dropDuplicatesWithinWatermark(keys) if delay else rows.dropDuplicates(keys)
    return kept.select(*lines.columns)
