"""Standing queries over a feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from feedlens.operators import stats
from feedlens.operators.parse import parse, without_replies
from feedlens.sources import sink
from feedlens.streaming import state


def positive(seconds: str | float) -> float:
    """An interval in seconds, more than zero."""
    value = float(seconds)
    if not value > 0:
        raise ValueError(f"not a positive number: {seconds}")
    return value


def stats_query(lines: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Cumulative counts by command, all of them at each trigger; without an interval what is there now, once."""
    writer = stats.by_command(without_replies(lines)).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=f"{positive(seconds)} seconds") if seconds else writer.trigger(availableNow=True)).start()


def counts_query(lines: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, compat: bool = False, seconds: float | None = None) -> StreamingQuery:
    """Counts by command as keyed state: a batch has the commands that changed, with an interval once per command and interval."""
    writer = state.by_command(without_replies(lines), compat, seconds).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer if seconds else writer.trigger(availableNow=True)).start()


def render_query(lines: DataFrame, path: str, checkpoint: str, kind: str = "plain", format: str | None = None, once: bool = True) -> StreamingQuery:
    """Rendered records as files under path/batch=n, and lines that do not parse as JSON under path-rejects/batch=n.

    One pass over a batch writes both, and its commit shows them. A batch that is repeated after a failure takes the
    place of what it wrote, so a line that the source can replay is written exactly once.
    """
    lines.sparkSession.dataSource.register(sink.FeedOutput)
    rows = sink.outcome(parse(without_replies(lines)), kind, format)
    writer = rows.writeStream.format("feed_output").option("path", path).option("kind", kind).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
